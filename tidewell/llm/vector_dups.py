"""Operator 8: embedding near-dedup by product quantisation.

Vectors are scaled to length 1; equal ones form a class with a weight, so copies are never paired. Coarse
centroids and residual codebooks are fitted on a bounded sample (at most MOST_SAMPLE vectors, LIST_SAMPLE a list,
so lists grow with the square root of the table up to MOST_SAMPLE / LIST_SAMPLE). Every class goes into the
inverted list of its nearest centroid, with a code of a byte a subspace and its quantisation error.

* Probes: a list is probed where the distance of x to the plane between its centroid and x's own is at most a
  margin. The margin is calibrated on the sample: of pairs at exactly the least cosine, with random differences and
  with differences drawn from the data, and of the sample's own pairs, at least RECALL must meet (either one probing
  the other's list is enough). The bound that would be exact, half the reach, probes nearly all lists.
* Asymmetric distances from table lookups differ from true ones by at most the member's quantisation error, so
  members with a table distance of at most the reach plus their error survive: this loses nothing.
* Survivors, and only they, get their vectors and are compared by exact cosine in double precision.

So a link is only lost where neither vector probes the other's list: at most 1 - RECALL of pairs at the least
cosine, fewer above it. tests/llm measures this against brute force.

Queries carry half-precision vectors (their rounding is added to the reach). Lists and the queries on them
are cut into blocks of bounded size by a hash. A block of a list against a block of queries leaves a count a
vector, and for each vector the smallest one in its local component: rows in proportion to vectors, never pairs.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component, links with
nothing, as do vectors of different dimension; a null vec_id takes part in no link and has a null component;
rows of one vec_id count as separate vectors in n_links and as one in components; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, stars
from .shared import Scratch, read

MOST_SAMPLE, LEAST_SAMPLE, LIST_SAMPLE = 262_144, 16_384, 16
SUBSPACE_DIM, MOST_SUBSPACES, CODES = 4, 64, 256
BLOCK, QUERIES, RECALL = 1024, 2048, 0.9999
#: The norm of what rounding a unit vector to half precision changes is at most 2 ** -11.
HALF = 2.0**-11


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    norms = (centroids**2).sum(1)
    return np.concatenate([np.argmin(norms - 2 * x[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(x), 4096)])


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 8) -> np.ndarray:
    """At most k centroids of the rows of x."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(centroids, axis=0)


def coarse(x: np.ndarray, k: int) -> np.ndarray:
    """About k centroids; many of them are fitted inside the cells of a first few."""
    if k <= 512:
        return k_means(x, k)
    first = k_means(x, math.isqrt(k))
    near = nearest(x, first)
    cells = [x[near == c] for c in range(len(first))]
    return np.unique(np.concatenate([k_means(c, max(1, round(k * len(c) / len(x)))) for c in cells if len(c)]), axis=0)


class Quantiser:
    """Coarse centroids, codebooks of residuals and the calibrated margin, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float):
        self.centroids = coarse(sample, lists)
        residuals = sample - self.centroids[nearest(sample, self.centroids)]
        dim = sample.shape[1]
        self.parts = [p for p in np.array_split(np.arange(dim), min(MOST_SUBSPACES, -(-dim // SUBSPACE_DIM))) if len(p)]
        few = residuals[:LEAST_SAMPLE]
        self.books = [k_means(few[:, p], CODES, seed=9).astype(np.float32) for p in self.parts]
        self.margin = self._calibrated(sample[:4096], cosine)

    def _calibrated(self, x: np.ndarray, cosine: float) -> float:
        rng = np.random.default_rng(10)
        pairs = []
        for differences in (rng.normal(size=x.shape), rng.normal(size=x.shape), x[rng.permutation(len(x))] - x, x[rng.permutation(len(x))] - x[rng.permutation(len(x))]):
            across = differences - (differences * x).sum(1, keepdims=True) * x
            size = np.sqrt((across**2).sum(1, keepdims=True))
            fits = size[:, 0] > 1e-9
            pairs.append((x[fits], cosine * x[fits] + math.sqrt(1 - cosine * cosine) * across[fits] / size[fits]))
        similar = np.triu(x[:2048] @ x[:2048].T >= cosine, 1)
        i, j = np.nonzero(similar)
        pairs.append((x[i[:65536]], x[j[:65536]]))
        met = []
        for a, b in pairs:
            for k in range(0, len(a), 4096):
                (own_a, to_a), (own_b, to_b) = self.planes(a[k : k + 4096]), self.planes(b[k : k + 4096])
                rows = np.arange(len(own_a))
                met.append(np.minimum(to_a[rows, own_b], to_b[rows, own_a]))
        return float(np.quantile(np.concatenate(met), RECALL, method="higher")) if sum(map(len, met)) else 0.0

    def planes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The own list of each x, and its distances to the planes between its centroid and all others."""
        norms = (self.centroids**2).sum(1)
        d = norms - 2 * x @ self.centroids.T  # less |x|^2, the same in a row
        own = d.argmin(axis=1)
        gap = np.sqrt(np.maximum(norms[own][:, None] + norms - 2 * self.centroids[own] @ self.centroids.T, 0))
        out = (d - d.min(axis=1)[:, None]) / np.where(gap > 0, 2 * gap, np.inf)
        out[np.arange(len(x)), own] = 0
        return own, out

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and quantisation errors."""
        codes, error = np.empty((len(residuals), len(self.parts)), np.uint8), np.zeros(len(residuals))
        for m, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            codes[:, m] = nearest(residuals[:, p], book)
            error += ((residuals[:, p] - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def survivors(self, x: np.ndarray, codes: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which members (codes) have a table distance of at most most from each residual x."""
        distance = np.zeros((len(x), len(codes)), np.float32)
        for m, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            part = x[:, p]
            table = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            distance += np.take(table, codes[:, m], axis=1)
        return distance <= most**2 + 1e-5


def vector_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of rows (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-dups")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumns({"hi": F.when(sound, F.xxhash64("v", F.size("v"))), "lo": F.when(sound, F.xxhash64(F.lit(1), "v"))})
    rows = scratch.table(rows, "rows")
    classes = rows.filter("hi is not null").groupBy("hi", "lo").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    classes = scratch.table(classes, "classes")
    heads = rows.join(classes.select("hi", "lo", "id", "weight"), ["hi", "lo"]).filter("vec_id = id").dropDuplicates(["hi", "lo"])
    heads = scratch.table(heads.select("id", "weight", "v", F.size("v").alias("dim")), "heads")
    found = []
    for dim, total in heads.groupBy("dim").count().collect():  # a row a dimension
        found.append(_links(scratch, heads.filter(F.col("dim") == dim), dim, total, cosine))
    links = found[0] if found else spark.createDataFrame([], LINKS)
    for more in found[1:]:
        links = links.unionByName(more)
    links = scratch.table(links, "links")
    sums = links.groupBy("node").agg(F.sum("weight").alias("linked")).withColumnRenamed("node", "id")
    edges = links.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    groups = scratch.table(components(edges, scratch, "groups"), "members").withColumnRenamed("node", "id")
    known = scratch.table(classes.join(sums, "id", "left").join(groups, "id", "left"), "known")
    scratch.keep("rows", "known")
    out = rows.select("vec_id", "hi", "lo").join(known, ["hi", "lo"], "left")
    component = F.coalesce("component", "id", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("weight") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


LINKS = "node long, other long, weight long"
PLACED = "id long, weight long, list int, probes array<int>, code binary, error double, half binary, unit binary"
KEYS = ["list", "line", "column"]


def fitted(heads: DataFrame, dim: int, total: int, cosine: float) -> Quantiser:
    """A quantiser fitted on a sample that a hash chooses."""
    size = max(LEAST_SAMPLE, min(MOST_SAMPLE, LIST_SAMPLE * math.isqrt(total)))
    dice = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = heads.filter(dice < min(1.0, 1.2 * size / total)).select("v").limit(size).toPandas()
    sample = unit(sample["v"], dim) if len(sample) else np.eye(1, dim)
    return Quantiser(sample, min(math.isqrt(total), max(1, len(sample) // LIST_SAMPLE)), cosine)


def unit(vectors: pd.Series, dim: int) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _links(scratch: Scratch, heads: DataFrame, dim: int, total: int, cosine: float) -> DataFrame:
    """Rows (node, weight of the classes linked) and (node, smaller node of its local component)."""
    reach = math.sqrt(2 - 2 * cosine) + HALF + 1e-6
    shared = scratch.spark.sparkContext.broadcast(fitted(heads, dim, total, cosine))  # bounded: a vector a list, CODES * dim numbers

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quantiser = shared.value
        for batch in batches:
            for i in range(0, len(batch), 2048):
                some = batch.iloc[i : i + 2048]
                x = unit(some["v"], dim)
                own, planes = quantiser.planes(x)
                codes, error = quantiser.encode(x - quantiser.centroids[own])
                probes = [np.flatnonzero(p) for p in planes <= quantiser.margin]
                yield pd.DataFrame({"id": some["id"].array, "weight": some["weight"].array, "list": own, "probes": probes, "code": [c.tobytes() for c in codes], "error": error, "half": [h.tobytes() for h in x.astype(np.float16)], "unit": [r.tobytes() for r in x]})

    placed = scratch.table(heads.select("id", "weight", "v").mapInPandas(place, PLACED), f"placed-{dim}")
    asked = placed.select("id", "half", F.explode("probes").alias("list"))
    # a row a list: bounded like the quantiser
    members = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("columns"))
    queries = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("lines"))
    blocks = F.broadcast(scratch.table(members.join(queries, "list"), f"blocks-{dim}"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = placed.join(blocks, "list").select("list", "id", "code", "error", part("columns").alias("column"), every("lines").alias("line"))
    asked = asked.join(blocks, "list").select("list", "id", "half", part("lines").alias("line"), every("columns").alias("column"))

    def near(key: tuple, xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        """The ids on both sides that a table distance leaves."""
        quantiser, left, right = shared.value, np.zeros(len(xs), bool), np.zeros(len(ys), bool)
        if len(xs) and len(ys):
            x_ids, y_ids, most = xs["id"].to_numpy(), ys["id"].to_numpy(), (reach + ys["error"].to_numpy()).astype(np.float32)
            codes = np.frombuffer(b"".join(ys["code"]), np.uint8).reshape(len(ys), -1)
            x = np.frombuffer(b"".join(xs["half"]), np.float16).reshape(len(xs), dim).astype(np.float32) - quantiser.centroids[key[0]].astype(np.float32)
            for i in range(0, len(xs), 256):
                met = quantiser.survivors(x[i : i + 256], codes, most) & (x_ids[i : i + 256, None] != y_ids)
                left[i : i + 256], right = met.any(axis=1), right | met.any(axis=0)
        out = pd.concat([xs.loc[left, ["id"]].assign(asks=True), ys.loc[right, ["id"]].assign(asks=False)])
        return out.assign(list=key[0], line=key[1], column=key[2])[[*KEYS, "asks", "id"]]

    base = base.toDF(*base.columns)
    met = asked.groupBy(*KEYS).cogroup(base.groupBy(*KEYS)).applyInPandas(near, "list int, line int, column int, asks boolean, id long")
    met = scratch.table(met, f"met-{dim}").join(placed.select("id", "weight", F.col("list").alias("home"), "probes", "unit"), "id")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        xs, ys = rows[rows["asks"]], rows[~rows["asks"]]
        x_ids, y_ids, x_weight, y_weight = (side[c].to_numpy() for c in ("id", "weight") for side in (xs, ys))
        x, y = (np.frombuffer(b"".join(side["unit"]), np.float64).reshape(len(side), dim) for side in (xs, ys))
        home, lists = xs["home"].to_numpy(np.int64), len(shared.value.centroids)
        probed = np.array([k * lists + p for k, ps in enumerate(ys["probes"]) for p in ps], np.int64)
        x_sum, y_sum = np.zeros(len(xs), np.int64), np.zeros(len(ys), np.int64)
        larger, smaller = np.empty(0, np.int64), np.empty(0, np.int64)
        for i in range(0, len(xs), 512):
            about = x[i : i + 512] @ y.T
            q, m = np.nonzero(about >= cosine - 1e-9)
            close = np.flatnonzero(about[q, m] < cosine + 1e-9)  # sums in one order decide
            keep = x_ids[i + q] != y_ids[m]
            keep[close] &= np.einsum("ij,ij->i", x[i + q[close]], y[m[close]]) >= cosine
            q, m = i + q[keep], m[keep]
            np.add.at(x_sum, q, y_weight[m])
            alone = ~np.isin(m * lists + home[q], probed)  # y doesn't probe the list of x, so no other block counts the pair for y
            np.add.at(y_sum, m[alone], x_weight[q[alone]])
            larger, smaller = stars(np.concatenate([larger, x_ids[q]]), np.concatenate([smaller, y_ids[m]]))
        sums, ids = np.concatenate([x_sum, y_sum]), np.concatenate([x_ids, y_ids])
        counts = pd.DataFrame({"node": ids[sums > 0], "other": pd.NA, "weight": sums[sums > 0]})
        return pd.concat([counts, pd.DataFrame({"node": larger, "other": smaller, "weight": 0})])

    return met.groupBy(*KEYS).applyInPandas(compare, LINKS)


def op8_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(read(spark, sf_dir, "embeddings"))
