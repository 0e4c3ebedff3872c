"""Operator 3: near-duplicate documents by a MinHash LSH forest.

1. A document's set of word shingles is hashed to 64 bits a shingle; documents of equal sets form a class,
   represented by its smallest doc_id, and only representatives go on (copies are never paired).
2. Each representative is put into several orders, sorted by different runs of its signature. Its
   candidates are the neighbours of longest common prefix: those at most `width` places before it that
   share the first value at least. Where few share it, that is the whole region, and where many do, only
   those with a deeper prefix are near: the depth adapts to each region. Orders are range-partitioned by the
   full prefix, so no region meets in one task; the ends of neighbouring partitions are compared apart.
3. Candidates that set sizes or a 256-bit sketch of the signature rule out go. The nearest candidate of smaller
   id of each document is confirmed on full sets; these links make groups. A second pass over the orders, of the documents with
   candidates alone, takes only those between different groups, drops those that cannot be similar enough by the counts of their
   shingles in 256 buckets (a bound, so no link is lost), and confirms all others. A link inside a
   group changes nothing, so it is neither written down nor checked.
4. Where candidates between two components failed and the larger has over half a window's documents, its
   region is too dense for neighbours to show every link: the smaller one's documents are compared with all
   of the larger one in blocks, and at most one link a document and block leaves a block.
5. Where more documents than a window holds share the first two values of an order, a window may miss links whatever
   the components' sizes. The first scan writes down all documents of such runs; where a run has several groups, its
   documents are compared in blocks, each pair in the first order that it shares two values in.
6. Components of confirmed links.

Defined results: a null text or one without words has an empty set and links with nothing; with fewer words
than a shingle the whole sequence is the only shingle; a null doc_id gets a null component and is kept;
rows of one doc_id count as one document for links, each with its own n_shingles; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, map_texts, partitions, read
from .tokens import Memo, held

HASHES, ORDERS, DEPTH = 128, 16, 20
#: Of 128 two-bit values a pair of similarity 0.8 differs in 19.2 on average, standard deviation 4.0.
MOST_DIFFERENT = 40
#: Bytes of a place that make a run: the order, its first value and 8 bits of the second. A pair of similarity 0.8
#: shares two values in none of the orders once in 13 million times.
RUN = 6
BROADCAST_IDS = 1_000_000


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes, and their signatures."""

    def __init__(self, words: int):
        import xxhash

        self.words = words
        self.memo = Memo(xxhash.xxh64_intdigest, 400_000)
        rng = np.random.default_rng(20)
        self.mul = rng.integers(0, 1 << 64, (HASHES, 1), np.uint64) | np.uint64(1)
        self.add = rng.integers(0, 1 << 64, (HASHES, 1), np.uint64)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def set_of(self, text: str | None) -> np.ndarray:
        parts = text.encode().lower().split() if text else []  # bytes: A-Z only, white space 20 and 09 to 0D only
        h = np.fromiter(map(self.memo.__getitem__, parts), np.uint64, len(parts))
        if not len(h):
            return h
        size = min(self.words, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = self._mix(out ^ h[k : len(h) - size + 1 + k])
        return np.unique(out)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(HASHES, 0xFFFFFFFF, np.uint64)
        for i in range(0, len(shingles), 4096):
            low = np.minimum(low, ((shingles[i : i + 4096] * self.mul + self.add) >> np.uint64(32)).min(axis=1))
        return low.astype(np.uint32)


    @staticmethod
    def buckets(shingles: np.ndarray) -> bytes | None:
        """How many shingles fall into each bucket; nothing if one holds more than a byte can say."""
        counts = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=256)
        return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def shingler(words: int) -> Shingler:
    return held(Shingler, words)


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, the set's digest (hi, lo) and its signature (null for an empty set)."""

    def make():
        s = shingler(words)

        def prints(texts):
            rows = []
            for text in texts:
                found = s.set_of(text)
                digest = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)
                rows.append((len(found), *digest.tolist(), s.signature(found).tobytes() if len(found) else None, s.buckets(found)))
            return tuple(zip(*rows, strict=True))

        return prints

    return map_texts(docs, make, "n_shingles long, hi long, lo long, signature binary, buckets binary")


def sketches(signature: np.ndarray) -> np.ndarray:
    """Two bits of each value, four words a document."""
    two = (signature & 3).astype(np.uint64).reshape(-1, HASHES // 32, 32) << (2 * np.arange(32, dtype=np.uint64))
    return np.bitwise_or.reduce(two, axis=2)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many values sketches differ."""
    z = x ^ y
    return np.bitwise_count((z | z >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)


def orders(classes: DataFrame) -> DataFrame:
    """A row for each representative (id, group, n_shingles, signature) and order: place (order and prefix), sketch, n, id, group."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            signature = np.frombuffer(b"".join(batch["signature"]), np.uint32).reshape(-1, HASHES)
            sketch = sketches(signature)
            for t in range(ORDERS):
                run = (t * (HASHES // ORDERS) + np.arange(DEPTH)) % HASHES
                first, rest = signature[:, run[:1]].astype(">u4"), signature[:, run[1:]].astype(np.uint8)
                yield pd.DataFrame({"place": [bytes((t,)) + f.tobytes() + r.tobytes() for f, r in zip(first, rest, strict=True)], "sketch": [s.tobytes() for s in sketch], "n": batch["n_shingles"], "id": batch["id"], "group": batch["group"], "buckets": batch["buckets"]})

    return classes.mapInPandas(make, "place binary, sketch binary, n int, id long, group long, buckets binary")


#: With apart = -1: no pair, but two groups a and b that have neighbours which cannot be similar enough.
PAIRS = "a long, b long, ca long, cb long, apart int"


class Neighbours:
    """Slides over rows in order of place and yields candidate pairs of different groups: all of them, a before b, or
    (nearest) only one b of each a, the nearest of smaller id or else the nearest. Links to smaller ids form trees, so a
    cloud of copies falls into few groups, where mutual nearest neighbours would leave many pairs."""

    def __init__(self, width: int, percent: int, nearest: bool):
        self.width, self.percent, self.nearest, self.tail = width, percent, nearest, None

    def pairs(self, batch: pd.DataFrame) -> pd.DataFrame:
        carried = 0 if self.tail is None else len(self.tail)
        rows = batch if self.tail is None else pd.concat([self.tail, batch], ignore_index=True)
        self.tail = rows.iloc[-self.width :]
        heads = np.frombuffer(b"".join(p[:5] for p in rows["place"]), np.uint8).reshape(-1, 5).astype(np.int64) @ (1 << 8 * np.arange(4, -1, -1))
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
        n, ids, group = (rows[c].to_numpy(np.int64) for c in ("n", "id", "group"))
        out = [np.empty((3, 0), np.int64)]
        for s in range(1, self.width + 1):
            i = np.arange(max(carried, s), len(rows))
            i = i[heads[i] == heads[i - s]]
            if not len(i):
                break
            small, large = np.minimum(n[i], n[i - s]), np.maximum(n[i], n[i - s])
            i = i[(100 * small >= self.percent * large) & (group[i] != group[i - s])]
            apart = differing(sketch[i], sketch[i - s])
            i, apart = i[apart <= MOST_DIFFERENT], apart[apart <= MOST_DIFFERENT]
            out.append(np.stack([i, i - s, apart]))
        x, y, apart = np.concatenate(out, axis=1)
        met = None
        if not self.nearest and len(x):
            possible = np.concatenate([self._possible(rows["buckets"], n, x[k : k + 8192], y[k : k + 8192]) for k in range(0, len(x), 8192)])
            met = np.unique(np.sort(np.stack([group[x[~possible]], group[y[~possible]]]), axis=0), axis=1)
            x, y, apart = x[possible], y[possible], apart[possible]
        if self.nearest:
            x, y, apart = np.r_[x, y], np.r_[y, x], np.r_[apart, apart]
            order = np.lexsort((ids[y], apart, ids[y] > ids[x], x))
            first = order[np.unique(x[order], return_index=True)[1]]
            x, y, apart = x[first], y[first], apart[first]
        else:
            x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
        found = pd.DataFrame({"a": ids[x], "b": ids[y], "ca": group[x], "cb": group[y], "apart": apart})
        if met is not None and met.size:
            found = pd.concat([found, pd.DataFrame({"a": met[0], "b": met[1], "ca": met[0], "cb": met[1], "apart": -1})])
        return found


    def _possible(self, buckets: pd.Series, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether sets can be similar enough: they share at most the smaller count of each bucket."""
        counts = lambda at: np.frombuffer(b"".join(buckets.iloc[k] or b"\xff" * 256 for k in at), np.uint8).reshape(-1, 256)
        shared = np.minimum(counts(x), counts(y)).sum(axis=1, dtype=np.int64)
        unknown = buckets.isna().to_numpy()
        return unknown[x] | unknown[y] | ((100 + self.percent) * shared >= self.percent * (n[x] + n[y]))


class Runs:
    """The rows (run, id) of the runs longer than width, and of the first and the last run of a partition, whose other rows
    may lie in the next one."""

    def __init__(self, width: int):
        self.width, self.first = width, True
        self.keys = self.ids = np.empty(0, np.int64)

    def rows(self, batch: pd.DataFrame) -> pd.DataFrame:
        heads = np.frombuffer(b"".join(p[:RUN] for p in batch["place"]), np.uint8).reshape(-1, RUN).astype(np.int64)
        keys = np.concatenate([self.keys, heads @ (1 << 8 * np.arange(RUN - 1, -1, -1))])
        ids = np.concatenate([self.ids, batch["id"].to_numpy(np.int64)])
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        given = sizes > self.width
        given[0] |= self.first
        given[-1] = False  # it may go on
        self.first &= len(starts) == 1
        self.keys, self.ids = keys[starts[-1] :], ids[starts[-1] :]
        given = np.repeat(given, sizes)
        return pd.DataFrame({"run": keys[given], "id": ids[given]})

    def rest(self) -> pd.DataFrame:
        return pd.DataFrame({"run": self.keys, "id": self.ids})


SCANNED = f"part int, last boolean, place binary, sketch binary, n int, id long, group long, buckets binary, run long, {PAIRS}"


def candidates(classes: DataFrame, scratch: Scratch, name: str, width: int, percent: int, nearest: bool) -> tuple[DataFrame, DataFrame]:
    """The candidates among representatives of different groups, as rows PAIRS (one pair may come from several orders), and
    (nearest) the rows run and id of all runs that may be longer than a window."""
    names = [f.strip().split(" ")[0] for f in SCANNED.split(",")]
    n = int(min(partitions(scratch.spark), classes.count() * ORDERS // 5000 + 1))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, part, first, runs = Neighbours(width, percent, nearest), TaskContext.get().partitionId(), [], Runs(width)
        for batch in batches:
            if len(batch):
                if sum(map(len, first)) < width:
                    first.append(batch.iloc[:width])
                yield near.pairs(batch).reindex(columns=names)
                if nearest:
                    yield runs.rows(batch).reindex(columns=names)
        if first:
            yield runs.rest().reindex(columns=names)
            yield pd.concat(first).iloc[:width].assign(part=part, last=False).reindex(columns=names)
            yield near.tail.assign(part=part, last=True).reindex(columns=names)

    scanned = scratch.table(orders(classes).repartitionByRange(n, "place").sortWithinPartitions("place", "id").mapInPandas(scan, SCANNED), name)
    ends = scanned.filter("part is not null").drop("run")
    parts = sorted(r[0] for r in ends.select("part").distinct().collect())  # a row a partition
    rank = F.create_map(*[F.lit(x) for k, p in enumerate(parts) for x in (p, k)]) if parts else F.lit(None)
    ends = ends.withColumn("border", (rank[F.col("part")] + F.when(F.col("last"), 0).otherwise(-1)).cast("int")) if parts else ends.withColumn("border", F.lit(0))

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["last", "place", "id"], ascending=[False, True, True])
        return Neighbours(2 * width, percent, nearest).pairs(rows[["place", "sketch", "n", "id", "group", "buckets"]].reset_index(drop=True))

    met = ends.select("border", "last", "place", "sketch", "n", "id", "group", "buckets").groupBy("border").applyInPandas(across, PAIRS)
    return scanned.filter("a is not null").select("a", "b", "ca", "cb", "apart").unionByName(met), scanned.filter("run is not null").select("run", "id")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int, several: bool = False) -> DataFrame:
    """id and set (binary) of the documents of ids(id), each set of an id once; `several`: a doc_id may have several rows."""
    if ids.count() <= BROADCAST_IDS:  # 8 MB; beyond, Spark joins by shuffle
        ids = F.broadcast(ids)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shingler(words)
        for batch in batches:
            yield pd.DataFrame({"id": batch["doc_id"], "set": [s.set_of(t).tobytes() for t in batch["text"]]})

    out = docs.join(ids, docs["doc_id"] == ids["id"], "left_semi").mapInPandas(make, "id long, set binary")
    return out.dropDuplicates(["id", "set"]) if several else out


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose full sets are similar enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.loc[keep, ["a", "b"]]

    one = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    return one.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y").mapInPandas(check, "a long, b long")


BLOCK = 512


def dense_links(opens: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of opens(c, d) (c's documents are few beside d's), at most one for each
    document of c and block of d."""
    few = opens.join(groups.withColumnRenamed("component", "c"), "c", "left").select("d", F.coalesce("node", "c").alias("id")).distinct()
    many = groups.withColumnRenamed("component", "d").withColumnRenamed("node", "id").join(opens.select("d").distinct(), "d", "left_semi")
    size = lambda df, name: df.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    blocks = size(few, "rows").join(size(many, "columns"), "d")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = few.join(blocks, "d").select("d", "id", part("rows").alias("row"), every("columns").alias("column")).join(sets, "id")
    many = many.join(blocks, "d").select("d", "id", part("columns").alias("column"), every("rows").alias("row")).join(sets, "id").toDF("id", "d", "column", "row", "set")

    def compare(xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(xs) and len(ys):
            each = [np.frombuffer(y, np.uint64) for y in ys["set"]]
            sizes, ids = np.array([len(y) for y in each]), ys["id"].to_numpy()
            values, owner = np.concatenate(each), np.repeat(np.arange(len(each)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for x, raw in zip(xs["id"], xs["set"], strict=True):
                x_set = np.frombuffer(raw, np.uint64)
                a, b = np.searchsorted(values, x_set, "left"), np.searchsorted(values, x_set, "right")
                met = np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
                shared = np.bincount(owner[met], minlength=len(each))
                linked = np.flatnonzero((100 * shared >= percent * (sizes + len(x_set) - shared)) & (ids != x))
                if len(linked):
                    y = int(ids[linked].min())
                    out.append((min(int(x), y), max(int(x), y)))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    keys = ["d", "row", "column"]
    return few.groupBy(*keys).cogroup(many.groupBy(*keys)).applyInPandas(compare, "a long, b long")


REGION = 2048


def several_groups(members: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """The members(run, id), with their groups, of runs of more than width documents and of more than one group."""
    placed = members.join(groups.toDF("id", "group"), "id", "left").withColumn("group", F.coalesce("group", "id"))
    runs = placed.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("low"), F.max("group").alias("high"))
    return placed.join(runs.filter((F.col("n") > width) & (F.col("low") < F.col("high"))).select("run"), "run", "left_semi").distinct()


def marks(classes: DataFrame) -> DataFrame:
    """id, n_shingles, sketch and the first two values of each order (8 bits of the second)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.arange(ORDERS) * (HASHES // ORDERS)
        for batch in batches:
            if len(batch):
                signature = np.frombuffer(b"".join(batch["signature"]), np.uint32).reshape(-1, HASHES)
                heads = signature[:, at].astype(np.uint64) << np.uint64(8) | (signature[:, at + 1] & 255).astype(np.uint64)
                yield pd.DataFrame({"id": batch["id"], "n": batch["n_shingles"], "sketch": [x.tobytes() for x in sketches(signature)], "heads": [x.tobytes() for x in heads]})

    return classes.select("id", "n_shingles", "signature").mapInPandas(make, "id long, n long, sketch binary, heads binary")


class Block:
    """The documents of a run that meet in a task, and which pairs are possible."""

    def __init__(self, run: int, percent: int, xs: pd.DataFrame, ys: pd.DataFrame):
        self.before, self.percent = run >> 8 * (RUN - 1), percent
        self.groups = np.concatenate([xs["group"].to_numpy(np.int64), ys["group"].to_numpy(np.int64)])
        self.gx, self.gy = self.groups[: len(xs)], self.groups[len(xs) :]  # views: a link makes two groups one
        whole = lambda v, k: np.frombuffer(b"".join(v), np.uint64).reshape(-1, k)
        (self.nx, self.sx, self.hx), (self.ny, self.sy, self.hy) = ((side["n"].to_numpy(np.int64), whole(side["sketch"], HASHES // 32), whole(side["heads"], ORDERS)) for side in (xs, ys))

    def possible(self, to: slice) -> np.ndarray:
        """Pairs that share two values in an earlier order have been met there."""
        nx, ny = self.nx[to, None], self.ny
        out = (self.gx[to, None] != self.gy) & (100 * np.minimum(nx, ny) >= self.percent * np.maximum(nx, ny))
        for t in range(self.before):
            out &= self.hx[to, t, None] != self.hy[:, t]
        i, j = np.nonzero(out)
        out[i, j] = differing(self.sx[to][i], self.sy[j]) <= MOST_DIFFERENT
        return out


BLOCK_KEYS, BLOCK_ROWS = ["run", "p", "q", "row", "column"], "run long, p string, q string, row int, column int, side boolean, id long, group long, n long, sketch binary, heads binary"
STEP = 64


def run_candidates(placed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The documents, block by block, that have a possible link to another group in a run of placed(run, id, group). A group of more
    than a block has blocks of its own, which are not compared with each other."""
    large = placed.groupBy("run", "group").count().filter(F.col("count") > REGION).select("run", "group", F.col("group").cast("string").alias("own"))
    placed = placed.join(large, ["run", "group"], "left").na.fill("", ["own"])
    blocks = placed.groupBy("run", "own").agg(F.ceil(F.count(F.lit(1)) / REGION).cast("int").alias("blocks"))
    meet = blocks.toDF("run", "p", "rows").join(blocks.toDF("run", "q", "columns"), "run").filter("p < q or p = '' and q = ''")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    data = placed.join(marks(classes), "id")
    xs = data.withColumnRenamed("own", "p").join(meet, ["run", "p"]).withColumn("row", part("rows"))
    xs = xs.withColumn("column", F.explode(F.sequence(F.when(F.col("q") == "", F.col("row")).otherwise(0), F.col("columns") - 1)))
    ys = data.withColumnRenamed("own", "q").join(meet, ["run", "q"]).withColumn("column", part("columns"))
    ys = ys.withColumn("row", F.explode(F.sequence(F.lit(0), F.when(F.col("q") == "", F.col("column")).otherwise(F.col("rows") - 1))))
    names = [*BLOCK_KEYS, "id", "group", "n", "sketch", "heads"]

    def meeting(key: tuple, xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        if not len(xs) or not len(ys):
            return pd.concat([xs, ys]).iloc[:0].assign(side=True)
        block, left, right = Block(int(key[0]), percent, xs, ys), np.zeros(len(xs), bool), np.zeros(len(ys), bool)
        for k in range(0, len(xs), STEP):
            possible = block.possible(slice(k, k + STEP))
            left[k : k + STEP], right = possible.any(axis=1), right | possible.any(axis=0)
        return pd.concat([xs[left].assign(side=True), ys[right].assign(side=False)])

    return xs.select(*names).groupBy(*BLOCK_KEYS).cogroup(ys.select(*names).toDF(*names).groupBy(*BLOCK_KEYS)).applyInPandas(meeting, BLOCK_ROWS)


def run_links(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different groups among the rows of run_candidates; a link that others of its block already make is not written down."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        xs, ys, out = rows[rows["side"]], rows[~rows["side"]], []
        if len(xs) and len(ys):
            block = Block(int(key[0]), percent, xs, ys)
            (x_sets, x_ids), (y_sets, y_ids) = (([np.frombuffer(v, np.uint64) for v in side["set"]], side["id"].tolist()) for side in (xs, ys))
            ny = np.array([len(v) for v in y_sets])
            values, owner = np.concatenate(y_sets), np.repeat(np.arange(len(y_sets)), ny)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for k in range(0, len(xs), STEP):
                possible = block.possible(slice(k, k + STEP))
                for x in k + np.flatnonzero(possible.any(axis=1)):
                    maybe = np.flatnonzero(possible[x - k] & (block.gy != block.gx[x]))
                    if not len(maybe):
                        continue
                    a, b = np.searchsorted(values, x_sets[x], "left"), np.searchsorted(values, x_sets[x], "right")
                    met = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())
                    shared = np.bincount(owner[met], minlength=len(y_sets))[maybe]
                    for y in maybe[100 * shared >= percent * (ny[maybe] + len(x_sets[x]) - shared)]:
                        if block.gy[y] != block.gx[x]:
                            block.groups[block.groups == block.gy[y]] = block.gx[x]
                            out.append((min(x_ids[x], y_ids[y]), max(x_ids[x], y_ids[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return found.join(sets, "id").groupBy(*BLOCK_KEYS).applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, width: int = 24) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of percent similarity), kept."""
    scratch = Scratch(docs.sparkSession, "near-dups")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    prints = scratch.table(fingerprints(docs, words), "prints")
    sets_of = prints.filter("n_shingles > 0 and doc_id is not null")
    held_ = F.struct("n_shingles", "signature", "buckets")
    classes = sets_of.groupBy("hi", "lo").agg(F.min("doc_id").alias("id"), F.first(held_).alias("s")).select("hi", "lo", "id", "s.*")
    classes = scratch.table(classes, "classes")  # a row a set: rows of one doc_id and text are one
    heads, classes = classes.select("hi", "lo", "id"), classes.select("id", "n_shingles", "signature", "buckets")
    several = not sets_of.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    alone = classes.withColumns({"group": F.col("id"), "buckets": F.lit(None).cast("binary")})  # the first pass does without
    nearest, members = candidates(alone, scratch, "scan-0", width, percent, nearest=True)
    nearest = nearest.groupBy("a").agg(F.min_by("b", F.struct(F.col("b") > F.col("a"), "apart", "b")).alias("b"))
    nearest = scratch.table(nearest, "nearest")
    ids = nearest.select(F.col("a").alias("id"))  # every document with a candidate
    sets = scratch.table(shingle_sets(docs, ids, words, several), "sets")
    pairs = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = scratch.table(confirmed(pairs, sets, percent), "links-0")
    groups = scratch.table(components(links, scratch, "groups-0"), "members-0")

    def with_links(found: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        found = scratch.table(found, f"links-{k}")
        if found.isEmpty():
            return links, groups
        more = links.unionByName(found)
        return more, scratch.table(components(more, scratch, f"groups-{k}"), f"members-{k}")

    some = classes.join(ids, "id", "left_semi").join(groups.toDF("id", "component"), "id", "left").withColumn("group", F.coalesce("component", "id"))
    rest = scratch.table(candidates(some, scratch, "scan-1", width, percent, nearest=False)[0].select("a", "b", "ca", "cb", (F.col("apart") >= 0).alias("possible")).distinct(), "rest")
    links, groups = with_links(confirmed(rest.filter("possible"), sets, percent), 1)
    size = groups.groupBy("component").count()
    name = lambda c, to: groups.toDF(c, to)
    opens = rest.select("ca", "cb").distinct().join(name("ca", "c"), "ca", "left").join(name("cb", "d"), "cb", "left").select(F.coalesce("c", "ca").alias("c"), F.coalesce("d", "cb").alias("d"))
    opens = opens.filter("c <> d").select(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).distinct().join(size.toDF("c", "nc"), "c", "left").join(size.toDF("d", "nd"), "d", "left").na.fill(1)
    swap = F.col("nc") > F.col("nd")
    opens = opens.filter(F.greatest("nc", "nd") > width // 2).select(F.when(swap, F.col("d")).otherwise(F.col("c")).alias("c"), F.when(swap, F.col("c")).otherwise(F.col("d")).alias("d"))
    opens = scratch.table(opens, "open-2")
    if not opens.isEmpty():
        links, groups = with_links(dense_links(opens, groups, sets, percent), 2)
    scratch.drop("sets", "scan-1", "rest")
    placed = scratch.table(several_groups(members, groups, width), "placed")
    if not placed.isEmpty():
        found = scratch.table(run_candidates(placed, classes, percent), "found")
        if not found.isEmpty():
            sets = scratch.table(shingle_sets(docs, found.select("id").distinct(), words, several), "sets-3")
            links, groups = with_links(run_links(found, sets, percent), 3)
            scratch.drop("sets-3")
        scratch.drop("found")
    scratch.drop("placed", "scan-0")
    rows = prints.select("doc_id", "n_shingles", "hi", "lo").join(heads, ["hi", "lo"], "left")
    rows = rows.withColumn("id", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("id"))).otherwise(F.col("doc_id")))
    rows = rows.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=2)
