"""Classification by a table of rules of any size: rules(label, alias, place) joined to texts, as claims by operators.rules.

An alias can only stand in a text that has all its q-grams, so each alias is filed under one of them, the one that stands
least often in all texts: an inverted index from q-grams to aliases. Q-grams are known by 64-bit hashes, worked out for many
texts at a time; a bitmap of those that are asked for lets only a text's few hits go on to the join with the index. What
meets is a candidate (hashes that collide only make more of them). A candidate's text must contain the alias, and what is
left is claimed text by text: per label longest first, ties by place, nothing twice. Aliases with a q-gram that no text has
are dropped early.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import fold
from ..scratch import written
from .rules import _joins

Q = 4
WHOLE = re.compile(r"[a-z0-9_+\- ]+")
#: Characters of texts that are hashed at a time (a longer text goes alone), and sums of q-grams that a task keeps.
PORTION, SUMS = 500_000, 250_000
#: Bits of the bitmap of q-grams, as a power of two: 2 MB, whatever the rules.
BITS, BITMAP = 24, 32_768
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each substring of `size` code points, by where it begins."""
    n = max(0, len(codes) - size + 1)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = (h ^ codes[j : j + n]) * FACTORS[j % len(FACTORS)]
        h ^= h >> np.uint64(29)
    return h * FACTORS[0]


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts of rows with at most PORTION characters in all, or of one row."""
    for batch in batches:
        texts, begin, total = batch.column(1).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            if i > begin and total + len(t) > PORTION:
                yield batch.column(0).slice(begin, i - begin), texts[begin:i]
                begin, total = i, 0
            total += len(t)
        if begin < len(texts):
            yield batch.column(0).slice(begin), texts[begin:]


def _bitmap(grams: DataFrame) -> np.ndarray:
    """The bitmap of a table's hashes: 2^BITS bits at most go through the driver, and only as bitmaps that tasks have made."""
    slot = F.shiftrightunsigned("gram", 64 - BITS)
    parts = grams.select(F.floor(slot / BITMAP).cast("int").alias("part"), F.pmod(slot, F.lit(BITMAP)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in parts.collect():
        out[r["part"] * BITMAP // 8 :][: BITMAP // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _hits(texts: list[str], sizes: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each q-gram of the given sizes that is in the bitmap, as often as it stands there."""
    codes, rows = _codes(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    found = []
    for size in sizes:
        h = _hashes(codes, size)
        slot = h >> np.uint64(64 - BITS)
        at = np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
        at = at[rows[at] == rows[at + size - 1]]
        found.append((rows[at], h[at].view(np.int64)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _alias_grams(aliases: DataFrame, q: int) -> DataFrame:
    """alias, gram: the hashes of the substrings of q characters of each alias, or of all of it where it is shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for alias in batch.column(0).to_pylist():
                grams = np.unique(_hashes(_codes([alias]), min(len(alias), q)).view(np.int64))
                for i in range(0, len(grams), SUMS):
                    some = grams[i : i + SUMS]
                    yield pa.RecordBatch.from_arrays([pa.array([alias] * len(some)), pa.array(some)], ["alias", "gram"])

    return aliases.select("alias").distinct().mapInArrow(run, "alias string, gram long")


def _summed(texts: DataFrame, sizes: list[int], bits: Broadcast) -> DataFrame:
    """gram, n: how often the q-grams of the bitmap stand in the texts of each task; a gram may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], ["gram", "n"])
        for _, some in _portions(batches):
            here, times = np.unique(_hits(some, sizes, bits.value)[1], return_counts=True)
            both, place = np.unique(np.concatenate([grams, here]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, times]), len(both)).astype(np.int64)
            grams = both
            if len(grams) > SUMS:
                yield out()
                grams, n = grams[:0], n[:0]
        if len(grams):
            yield out()

    return texts.select("row", "t").mapInArrow(run, "gram long, n long")


def _met(texts: DataFrame, sizes: list[int], bits: Broadcast) -> DataFrame:
    """row, gram: the different q-grams of the bitmap that each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, some in _portions(batches):
            rows, h = _hits(some, sizes, bits.value)
            grams, place = np.unique(h, return_inverse=True)
            pairs = np.unique(rows * max(1, len(grams)) + place)
            if len(pairs):
                rows, place = np.divmod(pairs, len(grams))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(grams[place])], ["row", "gram"])

    return texts.select("row", "t").mapInArrow(run, "row long, gram long")


@F.pandas_udf(ArrayType(StructType([StructField("label", StringType()), StructField("n", IntegerType())])))
def _claims(texts: pd.Series, found: pd.Series) -> pd.Series:
    def one(text: str, aliases) -> list[tuple[str, int]]:
        by: dict[str, list] = {}
        for a in aliases:
            by.setdefault(a["label"], []).append((-len(a["alias"]), a["place"], a["alias"]))
        out = []
        for label, some in by.items():
            taken, n = bytearray(len(text)), 0
            for size, _, alias in sorted(some):
                whole, at = WHOLE.fullmatch(alias), text.find(alias)
                while at >= 0:
                    end = at - size
                    if not (whole and (_joins(text, at - 1) or _joins(text, end))) and not any(taken[at:end]):
                        taken[at:end] = b"\1" * -size
                        n += 1
                    at = text.find(alias, at + 1)
            if n:
                out.append((label, n))
        return out

    return pd.Series([one(t, f) for t, f in zip(texts, found, strict=True)])


def rule_table_counts(posts: DataFrame, rules: DataFrame, key: str, text: Column, q: int = Q) -> DataFrame:
    """key, label, n: the claims of each label in each post that has any. Rules without a label or alias go; an alias that a label
    has twice counts once, at its first place. Null texts, empty tables: no rows. Repeated keys are posts of their own."""
    texts = written(posts.select(F.col(key), fold(text).alias("t")).filter("t <> ''").withColumn("row", F.monotonically_increasing_id()), "rule-texts")
    aliases = rules.select("label", fold("alias").alias("alias"), "place").filter("label is not null and alias <> ''").groupBy("label", "alias").agg(F.min("place").alias("place"))
    aliases = written(aliases.withColumn("size", F.least(F.length("alias"), F.lit(q))), "rule-aliases")
    sizes = sorted(r[0] for r in aliases.select("size").distinct().collect())  # at most q
    if not sizes:
        return posts.select(key).limit(0).withColumns({"label": F.lit("").cast("string"), "n": F.lit(0)})
    inside, context = written(_alias_grams(aliases, q), "rule-grams"), posts.sparkSession.sparkContext
    asked = context.broadcast(_bitmap(inside))
    counts = _summed(texts, sizes, asked).groupBy("gram").agg(F.sum("n").alias("n"))
    filed = inside.join(counts, "gram", "left").groupBy("alias").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    filed = written(filed.filter("g.n > 0").select(F.col("g.gram").alias("gram"), "alias"), "rule-index")
    met = _met(texts, sizes, context.broadcast(_bitmap(filed))).join(filed, "gram").select("row", "alias")
    held = met.join(texts, "row").filter(F.contains("t", F.col("alias")))  # a text's candidates lie together: no exchange for what follows
    ruled = aliases.select("label", "alias", "place")
    pairs = written(held.select("row", "alias"), "rule-pairs").join(ruled, "alias").groupBy("row").agg(F.collect_list(F.struct("label", "alias", "place")).alias("found"))
    return texts.join(pairs, "row").select(key, F.explode(_claims("t", "found")).alias("c")).select(key, "c.label", "c.n")
