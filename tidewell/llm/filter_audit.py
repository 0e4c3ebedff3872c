"""Operator 11: how filters of a corpus interact, in every order, from one mask a document.

A document's mask has a bit for each filter that it fails. Documents are counted by part and mask, which is all
that the audit needs. A part's removal polynomial is the multilinear extension of "documents that the filters of
a set remove": a mask m that n documents have adds n * (1 - product of (1 - x_i) over its filters). Its value at
the corner of a set is what that set removes, in whatever order; the steps of all orders are differences of such
corners. A filter's Shapley value is the integral of the polynomial's partial derivative along the diagonal, in
exact rationals; times the number of orders it is what the filter removes, summed over them.

Defined results: null text counts as empty, null source as the part ''. A copy is a text that a smaller doc_id
also has, whatever the part and whatever the other filters say; rows that repeat a doc_id are not smaller than
each other, and a null doc_id is neither smaller nor larger than any. A document is good (toxic) when any of its
labels says so; labels of no document, and null labels, change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, only, read

WORD = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter: under 50 words, few distinct words, many capitals, marks of code."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * F.lit(100).cast("long") > F.length(text) * F.lit(5).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def removal_polynomial(counts: dict[int, int]) -> dict[int, int]:
    """Coefficients by set of variables (a bit each) of the sum of n * (1 - product of (1 - x_i) over i in m)."""
    out: dict[int, int] = {}
    for mask, n in counts.items():
        some = mask
        while some:  # every set inside the mask but the empty one
            out[some] = out.get(some, 0) + (n if some.bit_count() % 2 else -n)
            some = (some - 1) & mask
    return out


def corners(polynomial: dict[int, int], n: int) -> list[int]:
    """The value at each corner: what each set of filters removes."""
    out = [0] * (1 << n)
    for variables, c in polynomial.items():
        out[variables] = c
    for i in range(n):  # sums over subsets, one variable after another
        for s in range(1 << n):
            if s >> i & 1:
                out[s] += out[s ^ 1 << i]
    return out


def shapley(polynomial: dict[int, int], i: int) -> Fraction:
    """The integral from 0 to 1 of the derivative by x_i at (t, ..., t): a set of k variables gives c * t^(k - 1), so c / k."""
    return sum((Fraction(c, s.bit_count()) for s, c in polynomial.items() if s >> i & 1), Fraction(0))


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
ARROW = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]])


def audit_rows(part: str, masks: list[dict], letters: str) -> Iterator[tuple]:
    """The rows of one part from its counts by mask (n, good, toxic)."""
    n, whole = len(letters), (1 << len(letters)) - 1
    total = sum(m["n"] for m in masks)
    polynomial = removal_polynomial({m["mask"]: m["n"] for m in masks})
    gone = corners(polynomial, n)
    good, toxic = (corners(removal_polynomial({m["mask"]: m[c] for m in masks}), n) for c in ("good", "toxic"))
    shares = [shapley(polynomial, i) * math.factorial(n) for i in range(n)]
    for order in itertools.permutations(range(n)):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            yield part, name, step, total - gone[after], removed, gone[1 << i] - removed, gone[whole] - gone[whole ^ 1 << i], good[after] - good[before], toxic[after] - toxic[before], int(shares[i])
            before = after


def mask_counts(docs: DataFrame, labels: DataFrame, copies: str = "E") -> tuple[DataFrame, str]:
    """part, masks (at most 2^filters structs of mask, n, good, toxic), and the letters of the bits; the copies' bit is last.

    Texts are read once, for a digest and the mask; the narrow rows are written, as two joins read them. Groups of copies
    and labels are aggregated before they meet, and both joins end in another exchange, so a hot side can be split.
    """
    scratch = Scratch(docs.sparkSession, "filter_audit")
    filters = text_filters(F.col("text"))
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    texts = only(docs, "doc_id", "text", "source").select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = scratch.table(texts.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask")), "rows")
    several = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    judged = only(labels, "doc_id", "quality", "toxic").filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    judged = judged.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("bad"))
    copied = F.when(F.col("first") < F.col("doc_id"), 1 << len(filters)).otherwise(0)
    each = rows.join(several, "digest", "left").select("doc_id", "part", (F.col("mask") + copied).alias("mask")).join(judged, "doc_id", "left")
    counts = each.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("good")).alias("good"), F.count_if(F.col("bad")).alias("toxic"))
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks")), "".join(filters) + copies


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a part, order of the filters and step."""
    masks, letters = mask_counts(docs, labels)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():  # a row a part
                made = zip(*audit_rows(r["part"], r["masks"], letters), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, ARROW, strict=True)], schema=ARROW)

    return masks.mapInArrow(run, AUDIT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_LETTERS = "ABCDE"
_PLACES = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate(_LETTERS))
OP11_SQL = rf"""WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failing AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM words),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES {_PLACES}) v(letter, bit)),
orders AS (SELECT [a.letter, b.letter, c.letter, d.letter, e.letter] AS l, [a.bit, b.bit, c.bit, d.bit, e.bit] AS b FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT array_to_string(l, '') AS filter_order, l[k] AS letter, k AS step, b[k] AS bit, CAST(coalesce(list_sum(b[1:k - 1]), 0) AS INT) AS before FROM orders, range(1, 6) t(k)),
sums AS (SELECT part, filter_order, step, letter, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant,
  sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & bit <> 0 AND mask & before = 0) AS good_lost, sum(bad) FILTER (mask & bit <> 0 AND mask & before = 0) AS toxic_lost FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM sums"""
