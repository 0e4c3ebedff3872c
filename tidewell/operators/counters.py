"""Validation counters that follow a store: each change adds and takes away, and any period is a sum over days.

Whether a post counts as campaign, low signal, invalid or irrelevant does not depend on the period; only unknown_date and
out_of_range do. So a summary holds the number of posts by source, day and lasting reason, and a period's counters come
from it alone. A change of a post takes one from where it was and adds one to where it is. Samples of what was
excluded are kept by source and day: the first keys, twice as many as are shown, so that posts can leave; a day
that ran short, and only such a day, is filled again from the store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_meaningful
from .validate import REASONS

CELL = ["source", "published_at"]
#: Reasons of the samples.
SAMPLED = ["campaign", "low_signal"]


def lasting_reason(relevant: Column | None = None) -> Column:
    """The first reason that applies whatever the period, else valid."""
    out = F.when(F.coalesce("is_campaign", F.lit(False)), "campaign").when(F.coalesce("is_low_signal", F.lit(False)), "low_signal").when(~is_meaningful(F.col("title")) | ~is_meaningful(F.col("original_text")), "invalid")
    return (out if relevant is None else out.when(~relevant, "irrelevant")).otherwise("valid")


def _sides(changes: DataFrame, key: str) -> DataFrame:
    """key, sign and the fields of each side of changes(key, before, now): -1 before, 1 now; of new rows only the latter."""
    sides = [changes.select(key, F.lit(sign).alias("sign"), f"{side}.*") for side, sign in (("before", -1), ("now", 1))]
    sides[0] = changes.filter("before is not null").select(key, F.lit(-1).alias("sign"), "before.*")
    return sides[0].unionByName(sides[1])


def judged_changes(changes: DataFrame, key: str = "post_key", relevant: Column | None = None) -> DataFrame:
    """key, sign, source, published_at (a date), reason, title, url of both sides of changes; sides that agree in all of these are
    left out. Write it: counters and samples both read it."""
    sides = _sides(changes, key).withColumn("reason", lasting_reason(relevant)).withColumn("published_at", F.col("published_at").cast("date"))
    names = ["source", "published_at", "reason", "title", "url"]
    return sides.groupBy(key, *names).agg(F.sum("sign").alias("sign")).filter("sign <> 0").select(key, "sign", *names)


def counted(summary: DataFrame | None, judged: DataFrame) -> DataFrame:
    """summary(source, published_at, reason, n) after signed rows; what has come down to zero goes."""
    added = judged.groupBy(*CELL, "reason").agg(F.sum("sign").alias("n"))
    both = added if summary is None else summary.unionByName(added)
    return both.groupBy(*CELL, "reason").agg(F.sum("n").alias("n")).filter("n <> 0")


def period_counts(summary: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row a source with a count for each reason in the period; zeros stay."""
    day = F.col("published_at")
    reason = F.when(day.isNull(), "unknown_date").when(~day.between(first, last), "out_of_range").otherwise(F.col("reason"))
    return summary.withColumn("reason", reason).groupBy("source").agg(*[F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("n"))), F.lit(0)).cast("long").alias(r) for r in REASONS])


def _first(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows of each cell by key, with whether these are all: n + 1 rows a cell and task go on."""
    rank = F.row_number().over(Window.partitionBy(*CELL).orderBy(key))
    few = rows.withColumn("_k", rank).filter(F.col("_k") <= n + 1)
    all_of = F.max("_k").over(Window.partitionBy(*CELL)) <= n
    return few.withColumn("complete", all_of).filter(F.col("_k") <= n).drop("_k")


def sampled(posts: DataFrame, key: str = "post_key", n: int = 20, relevant: Column | None = None) -> DataFrame:
    """Samples(source, published_at, key, reason, title, url, complete) of a whole store: 2 n a cell."""
    rows = posts.withColumn("published_at", F.col("published_at").cast("date")).withColumn("reason", lasting_reason(relevant))
    return _first(rows.filter(F.col("reason").isin(*SAMPLED)).select(*CELL, key, "reason", "title", "url"), key, 2 * n)


def resampled(samples: DataFrame, judged: DataFrame, store: DataFrame, key: str = "post_key", n: int = 20, relevant: Column | None = None) -> DataFrame:
    """Samples after signed rows. A cell that knows all its rows, or still has n, needs nothing else; the cells that ran short are
    read from store (after the changes), by a semi-join on source and day."""
    fields = F.struct("reason", "title", "url")
    changed = judged.filter(F.col("reason").isin(*SAMPLED))
    cells = changed.select(*CELL).distinct()
    same = lambda a, b: reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in CELL])
    untouched = samples.join(cells, same(samples, cells), "left_anti")
    kept = samples.join(cells, same(samples, cells), "left_semi")
    # a cell that doesn't know all rows knows them up to its last key
    floor = kept.groupBy(*CELL).agg(F.max(key).alias("_last"), F.min("complete").alias("_complete"))
    sides = kept.select(*CELL, key, fields.alias("x"), F.lit(1).alias("sign")).unionByName(changed.select(*CELL, key, fields.alias("x"), "sign"))
    now = sides.groupBy(*CELL, key, "x").agg(F.sum("sign").alias("sign")).filter("sign > 0").select(*CELL, key, "x.*")
    now = now.join(floor.withColumnsRenamed({c: f"_{c}" for c in CELL}), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CELL]), "left")
    within = now.filter(F.coalesce("_complete", F.lit(True)) | (F.col(key) <= F.col("_last")))
    sizes = within.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"))
    short = floor.filter("not _complete").alias("f").join(sizes.alias("s"), reduce(Column.__and__, [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in CELL]), "left").filter(F.coalesce("_n", F.lit(0)) < n).select(*[F.col(f"f.{c}").alias(c) for c in CELL])
    good = within.join(short, same(within, short), "left_anti")
    first = _first(good.select(*CELL, key, "reason", "title", "url", F.coalesce("_complete", F.lit(True)).alias("_all")), key, 2 * n)
    first = first.withColumn("complete", F.col("complete") & F.col("_all")).drop("_all")
    dated = store.withColumn("published_at", F.col("published_at").cast("date"))
    again = sampled(dated.join(short, same(dated, short), "left_semi"), key, n, relevant)
    return untouched.unionByName(first).unionByName(again)


def period_samples(samples: DataFrame, first: Column, last: Column, key: str = "post_key", n: int = 20) -> DataFrame:
    """source, rank, key, reason, title, url: the first n excluded posts of each source in a period, by key."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(key)).alias("rank")
    inside = samples.filter(F.col("published_at").between(first, last))
    return inside.select("source", rank, key, "reason", "title", "url").filter(F.col("rank") <= n)
