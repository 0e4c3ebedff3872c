"""Operator 12: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key, -ln(u) / weight, where u is a hash of its doc_id and text and the weight its
quality: sorted by key within a source, the documents are a weighted sample without replacement, however long a
prefix of them is taken. A source's target is spent on complete epochs first, a copy of every document each; what is
left is the budget of the fractional selection, the documents in order of key until their sizes add up to it. The
document at the edge is taken in part (its first words), so a source takes its target to the word.

Sources are filled like vessels of 2 times their size: a level times the weight each, what would run over being
shared among the others. Order and running sums go over stretches of (source, key) with carried state, so a source
with a third of all documents lies in many tasks.

Defined results: null text has size 0 and takes nothing; null source is a source, last in order; a document without a
quality, or with one that is null, NaN or not above 0, weighs 1; the largest of several qualities of a doc_id counts. Rows
that repeat a doc_id and text are documents of their own. An empty table, or one without words, takes nothing.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import Scan
from .shared import Scratch, only, read

WORD = r"[^\x20\x09-\x0D]+"


def level(sources: DataFrame, share: Fraction, most: int) -> Fraction:
    """The level at which min(most * size, level * weight) adds up to share of all sizes. Each round closes the vessels that
    the level of the last one fills and shares what they can't hold among the others; the level only rises."""
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    now, closed = Fraction(0), -1
    while True:
        full = F.col("size") * most <= F.col("weight") * float(now)
        n, size, weight = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == closed or not weight:
            return now
        now, closed = (share * total - most * size) / Fraction(weight), n


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 12) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole copies) and taken (words) of each document. weights go to the
    sources by code point, null last, and repeat; share is of all sizes; quality has doc_id and weight."""
    scratch = Scratch(docs.sparkSession, "mixing")
    d = only(docs, "doc_id", "text", "source").select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    each = d.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("hash"), (-F.log(u)).alias("key"))
    if quality is not None:
        q = only(quality, "doc_id", "weight").filter("doc_id is not null and weight > 0 and not isnan(weight)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("weight").cast("double")).alias("w"))
        each = each.join(q, "doc_id", "left").withColumn("key", F.col("key") / F.coalesce("w", F.lit(1.0))).drop("w")
    # the row number, fixed once written, parts rows that are alike in all else
    rows = Scan(each.withColumn("row", F.monotonically_increasing_id()), ["source"], ["key", "doc_id", "hash", "row"])
    sizes = scratch.table(rows.rows.groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    places = Scan(sizes.withColumn("last", F.col("source").isNull()), [], ["last", "source"]).running(place=("sum", F.lit(1)))
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = scratch.table(places.select("source", "size", F.get(cycle, ((F.col("place") - 1) % len(weights)).cast("int")).alias("weight")), "sources")
    target = F.least(F.col("size").cast("double") * most, F.col("weight") * float(level(sources, share, most)))
    facts = sources.select("source", F.col("size").alias("source_size"), target.alias("target"))
    words = F.round("target").cast("long")
    facts = facts.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long"))
    facts = facts.withColumn("budget", words - F.col("epochs") * F.col("source_size"))
    summed = rows.running(facts, upto=("sum", F.col("size")))
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("budget") - F.col("upto") + F.col("size")))
    return summed.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).alias("taken"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality from labels: a good document weighs 2, a bad one a half, one without a label 1."""
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5)
    quality = only(read(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", weight.alias("weight"))
    return mix(read(spark, sf_dir, "documents"), quality).select("doc_id", "size", "source_size", "target", "taken")
