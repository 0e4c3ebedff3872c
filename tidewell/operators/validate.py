"""Validation with one reason for each exclusion, and what follows from it by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_meaningful

REASONS = ["unknown_date", "out_of_range", "campaign", "low_signal", "invalid", "irrelevant", "valid"]


def reason(first: Column, last: Column, relevant: Column | None = None) -> Column:
    """The first reason that applies, else valid."""
    out = (
        F.when(F.col("published_at").isNull(), "unknown_date")
        .when(~F.col("published_at").between(first, last), "out_of_range")
        .when(F.coalesce("is_campaign", F.lit(False)), "campaign")
        .when(F.coalesce("is_low_signal", F.lit(False)), "low_signal")
        .when(~is_meaningful(F.col("title")) | ~is_meaningful(F.col("original_text")), "invalid")
    )
    return (out if relevant is None else out.when(~relevant, "irrelevant")).otherwise("valid")


def exclusion_counts(judged: DataFrame) -> DataFrame:
    """A row a source with a count for each reason; zeros stay."""
    return judged.groupBy("source").agg(*[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])


def excluded_samples(judged: DataFrame, n: int = 20) -> DataFrame:
    """The first n excluded posts of each source by key: partial top-n before the shuffle (a row-number limit)."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy("seq"))
    return judged.filter("reason <> 'valid'").withColumn("rank", rank).filter(F.col("rank") <= n).select("source", "rank", "seq", "reason", "title")


def source_status(judged: DataFrame, sources: DataFrame) -> DataFrame:
    """State of each of sources(source): success with valid rows, else warning; counts are 0 where none came."""
    counts = judged.groupBy("source").agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if(F.col("reason") == "valid").alias("count"))
    state = F.when(F.col("count") > 0, "success").otherwise("warning")
    return sources.join(counts, "source", "left").na.fill(0, ["candidate_count", "count"]).withColumns({"state": state, "ok": F.col("count") > 0})
