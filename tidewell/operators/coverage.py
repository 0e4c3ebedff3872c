"""Streaks and stop rules over a log of rounds: gaps and islands per run, never over the whole log at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(log: DataFrame, run: str, order: str, holds: Column, width: int = 100_000) -> DataFrame:
    """log with the length so far of the streak in which `holds` has been true.

    A run of any length is cut into stretches of `width` of its whole-number order. Inside a stretch a window counts; a row a
    stretch says how its streak ends, and only these rows meet in one task a run.
    """
    marked = log.withColumns({"_holds": F.coalesce(holds, F.lit(False)), "_part": F.floor(F.col(order) / width)})
    w = Window.partitionBy(run, "_part").orderBy(order)
    marked = marked.withColumn("_island", F.sum(F.when(F.col("_holds"), 0).otherwise(1)).over(w))
    marked = marked.withColumn("_own", F.sum(F.col("_holds").cast("int")).over(Window.partitionBy(run, "_part", "_island").orderBy(order)))
    ends = marked.groupBy(run, "_part").agg(F.max("_island").alias("_breaks"), F.max_by("_own", order).alias("_tail"))
    before = Window.partitionBy(run).orderBy("_part")
    # rows of stretches: a stretch without a break hands on what came before it
    broken = F.sum(F.when(F.col("_breaks") > 0, 1).otherwise(0)).over(before)
    ends = ends.withColumn("_chain", broken)
    carry = F.sum("_tail").over(Window.partitionBy(run, "_chain").orderBy("_part"))
    ends = ends.withColumn("_carry", carry).withColumn("_before", F.coalesce(F.lag("_carry").over(before), F.lit(0)))
    out = marked.join(ends.select(run, "_part", "_before"), [run, "_part"])
    streak = F.when(F.col("_holds"), F.col("_own") + F.when(F.col("_island") == 0, F.col("_before")).otherwise(0)).otherwise(0)
    return out.withColumn("streak", streak.cast("long")).drop("_holds", "_part", "_island", "_own", "_before")


def rounds(log: DataFrame, run: str, key: str, order: str, number: str) -> DataFrame:
    """A row a run and round with its posts and how many of them were seen first in it."""
    first = log.groupBy(run, key).agg(F.min(order).alias("_first"))
    both = log.join(first, [run, key])
    return both.groupBy(run, number).agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col(order) == F.col("_first")).alias("new"))


def converged(per_round: DataFrame, run: str, number: str, least: int = 30, window: int = 10) -> DataFrame:
    """Whether so many rounds are over and the last ones brought nothing new. A run has a few hundred rounds at most, as its own
    stop rules end it; longer orders are for operators.scan."""
    w = Window.partitionBy(run).orderBy(number)
    recent = F.sum("new").over(w.rowsBetween(-(window - 1), 0))
    return per_round.withColumns({"rounds": F.row_number().over(w), "recent_new": recent}).withColumn("converged", (F.col("rounds") >= least) & (F.col("recent_new") == 0))


def state(links: Column, reported: Column, boundary: Column) -> Column:
    return F.when((reported > 0) & (links >= reported), "complete_public").when(boundary, "period_complete_public").otherwise("partial")


def nearest_previous(rows: DataFrame, group: str, order: str, value: Column, back: int) -> Column:
    """The last non-null value among so many rows before, for short groups (a page's lines, a run's rounds). Where a group may hold
    a good part of all rows, operators.scan has the same by Scan.framed()."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(-back, -1))


def board_complete(stop: Column, oldest: Column, old: Column, first: Column, least: int = 12) -> tuple[Column, Column]:
    """Whether a board was read to before the period, and why reading stopped: the boundary itself, or enough old posts."""
    by_posts = F.coalesce((oldest <= F.date_sub(first, 1)) & (old >= least), F.lit(False))
    reached = stop == "period_boundary_reached"
    return reached | by_posts, F.when(~reached & by_posts, F.concat(F.lit("period_boundary_by_old_posts:"), stop)).otherwise(stop)


def old_posts(log: DataFrame, run: str, date: str, first: Column) -> DataFrame:
    """A row a run: how many posts are from before the period, and the oldest date."""
    return log.groupBy(run).agg(F.count_if(F.col(date) < first).alias("old"), F.min(date).alias("oldest"))


def oldest_so_far(log: DataFrame, run: str, number: str, date: str) -> DataFrame:
    """A row a run and round with the oldest date up to it."""
    each = log.groupBy(run, number).agg(F.min(date).alias("_d"))
    return each.select(run, number, F.min("_d").over(Window.partitionBy(run).orderBy(number)).alias("oldest"))


def tail_boundary(log: DataFrame, run: str, number: str, order: str, date: str, boundary: Column, tail: int = 3, confirm: int = 2) -> DataFrame:
    """A row a run and round: whether the last `tail` dates of its list are all at or before the boundary, for how many rounds
    running, and whether that is enough. Only `tail` rows a round are kept."""
    last = F.row_number().over(Window.partitionBy(run, number).orderBy(F.desc(order)))
    rows = log.filter(F.col(date).isNotNull()).withColumn("_k", last).filter(F.col("_k") <= tail)
    ends = rows.groupBy(run, number).agg(((F.count(F.lit(1)) == tail) & (F.max(date) <= boundary)).alias("past"))
    return streaks(ends, run, number, F.col("past")).withColumn("reached", F.col("streak") >= confirm)


def scan_counters(log: DataFrame, board: str) -> DataFrame:
    """A row a board of log(candidate, verified_by: request, page or null, failed): what a scan has seen and checked."""
    return log.groupBy(board).agg(
        F.countDistinct("candidate").alias("candidate_count"), F.count_if(F.col("verified_by").isNotNull()).alias("detail_verified_count"), F.count_if("failed").alias("detail_failed_count"),
        F.count_if(F.col("verified_by") == "request").alias("request_verified_count"), F.count_if(F.col("verified_by") == "page").alias("detail_page_verified_count"),
    )
