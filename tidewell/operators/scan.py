"""Prefix scans with carried state: running values and short frames over runs of any length.

A window by key sends all rows of a key to one task. Here rows are range-partitioned by key and order into stretches,
so that a key with half of all rows lies in many of them, and written once. A stretch works out its own part; one row a
stretch and key says what it hands on; these few rows alone are combined along each key, and each stretch gets back what
came before it. Frames of a bounded number of rows get the last rows of the stretches before, as a halo.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

STRETCH, HALO = "_stretch", "_halo"


class Scan:
    """rows in stretches by (keys, order). Order should be unique in a key: rows that tie stand in any order. Without keys all
    rows are one run. Null keys are a key like any other; an empty table gives empty results."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], stretches: int | None = None):
        n = stretches or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.keys, self.order, self.names = keys, order, rows.columns
        self.rows = written(rows.repartitionByRange(n, *[F.col(c) for c in (*keys, *order)]).withColumn(STRETCH, F.spark_partition_id()), "scan")

    def _own(self):
        """The rows of a key in a stretch."""
        return Window.partitionBy(STRETCH, *self.keys).orderBy(*self.order)

    def _along(self):
        """The stretches of a key, in order: a row each."""
        return Window.partitionBy(*[F.col(k) for k in self.keys] or [F.lit(0)]).orderBy(STRETCH)

    def _with(self, rows: DataFrame, facts: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
        """rows with columns of facts, a row a stretch and key."""
        f = facts.select(F.col(STRETCH).alias("_s"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], *columns)
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        return rows.join(f, reduce(Column.__and__, same, F.col(STRETCH) == F.col("_s")), how).drop("_s", *[f"_k{i}" for i in range(len(self.keys))])

    def running(self, facts: DataFrame | None = None, **values: tuple[str, Column]) -> DataFrame:
        """The rows with running values up to and with each: name=(kind, value), kind sum, min, max or last (the last value that
        isn't null). facts, a row a key, adds its columns on the way of the carried state, so that rows are not shuffled by key."""
        one = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
        total = {**one, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(*self.order)))}
        both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}
        rows = self.rows.withColumns({n: one[kind](v).over(self._own()) for n, (kind, v) in values.items()})
        ends = self.rows.groupBy(STRETCH, *self.keys).agg(*[total[kind](v).alias(f"_{n}") for n, (kind, v) in values.items()])
        earlier = self._along().rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumns({f"_{n}": one[kind](F.col(f"_{n}")).over(earlier) for n, (kind, _) in values.items()})
        more = [] if facts is None else [c for c in facts.columns if c not in self.keys]
        if facts is not None:
            known = facts.select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(self.keys)], *more)
            ends = ends.join(known, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_f{i}")) for i, k in enumerate(self.keys)]))
        out = self._with(rows, ends, [f"_{n}" for n in values] + more)
        return out.withColumns({n: both[kind](F.col(f"_{n}"), F.col(n)) for n, (kind, _) in values.items()}).select(*self.names, *values, *more)

    def streaks(self, holds: Column, name: str = "streak") -> DataFrame:
        """The rows with the length so far of the streak in which `holds` has been true."""
        rows = self.rows.withColumn("_holds", F.coalesce(holds, F.lit(False)))
        rows = rows.withColumn("_at", F.row_number().over(self._own()))
        rows = rows.withColumn("_break", F.max(F.when(~F.col("_holds"), F.col("_at"))).over(self._own()))
        ends = rows.groupBy(STRETCH, *self.keys).agg(F.max("_at").alias("_n"), F.max("_break").alias("_b"))
        # rows up to a stretch's end, and up to its last break: their difference is the streak that it hands on
        ends = ends.withColumn("_upto", F.sum("_n").over(self._along()))
        ends = ends.withColumn("_last", F.max(F.col("_upto") - F.col("_n") + F.col("_b")).over(self._along()))
        ends = ends.withColumn("_tail", F.col("_upto") - F.coalesce("_last", F.lit(0)))
        ends = ends.withColumn("_before", F.coalesce(F.lag("_tail").over(self._along()), F.lit(0)))
        out = self._with(rows, ends, ["_before"])
        return out.select(*self.names, F.coalesce(F.col("_at") - F.col("_break"), F.col("_at") + F.col("_before")).cast("long").alias(name))

    def with_halo(self, back: int) -> DataFrame:
        """The rows (_halo false) and, for each stretch and key, the `back` rows before it (_halo true). A stretch that has fewer
        rows of a key than that hands on those before them, too."""
        last = F.row_number().over(Window.partitionBy(STRETCH, *self.keys).orderBy(*[F.desc(c) for c in self.order]))
        tails = self.rows.withColumn("_k", last).filter(F.col("_k") <= back)
        sizes = tails.groupBy(STRETCH, *self.keys).agg(F.count(F.lit(1)).alias("_n"))
        near = F.collect_list(F.struct(STRETCH, "_n")).over(self._along().rowsBetween(-back, -1))  # at most `back` of them
        near = sizes.withColumn("_near", near).withColumn("_near", F.reverse("_near")).withColumnRenamed(STRETCH, "_to")
        near = near.select("_to", *self.keys, "_near", F.posexplode("_near").alias("_p", "_from"))
        taken = F.aggregate(F.slice("_near", 1, F.col("_p")), F.lit(0).cast("long"), lambda s, x: s + x["_n"])
        wanted = near.select(F.col(f"_from.{STRETCH}").alias(STRETCH), *self.keys, "_to", (F.lit(back) - taken).alias("_take")).filter("_take > 0")
        halo = self._with(tails, wanted, ["_to", "_take"]).filter(F.col("_k") <= F.col("_take"))
        halo = halo.select(*self.names, F.col("_to").alias(STRETCH), F.lit(True).alias(HALO))
        return self.rows.select(*self.names, STRETCH, F.lit(False).alias(HALO)).unionByName(halo)

    def framed(self, back: int, **values) -> DataFrame:
        """The rows with name=function(window), where window reaches at most `back` rows before: each function gets the window by
        stretch and key, in order, and sets its own rowsBetween."""
        rows = self.with_halo(back).withColumns({n: f(self._own()) for n, f in values.items()})
        return rows.filter(~F.col(HALO)).select(*self.names, *values)
