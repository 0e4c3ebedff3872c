"""Connected components by local contraction, then alternating large-star and small-star steps (Kiveris et al., 2014).

Edges are dealt into tasks of about SHARE edges each, which replace their share by stars. Where that was more than
one task, star steps join the shares. Every step is an aggregate and a join on its written result, so that a node
with very many neighbours is split as a skewed join key; no component meets in one task or the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

SHARE = 200_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that isn't the smallest of its component, and the smallest."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task as stars."""
    rows = [batch for batch in batches if len(batch)]
    if rows:
        share = pd.concat(rows)
        a, b = stars(share["a"].to_numpy(), share["b"].to_numpy())
        yield pd.DataFrame({"a": a, "b": b})


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (the smallest node reachable) of each end of edges(a, b), once each."""
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    whole = scratch.table(edges.filter("a <> b").select(larger, smaller).distinct(), f"{name}-e")
    shares = max(1, math.ceil(whole.count() / SHARE))
    now = scratch.table(whole.repartition(shares).mapInPandas(_contract, "a long, b long"), f"{name}-0")
    mark, k = _mark(now) if shares > 1 else (0,), 0
    while mark[0]:
        k += 1
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-m{k}")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, f"{name}-l{k}")
        least = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-n{k}")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = scratch.table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-m{k}", f"{name}-l{k}", f"{name}-n{k}", f"{name}-{k - 1}")
        now, before = following, mark
        mark = _mark(now)
        if mark == before:
            break
    own = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
