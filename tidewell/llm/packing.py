"""Operator 9: best-fit packing by the linear grouping scheme.

Lengths are at most the capacity, so their histogram has a bounded number of entries however many
documents there are; only histograms reach the driver. The plan:

1. large lengths are rounded up to the largest of their group, groups having about equal numbers of pieces;
2. configurations of the few rounded sizes are chosen one after another: the largest size left, with the
   subset of what is left that fills the sequence best (a bounded subset sum), repeated as often as it goes;
3. actual pieces take the places of the rounded ones by their rank in their group;
4. small pieces, longest first, go into the tightest remaining gap that holds them, gaps being counted after
   step 3; what fits nowhere opens new sequences.

Ranks within a group, gap or length are made from counts per (key, salt), so no key is gathered in a task.

Defined results: null text counts as empty (the end id alone); a null doc_id and repeated rows are packed
like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, partitions, read
from .tokens import library_encoder, vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_COLUMNS = [f.split(" ")[0] for f in PIECES.split(", ")]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most capacity ids; the first of a cut document is the shorter one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, full = library_encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                some, rows = batch.slice(i, 2000), []
                for at, text in enumerate(some.column(1).to_pylist()):
                    ids = encode(text) + end
                    first = len(ids) % full or full
                    edges = [0, *range(first, len(ids) + 1, full)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):  # noqa: B905
                        rows.append((at, k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])))
                at, *columns = zip(*rows, strict=True)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], PIECES_COLUMNS)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def ranked(df: DataFrame, key: str, salt_of: list[Column | str], order: list[str], name: str) -> DataFrame:
    """df with each row's rank (from 0) among the rows of its key."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_of), F.lit(4 * partitions(df.sparkSession))).cast("int"))
    counts = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))  # bounded: 4 * partitions rows a key
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1
    return salted.withColumn("_local", local).join(offsets, [key, "_salt"]).withColumn(name, F.col("_before") + F.col("_local")).drop("_salt", "_local", "_before")


def rounding(counts: np.ndarray, small: int, groups: int) -> np.ndarray:
    """The rounded size of each length (0: small)."""
    size = np.zeros(len(counts), np.int64)
    lengths = np.flatnonzero(counts[small + 1 :]) + small + 1
    if len(lengths):
        share = np.cumsum(counts[lengths]) - counts[lengths]
        group = share * groups // counts[lengths].sum()
        for g in np.unique(group):
            size[lengths[group == g]] = lengths[group == g].max()
    return size


def configurations(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(how many of each size, how many such sequences)] for counts of sizes."""
    left, out, mask = dict(left), [], (1 << (capacity + 1)) - 1
    while left:
        sizes = sorted(left, reverse=True)
        first = sizes[0]
        room, reach, steps = capacity - first, 1, []
        for s in sizes:  # sums that fit beside the first, size by size
            for _ in range(min(left[s] - (s == first), room // s)):
                wider = (reach | reach << s) & mask & ((1 << (room + 1)) - 1)
                if wider == reach:
                    break
                steps.append((s, reach))
                reach = wider
            if reach >> room & 1:
                break
        best, chosen = reach.bit_length() - 1, defaultdict(int, {first: 1})
        for s, earlier in reversed(steps):
            if not earlier >> best & 1:
                chosen[s] += 1
                best -= s
        times = min(left[s] // n for s, n in chosen.items())
        out.append((dict(chosen), times))
        for s, n in chosen.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return out


def large_plan(counts: dict[int, int], capacity: int) -> tuple[pd.DataFrame, int]:
    """Rows (size, first rank, pieces in a sequence, first sequence, first slot); number of sequences."""
    rows, used, base = [], defaultdict(int), 0
    for config, times in configurations(counts, capacity):
        slot = 0
        for size, n in sorted(config.items(), reverse=True):
            rows.append((size, used[size], n, base, slot))
            used[size] += n * times
            slot += n
        base += times
    return pd.DataFrame(rows, columns=["size", "rank", "n", "sequence", "slot"], dtype=np.int64).sort_values(["size", "rank"]), base


def small_plan(lengths: dict[int, int], gaps: dict[int, int], capacity: int) -> pd.DataFrame:
    """Rows (length, first rank, gap class of the sequence or 0 if new, first rank there, offset)."""
    free: dict[int, deque] = defaultdict(deque, {g: deque([(g, 0, n)]) for g, n in gaps.items() if g and n})
    order, rows, opened = sorted(free), [], 0
    for length in sorted(lengths, reverse=True):
        n, rank = lengths[length], 0
        while n:
            at = bisect_left(order, length)
            if at == len(order):
                new = -(-n // (capacity // length))
                if capacity not in free:
                    order.append(capacity)
                free[capacity].append((0, opened, new))
                opened += new
                continue
            gap = order[at]
            kind, first, there = free[gap].popleft()
            take = min(n, there)
            rows.append((length, rank, kind, first, capacity - gap))
            if take < there:
                free[gap].appendleft((kind, first + take, there - take))
            if not free[gap]:
                del free[gap], order[at]
            if rest := gap - length:
                if rest not in free:
                    order.insert(bisect_left(order, rest), rest)
                free[rest].append((kind, first, take))
            n, rank = n - take, rank + take
    return pd.DataFrame(rows, columns=["length", "rank", "gap", "first", "offset"], dtype=np.int64).sort_values(["length", "rank"])


def looked_up(df: DataFrame, plan: pd.DataFrame, key: str, name: str) -> DataFrame:
    """df with the plan row whose key equals its key and whose rank is the last not above its rank, as name_*."""
    keys, ranks = plan[key].to_numpy(), plan["rank"].to_numpy()
    columns = [c for c in plan.columns if c not in (key, "rank")]
    starts = {int(k): (int(np.searchsorted(keys, k)), int(np.searchsorted(keys, k, "right"))) for k in np.unique(keys)}
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {name}_rank long, {', '.join(f'{name}_{c} long' for c in columns)}"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.zeros(batch.num_rows, np.int64)
            k, r = batch.column(key).to_numpy(), batch.column("rank").to_numpy()
            for one in np.unique(k):
                a, b = starts[int(one)]
                rows = k == one
                at[rows] = a + np.searchsorted(ranks[a:b], r[rows], "right") - 1
            found = [pa.array(v[at]) for v in (ranks, *(plan[c].to_numpy() for c in columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, f"{name}_rank", *(f"{name}_{c}" for c in columns)])

    return df.mapInArrow(look, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, small: int = 64, groups: int = 512) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    items = scratch.table(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():  # at most capacity rows
        counts[length] = n
    size = rounding(counts, small, groups)
    left: dict[int, int] = defaultdict(int)
    for length in np.flatnonzero(size):
        left[int(size[length])] += int(counts[length])
    plan, n_sequences = large_plan(left, capacity)

    size_of = F.array(*[F.lit(int(s)) for s in size])
    identity = ["doc_id", "piece", "start", "ids_crc32"]
    large = ranked(items.filter(F.col("length") > small).withColumn("size", F.get(size_of, F.col("length").cast("int"))), "size", identity, identity, "rank")
    within = F.col("rank") - F.col("at_rank")
    large = looked_up(large, plan, "size", "at").select(
        *PIECES_COLUMNS,
        (F.col("at_sequence") + F.floor(within / F.col("at_n"))).alias("sequence_id"),
        (F.col("at_slot") + within % F.col("at_n")).alias("_slot"),
    )
    earlier = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    large = large.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("_slot")
    large = scratch.table(large, "large")

    few = {int(n): int(counts[n]) for n in range(1, small + 1) if counts[n]}
    if not few:
        return large
    sequences = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).cast("long").alias("gap")).filter("gap > 0")
    sequences = scratch.table(sequences, "sequences")
    gaps = {int(g): int(n) for g, n in sequences.groupBy("gap").count().collect()}  # at most capacity rows
    places = small_plan(few, gaps, capacity)
    rest = ranked(items.filter(F.col("length") <= small), "length", identity, identity, "rank")
    rest = looked_up(rest, places, "length", "at").withColumn("_order", F.col("at_first") + F.col("rank") - F.col("at_rank"))
    fresh = rest.filter("at_gap = 0").withColumn("sequence_id", F.lit(n_sequences) + F.col("_order"))
    known = ranked(sequences, "gap", ["sequence_id"], ["sequence_id"], "_order").withColumnRenamed("gap", "at_gap")
    placed = rest.filter("at_gap > 0").join(known, ["at_gap", "_order"])
    columns = [*PIECES_COLUMNS, "sequence_id", F.col("at_offset").alias("offset")]
    return large.unionByName(fresh.select(*columns)).unionByName(placed.select(*columns))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)
