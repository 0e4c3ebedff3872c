"""Stop rules in a stream against a plain loop over each run, wherever the stream is cut."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.streaming.stops import NAMES, ROCKSDB, Board, Feed, StopRules, stops

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Many small jobs: two partitions are enough."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def plain_board(rounds, b):
    old = stale = bottoms = 0
    for n, (seconds, error, posts, new, _, tail, moved) in enumerate(rounds):
        if seconds > b.seconds:
            return n, "time_budget"
        old = old + posts if tail >= posts else tail
        stale = stale + 1 if new == 0 else 0
        if old >= b.old:
            return n + 1, "period_boundary_reached"
        if stale >= b.stale and bottoms >= b.bottoms:
            return n + 1, "stable_list"
        if error:
            return n + 1, "scroll_failed"
        if moved is not None:
            bottoms = bottoms + 1 if moved == 0 else 0
        if n + 1 == b.most_rounds:
            return n + 1, "max_scrolls"
    return None


def plain_feed(pages, f):
    empty = barren = 0
    for n, (seconds, error, posts, _, period_new, _, _) in enumerate(pages):
        if seconds > f.seconds or error:
            return n, error if seconds <= f.seconds else "time_budget"
        if not posts:
            empty += 1
            if empty == f.empty:
                return n + 1, "no_more_feeds"
        else:
            empty, barren = 0, 0 if period_new else barren + 1
            if barren == f.barren:
                return n + 1, "period_boundary_reached"
        if n + 1 == f.most_rounds:
            return n + 1, "page_limit"
    return None


def random_log(seed, kind):
    r, log = random.Random(seed), []
    for run in range(60):
        quiet = r.random()
        for n in range(1, r.randrange(2, 26)):
            posts = 0 if r.random() < 0.15 else r.randrange(1, 5)
            error = (r.choice(["http_error", "bad_payload"]) if kind == "feed" else "x") if r.random() < 0.03 else None
            row = (float(n * r.choice([1, 1, 1, 1, 1, 40])), error, posts, r.randrange(posts + 1) if r.random() > quiet else 0, int(r.random() > quiet), r.randrange(posts + 1) if r.random() < 0.5 else posts, r.choice([0, 0, 5, None]))
            log.append((f"r{run}", n, DAY + datetime.timedelta(minutes=n), *row))
    return log


@pytest.mark.parametrize("kind", ["board", "feed"])
def test_stops_do_not_depend_on_the_cut(spark, tmp_path, kind):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rules, plain = (Board(most_rounds=12, old=8, stale=4, bottoms=1), plain_board) if kind == "board" else (Feed(most_rounds=12, barren=4), plain_feed)
    log = random_log(7, kind)
    want = {}
    for run in {x[0] for x in log}:
        if found := plain([x[3:] for x in sorted(log) if x[0] == run], rules):
            want[run] = found
    assert len({r for _, r in want.values()}) >= 4, want
    schema = "run string, round int, at timestamp, seconds double, error string, posts int, new int, period_new int, old_tail int, moved int"
    for cut, shuffled in ((1, False), (3, True)):
        at = tmp_path / f"{kind}{cut}"
        rows = log[:]
        if shuffled:
            random.Random(1).shuffle(rows)
        for k in range(cut):
            spark.createDataFrame(rows[k::cut], schema).coalesce(1).write.parquet(f"{at}/in/{k}")
        half = max(1, cut // 2)
        for part in (half, cut):  # the second query goes on from the first one's checkpoint
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/{{{','.join(str(k) for k in range(cut))}}}" if cut > 1 else f"{at}/in/0")
            query = stops(source, rules, "100 days").writeStream.format("parquet").option("checkpointLocation", f"{at}/check").option("path", f"{at}/out").trigger(availableNow=True).start()
            query.awaitTermination(240)
            assert query.exception() is None
            if part == half and cut > 1:
                again = spark.createDataFrame(rows[:5], schema)  # rounds that come twice change nothing
                again.coalesce(1).write.mode("append").parquet(f"{at}/in/0")
        got = {r["run"]: (r["rounds"], r["stop_reason"]) for r in spark.read.parquet(f"{at}/out").collect()}
        assert got == want
    assert NAMES[0] == "seconds"


def test_idle_runs_are_forgotten(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = "run string, round int, at timestamp, seconds double, error string, posts int, new int, period_new int, old_tail int, moved int"
    late = DAY + datetime.timedelta(days=9)
    row = (1.0, None, 3, 1, 1, 0, 5)
    for k, rows in enumerate([[("a", 1, DAY, *row), ("a", 3, DAY, *row)], [("b", 1, late, *row)], [("b", 2, late, *row)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = stops(source, Board(), "1 day").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(F.col("run"), "rounds", "stop_reason").collect()] == [("a", 1, "idle")]


class Held:
    """A handle with its states in memory."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, []
        self.getValueState = self.getMapState = lambda *_: self
        self.exists, self.get, self.listTimers = lambda: self.value is not None, lambda: self.value, lambda: self.timers
        self.containsKey, self.getValue, self.removeKey, self.updateValue = self.map.__contains__, self.map.get, self.map.pop, self.map.__setitem__
        self.update, self.clear = lambda v: setattr(self, "value", v), self.map.clear
        self.deleteTimer, self.registerTimer = self.timers.remove, self.timers.append


def test_rounds_that_cannot_count_do_not_wait():
    rules, held = StopRules(Board(most_rounds=5, old=99, stale=99), 1000), Held()
    rules.init(held)
    rows = lambda *numbers: pd.DataFrame([(n, pd.Timestamp(DAY), 1.0, None, 1, 1, 0, 0, 7) for n in numbers], columns=["round", "at", *NAMES])
    assert list(rules.handleInputRows(("r",), iter([rows(*range(3, 1000))]), None)) == [] and sorted(k[0] for k in held.map) == [3, 4, 5]
    (stop,) = rules.handleInputRows(("r",), iter([rows(2, 1, 7)]), None)
    assert stop.values.tolist() == [["r", 5, "max_scrolls"]] and not held.map
    assert list(rules.handleInputRows(("r",), iter([rows(6)]), None)) == []
