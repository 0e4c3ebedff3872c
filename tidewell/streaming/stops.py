"""Stop rules as state in a stream: each run's counters follow its rounds, and the first rule that holds ends the run.

Rounds may come in any order and in any batches: a round that is ahead waits in the run's state until those before it are
there, so the result does not depend on where the stream is cut; rounds beyond the rules' most never count and never wait.
A run that has been idle for so long in event time, by the watermark, is forgotten and reported as such.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

#: A round: its time since the run began, what went wrong (null: nothing), its posts, how many of them were new, new in the
#: period, and how many at its end were old without a break; how far the list moved after it (null: unknown).
ROUND = "seconds double, error string, posts int, new int, period_new int, old_tail int, moved int"
#: A stop, after so many rounds. A round that was not read to its end doesn't count.
STOP = "run string, rounds int, stop_reason string"


@dataclass(frozen=True)
class Board:
    """Rules of a board that is scrolled, in order: time, enough old posts in a row, a list without new posts once its end
    was seen twice running, a failed scroll, the number of rounds."""

    most_rounds: int = 200
    seconds: float = 300.0
    old: int = 12
    stale: int = 6
    bottoms: int = 2

    def step(self, c: Counters, r: tuple) -> tuple[Counters, str | None]:
        seconds, error, posts, new, _, old_tail, moved = r
        if seconds > self.seconds:
            return c, "time_budget"
        c = replace(c, rounds=c.rounds + 1, old=c.old + posts if old_tail >= posts else old_tail, stale=0 if new else c.stale + 1)
        if c.old >= self.old:
            return c, "period_boundary_reached"
        if c.stale >= self.stale and c.bottoms >= self.bottoms:
            return c, "stable_list"
        if error is not None:
            return c, "scroll_failed"
        c = replace(c, bottoms=c.bottoms if moved is None else c.bottoms + 1 if moved == 0 else 0)
        return c, "max_scrolls" if c.rounds >= self.most_rounds else None


@dataclass(frozen=True)
class Feed:
    """Rules of a feed that is read by page, in order: time, a failed request, the second empty page running, pages without
    new posts of the period (empty ones neither count nor break the row), the number of pages."""

    most_rounds: int = 40
    seconds: float = 150.0
    empty: int = 2
    barren: int = 8

    def step(self, c: Counters, r: tuple) -> tuple[Counters, str | None]:
        seconds, error, posts, _, period_new, _, _ = r
        if seconds > self.seconds:
            return c, "time_budget"
        if error is not None:
            return c, error
        c = replace(c, rounds=c.rounds + 1, empty=0 if posts else c.empty + 1)
        if not posts:
            if c.empty >= self.empty:
                return c, "no_more_feeds"
        else:
            c = replace(c, barren=0 if period_new else c.barren + 1)
            if c.barren >= self.barren:
                return c, "period_boundary_reached"
        return c, "page_limit" if c.rounds >= self.most_rounds else None


@dataclass(frozen=True)
class Counters:
    rounds: int = 0
    old: int = 0
    stale: int = 0
    bottoms: int = 0
    empty: int = 0
    barren: int = 0
    stopped: bool = False


COUNTERS = "rounds int, old int, stale int, bottoms int, empty int, barren int, stopped boolean"
NAMES = [f.split(" ")[0] for f in ROUND.split(", ")]


class StopRules(StatefulProcessor):
    def __init__(self, rules: Board | Feed, idle_ms: int):
        self.rules, self.idle_ms = rules, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", COUNTERS)
        self.waiting = handle.getMapState("waiting", "round int", ROUND)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counters = Counters(*self.counters.get()) if self.counters.exists() else Counters()
        if counters.stopped:
            return
        latest, here = 0, {}
        for some in rows:
            latest = max(latest, int(some["at"].max().value // 1_000_000))
            # no run goes on after most_rounds, so later rounds never count: they needn't wait
            some = some[(some["round"] > counters.rounds) & (some["round"] <= self.rules.most_rounds)]
            for number, *r in some[["round", *NAMES]].itertuples(index=False):
                here.setdefault(int(number), tuple(_plain(x, n) for x, n in zip(r, NAMES, strict=True)))
        reason = None
        while reason is None:
            number = counters.rounds + 1
            if number in here:
                now = here.pop(number)
            elif self.waiting.containsKey((number,)):
                now = self.waiting.getValue((number,))
                self.waiting.removeKey((number,))
            else:
                break
            counters, reason = self.rules.step(counters, tuple(now))
        if reason is None:
            for number, r in here.items():
                if number > counters.rounds and not self.waiting.containsKey((number,)):
                    self.waiting.updateValue((number,), r)
        else:
            counters = replace(counters, stopped=True)
            self.waiting.clear()
            yield pd.DataFrame([(key[0], counters.rounds, reason)], columns=["run", "rounds", "stop_reason"])
        self.counters.update(astuple(counters))
        for t in list(self.handle.listTimers()):
            latest = max(latest, t - self.idle_ms)
            self.handle.deleteTimer(t)
        self.handle.registerTimer(latest + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        counters = Counters(*self.counters.get()) if self.counters.exists() else Counters()
        self.counters.clear()
        self.waiting.clear()
        if not counters.stopped:
            yield pd.DataFrame([(key[0], counters.rounds, "idle")], columns=["run", "rounds", "stop_reason"])

    def close(self) -> None:
        pass


def _plain(value, name: str):
    if pd.isna(value):
        return None
    return str(value) if name == "error" else float(value) if name == "seconds" else int(value)


def stops(log: DataFrame, rules: Board | Feed, idle: str = "2 days") -> DataFrame:
    """The stops (STOP) of a stream of rounds: run, round (1 and up), at (a timestamp) and the columns of ROUND. Of rounds that
    come twice the first counts; rounds after a stop are ignored until the run is idle. spark.sql.streaming.stateStore.
    providerClass must name the RocksDB provider."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = log.select("run", "round", "at", *NAMES).withWatermark("at", idle)
    return rows.groupBy("run").transformWithStateInPandas(StopRules(rules, ms), STOP, "Append", "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
