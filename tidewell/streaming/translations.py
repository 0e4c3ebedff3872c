"""Pending translations as a stream: each micro-batch sends what no earlier one has translated, once.

What a batch has done lies in outcome/batch=<number>, written in one go: a row a chunk with its lane, request, result and how
many requests of the lane had failed in a row after it. A batch whose outcome is complete is not run again, so nothing is
sent twice after a restart. Chunks without a result stay pending and come along with the next batch. A lane stops after so
many failures in a row, and stays stopped for the rest of the run, over batches; the next run begins anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

OUTCOME = "run string, lane int, request int, chunk string, translated string, failed int"


def requests(sizes: list[int], most: int, chars: int) -> list[int]:
    """The request of each chunk, in order: a request takes chunks until it has `most`, or the next would bring it over `chars`."""
    out, number, items, total = [], 0, 0, 0
    for n in sizes:
        if items and (items >= most or total + n > chars):
            number, items, total = number + 1, 0, 0
        items, total = items + 1, total + n
        out.append(number)
    return out


class TranslationQueue:
    """The state under root. Lanes bound how many requests run at a time; a lane's chunks are in order of arrival."""

    def __init__(self, spark: SparkSession, root: str, send: Callable[[list[str]], list[str | None]], run: str, lanes: int = 8, most: int = 8, chars: int = 1200, failures: int = 8):
        self.spark, self.root, self.send, self.run = spark, root.rstrip("/"), send, run
        self.lanes, self.most, self.chars, self.failures = lanes, most, chars, failures

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def outcome(self, before: int | None = None) -> DataFrame:
        """batch and OUTCOME of all finished batches (before a number)."""
        if not self._exists(f"{self.root}/outcome"):
            return self.spark.createDataFrame([], f"{OUTCOME}, batch int")
        done = self.spark.read.schema(f"{OUTCOME}, batch int").parquet(f"{self.root}/outcome")
        return done if before is None else done.filter(F.col("batch") < before)

    def cache(self, before: int | None = None) -> DataFrame:
        """chunk, translated: one row a chunk, as a chunk is sent until it has a result and never after."""
        return self.outcome(before).filter("translated is not null").select("chunk", "translated")

    def step(self, batch: DataFrame, number: int) -> None:
        """Translates the pending chunks of batch(chunk, seq, pos), and those that earlier batches left."""
        path = f"{self.root}/outcome/batch={number}"
        if self._exists(f"{path}/_SUCCESS"):
            return
        earlier = self.outcome(number)
        left = earlier.filter("translated is null").select("chunk", F.lit(-1).cast("long").alias("seq"), F.lit(-1).alias("pos"))
        asked = batch.select("chunk", F.col("seq").cast("long"), F.col("pos").cast("int")).unionByName(left).filter(F.trim(F.coalesce("chunk", F.lit(""))) != "")
        # chunks are known by their SHA-256, so what is in the cache is moved as 32 bytes each
        digest = F.unhex(F.sha2("chunk", 256)).alias("digest")
        first = asked.groupBy(digest).agg(F.any_value("chunk").alias("chunk"), F.min(F.struct("seq", "pos")).alias("at"))
        lane = F.pmod(F.xxhash64("chunk"), F.lit(self.lanes)).cast("int")
        pending = first.join(self.cache(number).select(digest), "digest", "left_anti").select("chunk", "at", lane.alias("lane"))
        state = earlier.filter(F.col("run") == self.run).groupBy("lane").agg(F.max_by("failed", F.struct("batch", "request")).alias("failed"))  # a row a lane
        rows = pending.join(F.broadcast(state), "lane", "left").select("lane", "at", "chunk", F.coalesce("failed", F.lit(0)).alias("failed"))
        rows = rows.repartition(self.lanes, "lane").sortWithinPartitions("lane", "at", "chunk").select("lane", "chunk", "failed")
        rows.mapInPandas(self._sender(), OUTCOME).write.mode("overwrite").parquet(path)

    def _sender(self):
        send, run_name, most, chars, failures = self.send, self.run, self.most, self.chars, self.failures

        class Lane:
            def __init__(self, number: int, failed: int):
                self.number, self.failed, self.request, self.queue, self.total = number, failed, 0, [], 0

            def add(self, chunk: str) -> list[tuple]:
                full = self.queue and (len(self.queue) >= most or self.total + len(chunk) > chars)
                done = self.flush() if full else []
                self.queue.append(chunk)
                self.total += len(chunk)
                return done

            def flush(self) -> list[tuple]:
                if not self.queue:
                    return []
                queue, self.queue, self.total = self.queue, [], 0
                if self.failed >= failures:  # stopped: nothing is sent
                    return [(run_name, self.number, None, c, None, self.failed) for c in queue]
                try:
                    found = [t.strip() if t else "" for t in send(queue)]
                except Exception:  # noqa: BLE001  a failed request, whatever went wrong
                    found = []
                found = (found + [""] * len(queue))[: len(queue)]
                self.failed = 0 if any(found) else self.failed + 1
                self.request += 1
                return [(run_name, self.number, self.request, c, t or None, self.failed) for c, t in zip(queue, found, strict=True)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lane, names = None, [c.split(" ")[0] for c in OUTCOME.split(", ")]
            frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"request": "Int32"})
            for batch in batches:
                out = []
                for number, chunk, failed in batch.itertuples(index=False):
                    if lane is None or lane.number != number:
                        out += lane.flush() if lane else []
                        lane = Lane(int(number), int(failed))
                    out += lane.add(chunk)
                if out:
                    yield frame(out)
            if lane and (rest := lane.flush()):
                yield frame(rest)

        return run

    def start(self, chunks: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs over a stream of chunks(chunk, seq, pos) until all that is there has been read."""
        return chunks.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
