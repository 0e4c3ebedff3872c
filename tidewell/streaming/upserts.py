"""Streams of sightings: the same merge in micro-batches, and daily counts with a watermark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import merged, upsert

BUCKETS = 64


class BucketStore:
    """The store in buckets of keys: root/<version>/bucket=<b>, and root/state-<version>.json, which says in which version each
    bucket was written last. A version rewrites the buckets it touches and no others; folders that neither of the two
    newest states names are removed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self.files.exists(self.path(self.root)):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(self.root))]
        return sorted(int(n[6:-5]) for n in names if n.startswith("state-") and n.endswith(".json"))

    def state(self, before: int | None = None) -> dict[str, int]:
        """Version by bucket, of the newest state (older than `before`)."""
        known = [v for v in self._versions() if before is None or v < before]
        if not known:
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/state-{known[-1]}.json").collect()))

    def read(self, state: dict[str, int], buckets: list[str] | None = None) -> DataFrame | None:
        paths = [f"{self.root}/{v}/bucket={b}" for b, v in state.items() if buckets is None or b in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, posts: DataFrame, state: dict[str, int], version: int, buckets: list[str]) -> None:
        posts.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{version}")
        now = state | dict.fromkeys(buckets, version)
        fresh, final = self.path(f"{self.root}/_state-{version}"), self.path(f"{self.root}/state-{version}.json")
        out = self.files.create(fresh, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        self.files.delete(final, False)
        self.files.rename(fresh, final)
        used = {*now.values(), *state.values()}
        for status in self.files.listStatus(self.path(self.root)):
            name = status.getPath().getName()
            if name.isdigit() and int(name) < version and int(name) not in used:
                self.files.delete(status.getPath(), True)


def upsert_stream(sightings: DataFrame, root: str, checkpoint: str, key: str = "post_key") -> StreamingQuery:
    """Merges each micro-batch into the BucketStore at root, as version <batch>. A batch that is run again after a failure
    starts from the state before it and gives the same table. Late posts are merged, never dropped."""

    def step(batch: DataFrame, number: int) -> None:
        store = BucketStore(batch.sparkSession, root)
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).persist()
        touched = [str(r[0]) for r in batch.select("bucket").distinct().collect()]  # at most BUCKETS
        if touched:
            state = store.state(number)
            known = store.read(state, touched)
            now = merged(batch, key) if known is None else upsert(known, batch.drop("bucket"), key).drop("change")
            bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
            store.write(now.drop("n_seen", "bucket").withColumn("bucket", bucket), state, number, touched)
        batch.unpersist()

    return sightings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, root: str) -> DataFrame | None:
    """The posts of the newest state."""
    store = BucketStore(spark, root)
    return store.read(store.state())


def daily_counts(posts: DataFrame, time: str, late: str = "2 days") -> DataFrame:
    """Posts a day and source of a stream; days close once the watermark has passed them."""
    return posts.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("day"), "source").count()
