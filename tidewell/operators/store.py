"""The keyed store: repeated sightings of a post merge field by field, in order of arrival (seq).

Every rule is an aggregate with partial sums, so a key with very many sightings shuffles one row a task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean

FLAGS, HIGHEST = ["is_official", "is_campaign", "is_low_signal"], ["views", "comments"]
LONGEST = ["title", "original_text", "content_scope", "source_note", "url"]
LATEST = ["source", "published_at", "author", "source_section", "published_at_source"]
#: The fields of a post.
FIELDS = {c: "boolean" for c in FLAGS} | {c: "bigint" for c in HIGHEST} | {c: "string" for c in [*LONGEST, *LATEST]}


def whole(posts: DataFrame) -> DataFrame:
    """posts with all fields; those it lacks are null."""
    return posts.withColumns({c: F.lit(None).cast(kind) for c, kind in FIELDS.items() if c not in posts.columns})


def merged(sightings: DataFrame, key: str = "post_key", ranges: int | None = None, **more: Column) -> DataFrame:
    """One row a key: flags by OR, numbers by maximum, texts the longest (ties: the newer), others the last filled; and more. With
    ranges the result lies in so many ranges of keys: lengths need Python, after which Spark no longer knows of an exchange, so
    they are taken before it."""
    sightings = whole(sightings)
    size = lambda c: F.length(clean(F.col(c)))
    if ranges:
        sightings = sightings.withColumns({f"_n_{c}": size(c) for c in LONGEST}).repartitionByRange(ranges, key)
    longest = lambda c: F.max_by(c, F.struct(F.col(f"_n_{c}") if ranges else size(c), F.col("seq")))

    def latest(c: str) -> Column:
        filled = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        return F.max_by(c, F.when(filled, F.col("seq")))

    each = [F.bool_or(c).alias(c) for c in FLAGS] + [F.max(c).alias(c) for c in HIGHEST] + [longest(c).alias(c) for c in LONGEST] + [latest(c).alias(c) for c in LATEST]
    return sightings.groupBy(key).agg(*each, F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n_seen"), *[c.alias(n) for n, c in more.items()])


def upsert(store: DataFrame, live: DataFrame, key: str = "post_key", unique: bool = False, ranges: int | None = None, **more: Column) -> DataFrame:
    """The merged store; change is new, updated or unchanged. Rows of store come before those of live. unique: store has one row
    a key, so one aggregate gives both what was and what is, and more; with ranges, live has one row a key, too, and the result
    lies in so many ranges of keys, by the same exchange."""
    store, live = whole(store), whole(live)
    seen = store.withColumn("_live", F.lit(0)).unionByName(live.withColumn("_live", F.lit(1)), allowMissingColumns=True)
    seen = seen.withColumn("seq", F.struct("_live", "seq"))
    state = [*FLAGS, *HIGHEST, *LONGEST, *LATEST]
    if unique:
        now = merged(seen, key, ranges, **more, _before=F.max(F.when(F.col("_live") == 0, F.struct(*state))))
    else:
        now = merged(seen, key).join(merged(store, key).select(key, F.struct(*state).alias("_before")), key, "left")
    same = F.struct(*state).eqNullSafe(F.col("_before"))
    change = F.when(F.col("_before").isNull(), "new").when(same, "unchanged").otherwise("updated")
    return now.withColumn("change", change).withColumn("seq", F.col("seq.seq")).drop("_before")


def overlay(shared: DataFrame, local: DataFrame, key: str = "post_key") -> DataFrame:
    """A shared and a local store as one: merged by key, the shared rows first."""
    both = whole(shared).withColumn("_at", F.lit(0)).unionByName(whole(local).withColumn("_at", F.lit(1)), allowMissingColumns=True)
    return merged(both.withColumn("seq", F.struct("_at", "seq")), key).withColumn("seq", F.col("seq.seq"))


def combined(batches: list[DataFrame], key: str = "post_key") -> DataFrame:
    """Batches of one source, in order of arrival, merged by key."""
    first, *others = [whole(b).withColumn("_at", F.lit(k)) for k, b in enumerate(batches)]
    for more in others:
        first = first.unionByName(more, allowMissingColumns=True)
    return merged(first.withColumn("seq", F.struct("_at", "seq")), key).withColumn("seq", F.col("seq.seq"))


def distinct_first(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row a key: the first in order. min_by keeps a row a key and task before the shuffle."""
    names = rows.columns
    first = F.min_by(F.struct(*names), F.struct(*order)).alias("_row")
    return rows.groupBy(F.col(key).alias("_key")).agg(first).select("_row.*")


def write_store(posts: DataFrame, root: str, key: str = "post_key") -> str:
    """Writes posts in order of key to a new folder under root, then points root/current at it; returns the folder. Readers see
    the old store until the pointer is replaced, in one rename. A path that is being read is never overwritten."""
    spark = posts.sparkSession
    folder = f"{root}/{uuid.uuid4().hex}"
    posts.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("errorifexists").parquet(folder)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pointer, fresh = jvm.org.apache.hadoop.fs.Path(f"{root}/current"), jvm.org.apache.hadoop.fs.Path(f"{folder}.pointer")
    files = pointer.getFileSystem(conf)
    out = files.create(fresh, True)
    out.write(bytearray(folder.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fresh, pointer, options)
    return folder


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The store that root/current points at."""
    return spark.read.parquet(spark.read.text(f"{root}/current").first()[0])
