"""The synthetic tables as posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dealt(df: DataFrame) -> DataFrame:
    """A scan of few files dealt over all cores, so that costly functions of texts don't run in one task; a scan of many stays."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def posts(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """seq, source, title, original_text, url, published_at, views, comments and three flags of each document. The small
    tables join each other first, so texts are shuffled once at most."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = read("documents")
    docs = (dealt(docs) if spread else docs).select(F.col("doc_id").alias("seq"), "source", "text")
    events = read("events").filter("event_id % 5 = 0").select((F.col("event_id") / 5).cast("bigint").alias("seq"), "ts", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    labels = read("labels").select(F.col("doc_id").alias("seq"), "quality", "toxic")
    pages = read("pages").select(F.col("page_id").alias("seq"), "url")
    facts = events.join(labels, "seq", "full").join(pages, "seq", "full")
    joined = docs.join(facts, "seq", "left")
    return joined.select(
        "seq", "source", F.substring(F.trim("text"), 1, 72).alias("title"), F.col("text").alias("original_text"), "url",
        F.when(F.col("seq") % 17 != 0, F.col("ts").cast("date")).alias("published_at"),
        F.floor("value").cast("bigint").alias("views"), F.col("k").alias("comments"),
        (F.coalesce("quality", F.lit(1)) == 0).alias("is_low_signal"), (F.coalesce("toxic", F.lit(0)) == 1).alias("is_campaign"), (F.col("seq") % 23 == 0).alias("is_official"),
    )
