"""Aggregates and rankings over analysed posts. Every order ends in a unique key, so ties have one result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import EVENT, GUIDE, NATURAL, OFFICIAL, OTHER


def top(df: DataFrame, metric: str, n: int) -> DataFrame:
    return df.filter(F.col(metric) > 0).orderBy(F.desc(metric), "seq").limit(n)


def top_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """Spark keeps n rows a group and task before the shuffle, so a large group costs no more than its tasks."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def crosstab(analysed: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each label and the fallback, with counts by content type; zeros stay."""
    kinds = {"natural": NATURAL, "guide": GUIDE, "event": EVENT, "official": OFFICIAL}
    counts = analysed.groupBy("category").agg(*[F.count_if(F.col("content_type") == k).alias(n) for n, k in kinds.items()], F.count(F.lit(1)).alias("total"))
    spark = analysed.sparkSession
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([*labels, OTHER])], "category_order int, category string")
    return rows.join(counts, "category", "left").na.fill(0)


def keyword_stats(analysed: DataFrame, category_of: dict[str, str]) -> DataFrame:
    """rank, keyword, category, posts, mentions: most posts first, then mentions, then name."""
    each = analysed.select(F.explode("keyword_counts").alias("keyword", "n"))
    sums = each.groupBy("keyword").agg(F.count(F.lit(1)).alias("posts"), F.sum("n").alias("mentions"))
    linked = F.create_map(*[F.lit(x) for pair in category_of.items() for x in pair])
    rank = F.row_number().over(Window.orderBy(F.desc("posts"), F.desc("mentions"), "keyword"))  # one row a keyword
    return sums.withColumns({"category": F.coalesce(linked[F.col("keyword")], F.lit(OTHER)), "rank": rank})


def daily(analysed: DataFrame) -> DataFrame:
    return analysed.filter("date is not null").groupBy("date").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("content_type") == NATURAL).alias("natural"))


def by_source(analysed: DataFrame) -> DataFrame:
    kinds = {"natural": NATURAL, "guide": GUIDE, "event": EVENT, "official": OFFICIAL}
    return analysed.groupBy("source").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("content_type") == k).alias(n) for n, k in kinds.items()])


def terms(posts: DataFrame, letters: str, sizes: tuple[int, ...] = (2, 3), least: int = 2, n: int = 25, stop: list[str] = ()) -> DataFrame:
    """term, posts, example of the n-grams within runs of `letters` in title and text that most posts hold, without those of
    `stop` (stop words and the aliases that rules have already). A shorter term hides behind a
    longer one that contains it and is as frequent: longer ones are exploded into their parts, an equi-join."""
    runs = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "title", "original_text"), F.lit(f"({letters}+)")))

    def grams(run, size):
        return F.when(F.length(run) >= size, F.transform(F.sequence(F.lit(1), F.length(run) - size + 1), lambda i: F.substring(run, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    def of_size(size):
        return lambda run: grams(run, size)

    every = F.array_distinct(F.flatten(F.concat(*[F.transform(runs, of_size(s)) for s in sizes])))
    each = posts.select("seq", F.substring("title", 1, 60).alias("title"), F.explode(every).alias("term")).filter(~F.col("term").isin(*stop) if stop else F.lit(True))
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("posts"), F.min_by("title", "seq").alias("example")).filter(F.col("posts") >= least)
    long = counts.filter(F.length("term") == max(sizes))
    parts = F.array_distinct(grams(F.col("term"), min(sizes)))
    hides = long.select(F.explode(parts).alias("term"), F.col("posts").alias("cover")).groupBy("term").agg(F.max("cover").alias("cover"))
    shown = counts.join(hides, "term", "left").filter(F.col("cover").isNull() | (F.length("term") == max(sizes)) | (F.col("cover") < F.col("posts")))
    return shown.select("term", "posts", "example").orderBy(F.desc("posts"), "term").limit(n)


def _signature():
    """What tells posts of a topic apart: the URL, else source and title."""
    return F.coalesce(F.nullif("url", F.lit("")), F.concat_ws("|", "source", "title"))


def repeated_topics(analysed: DataFrame, category_of: dict[str, str], least: int = 2) -> DataFrame:
    """topic, category, posts: keywords with at least so many natural posts whose main category is the keyword's own. Of
    keywords with the very same posts the longest stays; sets are compared by count and two sums of hashes, so no
    topic's posts are gathered."""
    each = analysed.filter((F.col("content_type") == NATURAL) & (F.col("category") != OTHER)).select("seq", "category", "engagement", "title", _signature().alias("sign"), F.explode("keyword_labels").alias("topic"))
    linked = F.create_map(*[F.lit(x) for pair in category_of.items() for x in pair])
    own = each.filter(linked[F.col("topic")] == F.col("category"))
    digest = F.sum(F.pmod(F.xxhash64("sign"), F.lit(1 << 40)))
    second = F.sum(F.pmod(F.xxhash64("sign", F.lit(1)), F.lit(1 << 40)))
    groups = own.groupBy("topic", "category").agg(F.count(F.lit(1)).alias("posts"), digest.alias("h1"), second.alias("h2"), F.max_by("title", F.struct("engagement", -F.col("seq"))).alias("example")).filter(F.col("posts") >= least)
    first = F.row_number().over(Window.partitionBy("posts", "h1", "h2").orderBy(F.desc(F.length("topic")), "topic"))
    return groups.withColumn("k", first).filter("k = 1").select("topic", "category", "posts", "example")
