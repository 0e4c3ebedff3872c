"""Reports from small aggregates. Only counts, names and a few titles reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.analytics import keyword_stats, repeated_topics, top, top_per_group
from ..operators.rules import GUIDE, NATURAL, OTHER
from ..sources import values


def split_evidence(analysed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What users say, and what only supports it; without the flag, by content type."""
    says = F.coalesce("trend_eligible", F.lit(False)) if "trend_eligible" in analysed.columns else F.col("content_type") == NATURAL
    return analysed.filter(says), analysed.filter(~says)


def display_filter(analysed: DataFrame, category: str | None = None, content_type: str | None = None, keyword: str | None = None) -> DataFrame:
    for column, wanted in (("category", category), ("content_type", content_type)):
        analysed = analysed.filter(F.col(column) == wanted) if wanted else analysed
    return analysed.filter(F.array_contains("keyword_labels", keyword)) if keyword else analysed


def representative(analysed: DataFrame, group: str, n: int) -> DataFrame:
    """group, rank, label: the n best distinct labels of posts, by engagement * 3 + views."""
    label = text.post_label(F.col("title_ko"), F.col("title"), F.col("translated_text"), F.col("original_text"))
    each = analysed.select(group, label.alias("label"), (F.col("engagement") * 3 + F.col("views")).alias("score"), "seq").filter("label <> ''")
    firsts = each.groupBy(group, "label").agg(F.max("score").alias("score"), F.min_by("seq", F.struct(-F.col("score"), F.col("seq"))).alias("seq"))
    return top_per_group(firsts, group, [F.desc("score"), "seq"], n).select(group, "rank", "label")


def joined(rows: DataFrame, group: str, value: str, name: str, between: str = " / ") -> DataFrame:
    """A row a group with its values in order of rank; used on a few rows a group."""
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value]), between).alias(name))


def narrative_inputs(analysed: DataFrame) -> DataFrame:
    """Posts and share (half-even percent) by topic, with two representative labels, most posts first."""
    natural = split_evidence(analysed)[0]
    counts = natural.groupBy("category").agg(F.count(F.lit(1)).alias("posts"))
    titles = joined(representative(natural, "category", 2), "category", "label", "titles")
    share = F.bround(F.col("posts") * 100 / F.sum("posts").over(Window.partitionBy()), 0).cast("int")  # the window sees a row a category
    return counts.withColumn("percent", share).join(titles, "category", "left").select("category", "posts", "percent", F.coalesce("titles", F.lit("")).alias("titles"))


def top_keywords(analysed: DataFrame, group: str, n: int) -> DataFrame:
    """group, rank, keyword, posts: the keywords of most posts in each group."""
    sums = analysed.select(group, F.explode("keyword_counts").alias("keyword", "n")).groupBy(group, "keyword").agg(F.count(F.lit(1)).alias("posts"), F.sum("n").alias("mentions"))
    return top_per_group(sums, group, [F.desc("posts"), F.desc("mentions"), "keyword"], n).select(group, "rank", "keyword", "posts")


def keyword_text(analysed: DataFrame, group: str = "category", n: int = 5) -> DataFrame:
    """group, keywords: the leading keywords with their posts, as one text."""
    each = top_keywords(analysed, group, n).withColumn("text", F.concat("keyword", F.lit(" "), F.format_number("posts", 0), F.lit("건")))
    return joined(each, group, "text", "keywords", " · ")


def category_metrics(crosstab: DataFrame) -> DataFrame:
    """The categories with posts: most first, ties in order of rules, the fallback last."""
    return crosstab.filter("total > 0").orderBy(F.col("category") == OTHER, F.desc("total"), "category_order")


def popular(analysed: DataFrame) -> DataFrame:
    """list, rank, seq, value, label of the posts with most comments and views, and of the videos with most views."""
    videos = analysed.filter(F.col("content_type") == GUIDE)
    out = None
    for name, rows, metric, n in (("comments", analysed, "engagement", 10), ("views", analysed, "views", 10), ("videos", videos, "views", 5)):
        few = top(rows, metric, n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), "seq")))  # at most n rows
        few = few.select(F.lit(name).alias("list"), "rank", "seq", F.col(metric).alias("value"), text.excerpt(text.first_filled(F.col("title_ko"), F.col("title")), 60).alias("label"))
        out = few if out is None else out.unionByName(few)
    return out


def topics_in_order(analysed: DataFrame, category_of: dict[str, str], category_order: list[str], n: int) -> DataFrame:
    """The first n repeated topics: most posts, then order of categories, then name."""
    order = F.create_map(*[F.lit(x) for k, c in enumerate([*category_order, OTHER]) for x in (c, k)])
    return repeated_topics(analysed, category_of).orderBy(F.desc("posts"), order[F.col("category")], "topic").limit(n)


def topic_posts(analysed: DataFrame, topics: DataFrame) -> DataFrame:
    """The natural posts of each of topics(topic, category)."""
    natural = analysed.filter(F.col("content_type") == NATURAL).withColumn("topic", F.explode("keyword_labels"))
    return natural.join(F.broadcast(topics.select("topic", "category")), ["topic", "category"])


def topic_examples(analysed: DataFrame, topics: DataFrame, n: int = 5) -> DataFrame:
    """topic, rank, seq, title, excerpt: posts of most engagement, views and latest date; of one title the first."""
    title = text.collapse(text.first_filled(F.col("title_ko"), F.col("title")))
    each = topic_posts(analysed, topics).select("topic", "seq", "date", "source", "url", "engagement", "views", title.alias("title"), F.substring(text.collapse(F.col("translated_text")), 1, 220).alias("excerpt")).filter("title <> ''")
    best = F.struct(-F.col("engagement"), -F.col("views"), -F.coalesce(F.unix_date("date"), F.lit(-1_000_000)), F.col("seq"))
    row = F.struct("seq", "date", "source", "url", "title", "excerpt", best.alias("o"))
    firsts = each.groupBy("topic", text.title_key(F.col("title")).alias("_k")).agg(F.min_by(row, best).alias("x"))
    return top_per_group(firsts, "topic", [F.col("x.o")], n).select("topic", "rank", "x.seq", "x.date", "x.source", "x.url", "x.title", "x.excerpt")


def topic_summaries(analysed: DataFrame, category_of: dict[str, str], category_order: list[str], n: int = 8) -> DataFrame:
    """A row a topic, in order: posts, its sources and keywords with their posts, and up to five examples."""
    topics = topics_in_order(analysed, category_of, category_order, n)
    posts = topic_posts(analysed, topics)
    keywords = joined(top_keywords(posts, "topic", 3).withColumn("text", text.counted(F.col("keyword"), F.col("posts"))), "topic", "text", "keywords", ", ")
    by_source = top_per_group(posts.groupBy("topic", "source").count(), "topic", [F.desc("count"), "source"], 3)
    sources = joined(by_source.withColumn("text", text.counted(F.col("source"), F.col("count"))), "topic", "text", "sources", ", ")
    examples = topic_examples(analysed, topics)
    some = examples.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "seq", "title", "excerpt"))), lambda x: F.struct(x["seq"], x["title"], x["excerpt"])).alias("examples"))
    return topics.join(keywords, "topic", "left").join(sources, "topic", "left").join(some, "topic", "left")


def count_repeated_topics(analysed: DataFrame, category_of: dict[str, str]) -> DataFrame:
    return repeated_topics(analysed, category_of).agg(F.count(F.lit(1)).alias("topics"))


def representative_title(rows: DataFrame, group: str) -> DataFrame:
    """group, title: of the post of most engagement, then views; 100 characters."""
    title = F.substring(text.collapse(text.first_filled(F.col("title_ko"), F.col("title"))), 1, 100)
    return rows.groupBy(group).agg(F.max_by(title, F.struct("engagement", "views", -F.col("seq"))).alias("title"))


def narrative(analysed: DataFrame, category_of: dict[str, str] | None = None, notes: list[str] = (), spread: int = 15, topics: int = 4) -> str:
    """Markdown: overview, the leading topics with keywords and titles, cautions; a checklist if there's nothing."""
    natural, support = split_evidence(analysed)
    rows = sorted(narrative_inputs(analysed).collect(), key=lambda r: (-r["posts"], r["category"]))  # a row a category
    if not rows:
        return "\n".join(["- no posts in this period", "- check: posts read in this run, posts outside the period, posts without a date; try a longer period", *(f"- {n}" for n in notes)])
    total, named = sum(r["posts"] for r in rows), [r for r in rows if r["category"] != OTHER]
    words = {r["category"]: r["keywords"] for r in keyword_text(natural, "category", 3).collect()}
    by_source = natural.groupBy("source").count().orderBy(F.desc("count"), "source").collect()  # a row a source
    out = [f"- {total:,} posts ({', '.join(f'''{r['source']} {r['count']:,}''' for r in by_source)}); {support.count():,} supporting posts apart"]
    if named:
        lead = f"spread over {len(named)} topics" if named[0]["posts"] <= total * spread / 100 else f"led by {named[0]['category']}"
        out.append(f"- {lead}: " + ", ".join(f"{r['category']} {r['posts']:,} ({r['percent']} %)" for r in named[:topics]))
    out += [f"- {r['category']} ({r['posts']:,}): {words.get(r['category'], '')}; {r['titles']}" for r in named[:topics]]
    out += [f"- caution: {r['posts']:,} posts ({r['percent']} %) without a topic" for r in rows if r["category"] == OTHER]
    return "\n".join([*out, *(f"- caution: {n}" for n in notes), "- caution: public posts only; comments, images and hidden posts are missing"])


def report_draft(analysed: DataFrame, category_of: dict[str, str], category_order: list[str], n: int = 5) -> str:
    """A short text of facts alone: repeated topics, or that there are none."""
    natural, support = split_evidence(analysed)
    n_natural, n_support = natural.count(), support.count()
    if not n_natural:
        return "no results"
    topics = topics_in_order(analysed, category_of, category_order, n)
    posts = topic_posts(analysed, topics)
    words = joined(top_keywords(posts, "topic", 3).withColumn("text", text.counted(F.col("keyword"), F.col("posts"))), "topic", "text", "keywords", ", ")
    rows = topics.join(words, "topic", "left").join(representative_title(posts, "topic"), "topic", "left").collect()  # n rows
    out = [f"- {r['category']}/{r['topic']}: {r['posts']:,} posts; {r['keywords']}" + (f"; {r['title']}" if r["title"] else "") for r in sorted(rows, key=lambda r: (-r["posts"], category_order.index(r["category"]), r["topic"]))]
    return "\n".join([*(out or [f"- no repeated topic among {n_natural:,} posts"]), f"- {n_support:,} supporting posts are left out"])


def trend_report(analysed: DataFrame, crosstab: DataFrame, category_of: dict[str, str], period: str, notes: list[str] = ()) -> str:
    """The same facts in sentences: sources, topics, keywords, what has no topic, what was left out."""
    natural, support = split_evidence(analysed)
    total = natural.count()
    if not total:
        return f"- no posts in {period}"
    sources = natural.groupBy("source").count().orderBy(F.desc("count"), "source").collect()
    topics = category_metrics(crosstab).collect()  # a row a category
    words = keyword_stats(natural, category_of).orderBy("rank").limit(5).collect()
    other = sum(r["total"] for r in topics if r["category"] == OTHER)
    lines = [
        f"- {period}: {total:,} posts", "- sources: " + " · ".join(f"{r['source']} {r['count']:,}" for r in sources), "- topics: " + " · ".join(f"{r['category']} {r['total']:,}" for r in topics if r["category"] != OTHER),
        "- keywords: " + (" · ".join(f"{r['keyword']} {r['posts']:,}" for r in words) or "none"), f"- without a topic: {other:,} ({round(other * 100 / total)} %)", f"- left out: {support.count():,}",
    ]
    return "\n".join([*lines, *(f"> - {n}" for n in notes)])


def grid(analysed: DataFrame) -> DataFrame:
    """The result grid with its column names."""
    return analysed.select(*[F.col(c).alias(name) for c, name in values.GRID.items()])


def export(analysed: DataFrame) -> DataFrame:
    """The columns of the export, in order; the spreadsheet's byte order mark leads the header."""
    first, *others = values.EXPORT
    return analysed.select(F.col(first).alias("﻿" + first), *others)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, for spreadsheets, written by the executors; every file opens with the byte order mark of export()."""
    df.write.mode("errorifexists").option("header", True).option("encoding", "UTF-8").csv(path)
