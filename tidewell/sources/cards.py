"""Cards, search rows and listings joined to what their details say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from . import values
from .feeds import flags, is_official

KEEP_QUERY = r"pd\.qq\.com/g/.*/post/"  # fixed value: addresses that need their query
META = ["url", "headline", "description", "published_at", "author", "section"]


def filled(column: Column) -> Column:
    return F.nullif(F.coalesce(text.clean(column), F.lit("")), F.lit(""))


def overridden(base: DataFrame, more: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """All rows of base and more by key; more's fields win where they aren't empty."""
    b, m = base.select(key, F.struct(*fields).alias("_b")), more.select(key, F.struct(*fields).alias("_m"))
    both = b.join(m, key, "full")
    return both.select(key, *[F.coalesce(filled(F.col(f"_m.{c}")), F.col(f"_b.{c}")).alias(c) for c in fields])


def card_posts(cards: DataFrame, metadata: DataFrame, official_section: str | None = None) -> DataFrame:
    """Posts of cards(seq, url, author, text, comments, is_official) with metadata(post_key, META); cards without a key go."""
    c = cards.withColumn("_u", text.canonical_url(text.clean(F.col("url")), KEEP_QUERY)).withColumn("post_key", F.regexp_extract("_u", r"/post/([^?/#]+)", 1)).filter("post_key <> ''")
    m = metadata.select("post_key", F.struct(*META).alias("_m"))
    p = c.join(m, "post_key", "left").withColumns({
        "_section": F.coalesce(filled(F.col("_m.section")), F.lit("")), "_author": text.first_filled(text.clean(F.col("author")), text.clean(F.col("_m.author"))),
        "_text": text.first_filled(text.clean(F.col("text")), text.clean(F.col("_m.description")), text.clean(F.col("_m.headline"))), "_date": filled(F.col("_m.published_at")),
    })
    return p.select(
        "seq", "post_key", F.lit(values.FEED).alias("source"), text.excerpt(F.col("_text")).alias("title"), F.col("_text").alias("original_text"), F.col("_u").alias("url"), F.col("_date").alias("published_at"),
        F.col("_author").alias("author"), text.parse_count(F.col("comments")).alias("comments"), F.lit(values.SCOPES["card"]).alias("content_scope"),
        F.when(F.col("_date").isNull(), values.NOTES["card undated"]).otherwise(values.NOTES["card"]).alias("source_note"), F.col("_section").alias("source_section"),
        F.when(F.col("_date").isNull(), values.UNKNOWN).otherwise(values.DATED_BY["card"]).alias("published_at_source"),
        (F.coalesce(F.col("is_official"), F.lit(False)) | is_official(F.lit(""), F.col("_author"), F.col("_section"), official_section)).alias("is_official"),
        *[f.alias(n) for n, f in flags(F.col("_text"), F.col("_section"), F.col("_author")).items()],
    )


def detail_posts(cards: DataFrame, metadata: DataFrame, details: DataFrame, official_section: str | None = None) -> DataFrame:
    """card_posts() with what details(post_key, section, url, headline, description, published_at, author) say: filled fields
    of a detail win over the list's; of two texts the longer stays, the detail's where they are equal."""
    cards_of = cards.withColumn("_k", F.regexp_extract(text.canonical_url(text.clean(F.col("url")), KEEP_QUERY), r"/post/([^?/#]+)", 1))
    whole = overridden(metadata, details, "post_key", META)
    post = card_posts(cards_of.drop("_k"), whole, official_section)
    d = details.select("post_key", F.struct("headline", "description", "author", "published_at", "section").alias("_d"))
    p = post.join(d, "post_key")
    own = text.first_filled(text.clean(F.col("_d.description")), text.clean(F.col("_d.headline")))
    body = F.when(F.length(own) >= F.length(text.clean(F.col("original_text"))), own).otherwise(F.col("original_text"))
    p = p.withColumns({"original_text": body, "author": text.first_filled(text.clean(F.col("_d.author")), F.col("author")), "source_section": F.col("_d.section"), "_date": filled(F.col("_d.published_at"))})
    p = p.withColumns({
        "title": text.excerpt(F.col("original_text")), "published_at": F.coalesce("_date", "published_at"),
        "published_at_source": F.when(F.col("_date").isNotNull(), values.DATED_BY["detail"]).otherwise(F.col("published_at_source")),
        "is_official": F.col("is_official") | (F.coalesce(F.col("source_section") == official_section, F.lit(False)) if official_section else F.lit(False)),
        **flags(F.col("original_text"), F.col("source_section"), F.col("author")), "content_scope": F.lit(values.SCOPES["detail"]),
    })
    return p.withColumn("source_note", F.when(F.col("published_at").isNull(), values.NOTES["detail undated"]).otherwise(values.NOTES["detail"])).drop("_d", "_date")


def video_posts(found: DataFrame, details: DataFrame, aliases: list[str], root: str) -> DataFrame:
    """Posts of search rows found(seq, video_id, address, title, description, published, sent, plays, reviews, video_reviews, author)
    with details(video_id, title, description, published, views, replies, owner). Rows without an id, with a title that says
    nothing, and of other subjects go. Of rows of one video the first stays."""
    named = lambda *cs: text.first_filled(*[text.clean(c.cast("string")) for c in cs])
    number = lambda c: F.nullif(c.cast("string"), F.lit("0"))
    rows = found.withColumn("video_id", F.coalesce(filled(F.col("video_id")), filled(F.regexp_extract(F.coalesce("address", F.lit("")), "/video/(BV[0-9A-Za-z]+)", 1)))).filter("video_id is not null")
    firsts = rows.groupBy("video_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "video_id"]), "seq").alias("f")).select("video_id", "f.*")
    d = details.select("video_id", F.struct("title", "description", "published", "views", "replies", "owner").alias("_d"))
    p = firsts.join(d, "video_id", "left")
    p = p.withColumns({"_title": text.strip_html(named(F.col("_d.title"), F.col("title"))), "_about": text.without_placeholder(named(F.col("_d.description"), text.strip_html(F.col("description"))), values.PLACEHOLDERS)})
    p = p.filter(text.is_meaningful(F.col("_title")) & text.is_relevant(F.concat_ws(" ", "_title", "_about"), aliases))
    day = dates.epoch_date(F.coalesce(number(F.col("_d.published")), number(F.col("published")), number(F.col("sent"))))
    return p.select(
        "seq", F.lit(values.VIDEO).alias("source"), F.col("_title").alias("title"), F.coalesce(F.nullif("_about", F.lit("")), F.col("_title")).alias("original_text"), F.concat(F.lit(f"{root}/video/"), "video_id").alias("url"),
        day.cast("string").alias("published_at"), named(F.col("_d.owner"), F.col("author")).alias("author"), text.parse_count(F.coalesce(number(F.col("_d.views")), number(F.col("plays")))).alias("views"),
        text.parse_count(F.coalesce(number(F.col("_d.replies")), number(F.col("reviews")), number(F.col("video_reviews")))).alias("comments"),
        F.when(F.col("_about") != "", values.SCOPES["video"]).otherwise(values.SCOPES["video title"]).alias("content_scope"), F.lit(values.NOTES["video"]).alias("source_note"), F.lit(values.DATED_BY["video"]).alias("published_at_source"),
    )


def listing_to_read(links: DataFrame, first: Column, last: Column) -> DataFrame:
    """The links(url, title, listed_at) whose details are worth reading: a day more at both ends, and all undated ones."""
    return links.filter(F.col("listed_at").isNull() | F.col("listed_at").between(F.date_sub(first, 1), F.date_add(last, 1)))
