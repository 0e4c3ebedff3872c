"""Feed payloads to posts: batches at any depth, items as posts, boards and their routes.

Payloads are columns of JSON text; their nesting is walked in an Arrow pass, all fields are read with variant functions.
"""

from __future__ import annotations

import html
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import dates, text
from ..operators.store import merged
from . import values
from .payloads import resolve_references, walked

BATCH = "array<struct<items: array<string>, attach: string, finished: boolean, trace: string>>"


def batches(payload: Column, key: str = "vecFeed") -> Column:
    """Every object with a list named `key`, at any depth, in document order: its items as JSON, attach information, whether it
    is the last, and its trace. Nothing for text that isn't JSON."""

    @F.pandas_udf(BATCH)
    def find(payloads: pd.Series) -> pd.Series:
        def one(node):
            attach = node.get("feedAttchInfo") or node.get("feedAttachInfo") or ""
            finished = node.get("isFinish")
            return {
                "items": [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in node[key]], "attach": str(attach),
                "finished": None if finished is None else bool(finished), "trace": str(node.get("trace_id") or ""),
            }

        return payloads.map(lambda t: [one(n) for n in walked(t) if isinstance(n.get(key), list)])

    return find(payload)


def field(item: Column, path: str) -> Column:
    """A scalar as text; missing values, numbers that are 0 and false are null, as is anything nested."""
    value = F.try_variant_get(item, path, "variant")
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(item, path, "string")
    return F.when(kind == "STRING", plain).when(kind.startswith("OBJECT") | kind.startswith("ARRAY") | plain.isin("0", "0.0", "false"), None).otherwise(plain)


def first_field(item: Column, *paths: str) -> Column:
    """The first field that isn't empty, cleaned; else the empty string."""
    return F.coalesce(*[F.nullif(text.clean(field(item, p)), F.lit("")) for p in paths], F.lit(""))


PARTS = ("title", "contents", "content_with_style", "summary")


@F.pandas_udf(ArrayType(StringType()))
def _texts(items: pd.Series) -> pd.Series:
    """The texts below the parts of an item, in order."""

    def below(node, out):
        if isinstance(node, list):
            for x in node:
                below(x, out)
        elif isinstance(node, dict):
            inner = node.get("text_content")
            for t in (inner.get("text") if isinstance(inner, dict) else None, node.get("text")):
                if isinstance(t, str):
                    out.append(html.unescape(t))
            for name, x in node.items():
                if name in (*PARTS, "task_content"):
                    below(x, out)

    def one(value):
        try:
            item, out = json.loads(value), []
            for part in PARTS:
                below(item.get(part) if isinstance(item, dict) else None, out)
            return out
        except (TypeError, ValueError, RecursionError):
            return []

    return items.map(one)


def feed_text(item_json: Column) -> Column:
    """The item's texts, without those that another one contains, joined by blanks."""
    each = F.filter(F.transform(_texts(item_json), text.collapse), lambda t: t != "")

    def add(kept: Column, t: Column) -> Column:
        others = F.filter(kept, lambda k: ~F.contains(t, k))
        return F.when(F.exists(kept, lambda k: F.contains(k, t)), kept).otherwise(F.array_append(others, t))

    return F.array_join(F.aggregate(each, F.array().cast("array<string>"), add), " ")


def tag_text(tag: Column) -> Column:
    """The strings of a variant that is a string, an object or an array, joined by blanks."""
    kind, strings = F.schema_of_variant(tag), lambda xs: F.filter(xs, lambda x: F.schema_of_variant(x) == "STRING")
    joined = lambda xs: F.array_join(F.filter(F.transform(strings(xs), lambda x: F.trim(F.try_variant_get(x, "$", "string"))), lambda x: x != ""), " ")
    return (
        F.when(kind == "STRING", F.trim(F.try_variant_get(tag, "$", "string")))
        .when(kind.startswith("OBJECT"), joined(F.map_values(F.try_variant_get(tag, "$", "map<string,variant>"))))
        .when(kind.startswith("ARRAY"), joined(F.try_variant_get(tag, "$", "array<variant>")))
        .otherwise("")
    )


def is_official(tag: Column, author: Column, section: Column, official_section: str | None, markers: list[str] | None = None) -> Column:
    """The official board, or a marker in the account's tag or name, in its own case."""
    named = text.has_any(F.concat_ws(" ", tag, author), values.OFFICIAL_MARKERS if markers is None else markers)
    return named | (F.coalesce(section == official_section, F.lit(False)) if official_section else F.lit(False))


def flags(post_text: Column, section: Column, author: Column) -> dict[str, Column]:
    """What a cleaned text says about its post."""
    campaign = text.is_campaign(post_text, section, author, values.EVENT_SECTIONS, values.CAMPAIGN_AUTHORS, values.CAMPAIGN_MARKERS, cleaned=True)
    return {"is_campaign": campaign, "is_low_signal": text.is_low_signal(post_text, values.LOW_SIGNAL, cleaned=True)}


def feed_posts(items: DataFrame, root: str, official_section: str | None = None, source: str = values.FEED) -> DataFrame:
    """Posts of items(seq, item, section, channel_id), item being JSON; items without an id go. Other columns stay."""
    p = items.withColumn("_v", F.try_parse_json("item"))
    p = p.withColumns({"_id": first_field(F.col("_v"), "$.id", "$.feed_id"), "_channel": F.coalesce(F.nullif(first_field(F.col("_v"), "$.channelInfo.sign.channel_id"), F.lit("")), F.coalesce("channel_id", F.lit("")))})
    p = p.filter("_id <> ''").withColumns({"_own": feed_text(F.col("item")), "author": first_field(F.col("_v"), "$.poster.nick")})
    some = lambda path: F.size(F.try_variant_get("_v", path, "array<variant>")) > 0
    fallback = F.when(some("$.images"), values.ONLY_IMAGES).when(some("$.videos"), values.ONLY_VIDEOS).otherwise("")
    body = F.coalesce(F.nullif("_own", F.lit("")), F.nullif(first_field(F.col("_v"), "$.feed_abstract", "$.subtitle", "$.discussion_num"), F.lit("")), fallback)
    p = p.withColumn("original_text", body)
    url = F.concat(F.lit(f"{root}/post/"), F.col("_id"), F.when(F.col("_channel") != "", F.concat(F.lit("?subc="), "_channel")).otherwise(""))
    published = dates.epoch_date(F.nullif(first_field(F.col("_v"), "$.createTime", "$.create_time"), F.lit("")))
    tag = tag_text(F.try_variant_get("_v", "$.poster.manage_tag", "variant"))
    p = p.withColumns({
        "source": F.lit(source), "title": text.excerpt(F.col("original_text")), "url": url, "published_at": published.cast("string"),
        "views": text.parse_count(field(F.col("_v"), "$.visitorInfo.viewCount")), "comments": text.parse_count(field(F.col("_v"), "$.commentCount")),
        "content_scope": F.lit(values.SCOPES["feed"]), "source_note": F.lit(values.NOTES["feed"]), "source_section": F.col("section"),
        "published_at_source": F.when(published.isNull(), values.UNKNOWN).otherwise(values.DATED_BY["feed"]),
        "is_official": is_official(tag, F.col("author"), F.col("section"), official_section), **flags(F.col("original_text"), F.col("section"), F.col("author")), "post_key": F.col("_id"),
    })
    return p.drop("_v", "_id", "_channel", "_own", "item", "section", "channel_id")


def payload_posts(payloads: DataFrame, root: str, official_section: str | None = None, source: str = values.FEED) -> DataFrame:
    """One post a key of payloads(seq, payload, section, channel_id): flattened payloads are resolved, others read as they
    are; items count in order of payload, batch and place, and merge by key."""
    plain = F.coalesce(resolve_references(F.col("payload")), F.col("payload"))
    each = payloads.select("seq", "section", "channel_id", F.posexplode(batches(plain)).alias("_batch", "_b"))
    each = each.select("seq", "section", "channel_id", "_batch", F.posexplode("_b.items").alias("_place", "item"))
    posts = feed_posts(each, root, official_section, source).withColumn("seq", F.struct("seq", "_batch", "_place"))
    return merged(posts.drop("_batch", "_place")).withColumn("seq", F.col("seq.seq"))


def board_routes(payloads: DataFrame, fallback: DataFrame, root: str, hidden_section: str, main_section: str, official_section: str) -> DataFrame:
    """run, section, channel_id, discovery, priority, excluded_section, url of the boards that payloads(run, payload) name. The
    largest payload comes first and none after the first with the main board; per section the first name wins, and
    fallback(channel_id, section) fills what is missing. A run has a handful of payloads, so its windows are small."""
    known = "struct<pinia: struct<commonGuildStore: struct<hiddenChannelId: string, tabInfoList: array<struct<channel_id: string, name: string>>>>>"
    plain = F.coalesce(resolve_references(F.col("payload")), F.col("payload"))
    read = payloads.select("run", F.row_number().over(Window.partitionBy("run").orderBy(F.desc(F.length("payload")), "payload")).alias("nth"), F.from_json(plain, known)["pinia"]["commonGuildStore"].alias("s"))
    hidden = F.struct(F.col("s.hiddenChannelId").alias("channel_id"), F.lit(hidden_section).alias("name"))
    tabs = F.coalesce("s.tabInfoList", F.array().cast("array<struct<channel_id: string, name: string>>"))
    each = read.select("run", "nth", F.posexplode(F.concat(F.array(hidden), tabs)).alias("pos", "x"))
    each = each.select("run", "nth", "pos", text.clean(F.col("x.channel_id")).alias("channel_id"), text.clean(F.col("x.name")).alias("section")).filter(F.col("channel_id").rlike("^[0-9]+$") & (F.col("section") != ""))
    main = F.min(F.when(F.col("section") == main_section, F.col("nth"))).over(Window.partitionBy("run"))
    each = each.withColumn("_main", main).filter(F.col("_main").isNull() | (F.col("nth") <= F.col("_main")))
    found = each.groupBy("run", "section").agg(F.min_by("channel_id", F.struct("nth", "pos")).alias("channel_id")).withColumn("discovery", F.lit("page_payload"))
    rest = payloads.select("run").distinct().crossJoin(F.broadcast(fallback.select("channel_id", "section"))).join(found, ["run", "section"], "left_anti")  # a handful of rows a run
    routes = found.unionByName(rest.withColumn("discovery", F.lit("fallback"))).filter(F.trim("channel_id") != "")
    priority = F.when(F.col("section") == main_section, 0).when(F.col("section") == hidden_section, 1).when(F.col("section") == official_section, 2).otherwise(3)
    return routes.withColumns({"priority": priority, "excluded_section": F.col("section").isin(*values.EVENT_SECTIONS), "url": F.concat(F.lit(f"{root}?subc="), F.col("channel_id"))})


def in_order(routes: DataFrame) -> DataFrame:
    return routes.orderBy("run", "priority", "section")
