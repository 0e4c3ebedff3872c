"""Pages to posts: one parse of the HTML in an Arrow pass, the rest on columns.

page(html) gives what a page's readers need: title, first heading, named metas, JSON-LD and other JSON scripts, visible
lines, and the texts of wanted elements (by #id or .class). Everything that decides about a post works on these arrays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import dates, text
from . import values

PAGE = "title string, heading string, metas map<string,string>, linked array<string>, scripts array<string>, lines array<string>, nodes map<string,array<string>>"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose texts article and forum pages give away.
WANTED = ("#activity-name", "#js_content", ".core_title_txt", ".d_post_content", ".l_post", ".d_name", ".p_author_name", ".l_reply_num")


class _Page(HTMLParser):
    SILENT = {"script", "style", "head", "template"}

    def __init__(self, wanted: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.stack = set(wanted), []  # (tag, what it is to us)
        self.title, self.heading, self.heads, self.metas, self.linked, self.scripts, self.lines, self.nodes = [], [], 0, {}, [], [], [], {}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (name := a.get("property") or a.get("name")):
            self.metas.setdefault(name, a.get("content", ""))
        if tag in VOID:
            return
        self.heads += tag == "h1"
        marks = [m for m in ("#" + a.get("id", ""), *("." + c for c in a.get("class", "").split())) if m in self.wanted]
        for m in marks:
            self.nodes.setdefault(m, []).append([])
        if tag == "script":
            into = self.linked if a.get("type") == "application/ld+json" else self.scripts if a.get("type") == "application/json" else None
            if into is not None:
                into.append("")
            marks = [into]
        elif tag == "span" and a.get("title") and any(t == ".l_post" for _, ms in self.stack for t in ms):
            self.nodes[".l_post"][-1].append(a["title"])
        self.stack.append((tag, marks))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tags = {t for t, _ in self.stack}
        if "script" in tags:
            into = self.stack[-1][1][0]
            if into is not None:
                into[-1] += data
            return
        if "title" in tags and "svg" not in tags:
            self.title.append(data)
        if "h1" in tags and self.heads == 1:
            self.heading.append(data)
        for _, marks in self.stack:
            for m in marks:
                self.nodes[m][-1].append(data)
        if not self.SILENT & tags:
            self.lines += data.splitlines()


def page(html: Column, wanted: tuple[str, ...] = WANTED) -> Column:
    """struct(PAGE) of a page; a null page is an empty one."""

    @F.pandas_udf(PAGE)
    def parse(pages: pd.Series) -> pd.DataFrame:
        out = []
        for source in pages:
            p = _Page(wanted)
            p.feed(source or "")
            p.close()
            nodes = {k: [" ".join(" ".join(x).split()) for x in v] for k, v in p.nodes.items()}
            out.append((" ".join("".join(p.title).split()), " ".join(" ".join(p.heading).split()), p.metas, p.linked, p.scripts, [x for line in p.lines if (x := " ".join(line.split()))], nodes))
        return pd.DataFrame(out, columns=["title", "heading", "metas", "linked", "scripts", "lines", "nodes"])

    return parse(html)


FOUND = ["url", "headline", "description", "date_published_raw", "author"]


def _found(script: str | None) -> dict[str, str]:
    """The first posting of a JSON-LD text: level by level through lists and @graph, of a wanted type or list of types."""
    try:
        payload = json.loads(script)
    except (TypeError, ValueError, RecursionError):
        return {}
    queue = list(payload) if isinstance(payload, list) else [payload]
    for node in queue:  # grows while it is read
        if isinstance(node, dict):
            queue += node["@graph"] if isinstance(node.get("@graph"), list) else []
            kinds = node.get("@type")
            if {"DiscussionForumPosting", "SocialMediaPosting"} & {k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)}:
                by = node.get("author")
                got = lambda *names: next((str(node[n]) for n in names if node.get(n)), "")  # noqa: B023, E731
                return {"url": got("url", "mainEntityOfPage"), "headline": got("headline"), "description": got("text", "description"), "date_published_raw": got("datePublished"), "author": str(by.get("name") or "") if isinstance(by, dict) else ""}
    return {}


@F.pandas_udf(StructType([StructField(c, StringType()) for c in FOUND]))
def _posting(scripts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_found(s) for s in scripts], columns=FOUND).astype(object)


@F.pandas_udf(StructType([StructField("place", IntegerType()), *[StructField(c, StringType()) for c in FOUND]]))
def _page_posting(pages: pd.Series) -> pd.DataFrame:
    """The first posting among a page's JSON-LD scripts, its entities resolved, and the place of its script."""

    def one(source):
        p = _Page(())
        p.feed(source or "")
        p.close()
        place, found = next(((k, f) for k, s in enumerate(p.linked) if (f := _found(s))), (None, {}))
        return {"place": place, **{c: unescape(x) for c, x in found.items()}}

    out = pd.DataFrame([one(s) for s in pages], columns=["place", *FOUND]).astype(object)
    return out.assign(place=out["place"].astype("Int32"))


def _tidied(p: Column, c: Callable[[str], Column]) -> Column:
    made = F.struct(c("url").alias("url"), c("headline").alias("headline"), c("description").alias("description"), F.coalesce(dates.iso_date(p["date_published_raw"]).cast("string"), F.lit("")).alias("published_at"), c("date_published_raw").alias("date_published_raw"), c("author").alias("author"))
    return F.when(p["headline"].isNotNull(), made)


def posting(script: Column) -> Column:
    """struct(url, headline, description, published_at, date_published_raw, author) of a JSON-LD text; null without a posting."""
    p = _posting(script)
    return _tidied(p, lambda name: text.clean(p[name]))


def page_postings(pages: DataFrame) -> DataFrame:
    """seq and the first posting among the JSON-LD scripts of pages(seq, html). One function reads a page to its posting, and what has
    none goes after the aggregate: a filter before it would run the function in a second chain of Python workers."""
    first = pages.select("seq", _page_posting("html").alias("_f")).groupBy("seq").agg(F.min_by("_f", "_f.place").alias("_f")).filter("_f is not null")
    return first.select("seq", _tidied(F.col("_f"), lambda name: text.collapse(F.col(f"_f.{name}"))).alias("p")).select("seq", "p.*")


NEWS = "array<struct<`@type`: string, headline: string, description: string, datePublished: string, author: struct<name: string>>>"


def news_article(linked: Column) -> Column:
    """The first NewsArticle among JSON-LD texts: struct(published_at, date_published_raw, headline, description, author)."""
    every = F.flatten(F.transform(linked, lambda s: F.coalesce(F.from_json(s, NEWS), F.array().cast(NEWS))))
    first = F.get(F.filter(every, lambda x: x["@type"] == "NewsArticle"), F.lit(0))
    date = F.coalesce(dates.calendar_date(first["datePublished"]).cast("string"), F.lit(""))
    return F.struct(date.alias("published_at"), *[text.clean(first[n]).alias(to) for n, to in (("datePublished", "date_published_raw"), ("headline", "headline"), ("description", "description"))], text.clean(first["author"]["name"]).alias("author"))


def _story(lines: list[str], title: str, names: tuple[str, ...]) -> tuple[str | None, list[str], str, str]:
    """The meta line, the five lines before it from near to far, the body, and who wrote it."""
    at = next((k for k, x in enumerate(lines) if values.SEEN in x), None)
    if at is None:
        return None, [], "", ""
    skip, body = {values.FOLLOW, title}, []
    for x in lines[at + 1 :]:
        if x in values.STOP_LINES or (body and (re.fullmatch(r"\d+", x) or x == values.LIKE or x in names)):
            break
        if x not in skip:
            body.append(x)
    near = lines[max(0, at - 8) : at][::-1]
    who = next((x for x in near if x not in skip and len(x) <= 40 and not re.search(values.NO_AUTHOR, x)), "")
    return lines[at], near[:5], "\n".join(body), who


def list_posts(pages: DataFrame, today: Column, title_tail: str | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """Posts of pages(seq, html, url, fallback_title) by lines. The first line with the word for views is the meta line; the date
    is that of JSON-LD, else of the meta line, else of one of the five lines before; the body is what follows up to a stop
    line (or, once it has begun, a bare number, the word for likes or one of names); the author is that of JSON-LD, else the
    nearest fitting of the eight lines before."""

    @F.pandas_udf("meta string, near array<string>, body string, who string")
    def story(lines: pd.Series, titles: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_story(list(x), t, names) for x, t in zip(lines, titles, strict=True)], columns=["meta", "near", "body", "who"])

    p = pages.withColumn("_p", page(F.col("html")))
    title = text.clean(text.first_filled(F.col("_p.heading"), F.element_at("_p.metas", "og:title"), F.col("fallback_title")))
    p = p.withColumns({"title": text.without_tail(title, title_tail) if title_tail else title, "_n": news_article(F.col("_p.linked"))})
    p = p.withColumn("_s", story(text.drop_repeats(F.col("_p.lines")), F.col("title")))
    day = lambda x: dates.relative_date(x, today).cast("string")
    nearby = F.get(F.filter(F.transform("_s.near", day), lambda d: d.isNotNull()), F.lit(0))
    published = F.coalesce(F.nullif(F.col("_n.published_at"), F.lit("")), day(F.col("_s.meta")), nearby)
    said = text.clean(F.element_at("_p.metas", "description"))
    body, fits = text.without_tail(text.clean(F.col("_s.body")), values.SEARCH_TAIL), (said != "") & (said != F.col("title")) & ~said.contains("TapTap")
    p = p.withColumn("_b", F.when(~text.is_meaningful(body) & fits, said).otherwise(body))
    has_body = text.is_meaningful(F.col("_b"))
    seen = F.regexp_extract(F.col("_s.meta"), rf"([0-9,.]+(?U:\s)*[万千]?)(?U:\s)*{values.SEEN}", 1)
    return p.select(
        "seq", F.lit(values.LIST).alias("source"), "title", F.when(has_body, F.col("_b")).otherwise(F.col("title")).alias("original_text"), text.canonical_url(F.col("url"), "taptap\\.cn/moment/").alias("url"),
        published.alias("published_at"), text.first_filled(F.col("_n.author"), F.col("_s.who")).alias("author"), text.parse_count(F.nullif(seen, F.lit(""))).alias("views"), F.lit(None).cast("bigint").alias("comments"),
        F.when(has_body, values.SCOPES["page"]).otherwise(values.SCOPES["title"]).alias("content_scope"), F.lit(values.NOTES["page"]).alias("source_note"),
        F.when(F.col("_n.published_at") != "", values.DATED_BY["page"]).otherwise(values.DATED_BY["page shown"]).alias("published_at_source"),
    )


def permalink(html: Column, fetched: Column) -> Column:
    """The permanent address that an article's script names, else the one that it came from."""
    named = F.replace(text.clean(F.regexp_extract(html, r"""var\s+msg_link\s*=\s*["']([^"']+)["']""", 1)), F.lit("&amp;"), F.lit("&"))
    return F.when(named.startswith("http"), named).otherwise(fetched)


def article_posts(pages: DataFrame) -> DataFrame:
    """Posts of article pages(seq, html, url, fallback_title, summary, fallback_date, account); those with neither title nor body go."""
    p = pages.withColumn("_p", page(F.col("html")))
    node = lambda name: F.get(F.element_at("_p.nodes", name), F.lit(0))
    title = text.clean(F.coalesce(node("#activity-name"), F.nullif(F.col("_p.title"), F.lit("")), F.col("fallback_title")))
    body = text.clean(F.coalesce(F.nullif(node("#js_content"), F.lit("")), F.col("summary")))
    stamp = F.nullif(F.regexp_extract("html", r"""var ct\s*=\s*["'](\d+)["']""", 1), F.lit(""))
    p = p.withColumns({"_t": title, "_b": body, "_s": stamp}).filter("_t <> '' or _b <> ''")
    published = F.coalesce(dates.epoch_date(F.col("_s")).cast("string"), F.nullif(text.clean(F.col("fallback_date")), F.lit("")))
    return p.select(
        "seq", F.lit(values.ARTICLE).alias("source"), F.coalesce(F.nullif("_t", F.lit("")), text.excerpt(F.col("_b"))).alias("title"), F.col("_b").alias("original_text"),
        text.canonical_url(permalink(F.col("html"), F.col("url")), "mp\\.weixin\\.qq\\.com/s").alias("url"), published.alias("published_at"), text.clean(F.col("account")).alias("author"),
        F.lit(values.SCOPES["article"]).alias("content_scope"), F.lit(values.NOTES["article"]).alias("source_note"),
        F.when(F.col("_s").isNotNull(), values.DATED_BY["article"]).otherwise(values.DATED_BY["article found"]).alias("published_at_source"),
    )


def forum_posts(pages: DataFrame, today: Column) -> DataFrame:
    """Posts of forum pages(seq, html, url, fallback_title): the first floor's text, the first date that reads as one, replies."""
    p = pages.withColumn("_p", page(F.col("html")))
    node = lambda name: F.get(F.element_at("_p.nodes", name), F.lit(0))
    title = text.clean(F.coalesce(F.nullif(node(".core_title_txt"), F.lit("")), F.col("fallback_title")))
    body = text.clean(node(".d_post_content"))
    return p.select(
        "seq", F.lit(values.FORUM).alias("source"), title.alias("title"), F.coalesce(F.nullif(body, F.lit("")), title).alias("original_text"), text.canonical_url(F.col("url")).alias("url"),
        dates.relative_date(node(".l_post"), today).cast("string").alias("published_at"), text.clean(F.coalesce(node(".d_name"), node(".p_author_name"))).alias("author"),
        text.parse_count(node(".l_reply_num")).alias("comments"), F.when(body != "", values.SCOPES["floor"]).otherwise(values.SCOPES["title"]).alias("content_scope"), F.lit(values.NOTES["floor"]).alias("source_note"),
    )


def script_payloads(pages: DataFrame) -> DataFrame:
    """seq (page, then place), payload, section, channel_id of all JSON scripts of pages(seq, html, section, channel_id)."""
    each = pages.select("seq", "section", "channel_id", F.posexplode(page(F.col("html"))["scripts"]).alias("_place", "payload"))
    return each.select(F.struct("seq", "_place").alias("seq"), "payload", "section", "channel_id")
