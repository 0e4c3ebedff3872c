"""Readers over captured payloads: stored JSON documents, feeds nested at any depth, JSON-LD and pages."""

from __future__ import annotations

import json
import math
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from . import values

POST = "source string, title string, original_text string, url string, published_at string, author string, views bigint, comments bigint, content_scope string, source_note string, source_section string, published_at_source string, is_official boolean, is_campaign boolean, is_low_signal boolean"


def read_post_store(spark: SparkSession, path: str, official_section: str | None = None) -> DataFrame:
    """Posts of {"posts": [...]} documents by key: rows without one of the four required texts go, unknown fields are ignored,
    of rows of one key the last stays, and the official flag of feed posts is worked out anew. A document that can't be
    read gives nothing here; unreadable() lists those."""
    kind = POST.replace(" string", ": string").replace(" bigint", ": bigint").replace(" boolean", ": boolean")
    docs = spark.read.schema(f"posts array<struct<{kind}>>, _corrupt_record string").json(path, multiLine=True)
    posts = docs.withColumn("_file", F.input_file_name()).select("_file", F.posexplode("posts").alias("seq", "p")).select("_file", F.col("seq").cast("long"), "p.*")
    for c in ("source", "title", "original_text", "url"):
        posts = posts.filter(text.clean(F.col(c)) != "")
    key = F.concat_ws("|", "source", text.post_key(F.col("url"), F.col("source"), F.col("published_at"), F.col("title")))
    last = posts.withColumn("post_key", key).groupBy("post_key").agg(F.max_by(F.struct("seq", *[f.split(" ")[0] for f in POST.split(", ")]), F.struct("_file", "seq")).alias("p")).select("post_key", "p.*")
    named = text.has_any(F.col("author"), values.OFFICIAL_MARKERS) | (F.coalesce(F.col("source_section") == official_section, F.lit(False)) if official_section else F.lit(False))
    return last.withColumn("is_official", F.when(F.col("source") == values.FEED, named).otherwise(F.col("is_official")))


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """file, message of the documents that aren't JSON objects."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.schema_of_variant(F.try_parse_json("value")).alias("kind"))
    return docs.filter(~F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False))).select("file", F.lit("not readable; only this run's results are used").alias("message"))


def read_translation_cache(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema("entries map<string,string>").json(path, multiLine=True)
    return docs.select(F.explode("entries").alias("chunk", "translated")).filter("translated is not null")


def walked(text: str | None):
    """The objects of a JSON text at any depth, in document order; none where it can't be read (nor where it nests deeper
    than the JSON library reads, about a thousand levels)."""
    try:
        stack = [json.loads(text)]
    except (TypeError, ValueError, RecursionError):
        return
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            yield node
            stack += reversed(node.values())
        elif isinstance(node, list):
            stack += reversed(node)


def found_lists(payload: Column, key: str) -> Column:
    """The elements, as JSON, of every list named `key` at any depth; nothing for text that isn't JSON."""

    @F.pandas_udf("array<string>")
    def find(payloads: pd.Series) -> pd.Series:
        def one(text):
            lists = (node[key] for node in walked(text) if isinstance(node.get(key), list))
            return [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for found in lists for x in found]

        return payloads.map(one)

    return find(payload)


#: Wrappers around one value, and what negative references stand for.
WRAPPERS = {"Ref", "ShallowRef", "Reactive", "ShallowReactive", "Readonly", "ShallowReadonly", "EmptyRef"}
SPECIAL = {-1: None, -2: None, -3: None, -4: None, -5: -0.0}


#: Characters up to which a payload is written out in full wherever its cells are referred to.
BUDGET = 16_000_000


def resolve_references(payload: Column, budget: int = BUDGET) -> Column:
    """A flattened payload (a JSON array whose integers point into it, element 0 being the root) as plain JSON; null where
    it can't be read or isn't an array. A reference back to a cell that is still being read, in document order from the
    root, becomes null, as do references to undefined, NaN and infinite values, which JSON lacks. Each cell is read once. Where
    shared cells, written out at each reference, would come to more than `budget` characters, each is written once, where
    it first comes, and is null elsewhere."""

    @F.pandas_udf("string")
    def resolve(payloads: pd.Series) -> pd.Series:
        def one(text):
            try:
                cells = json.loads(text)
                return Cells(cells).text(budget) if isinstance(cells, list) and cells else None
            except (TypeError, ValueError, RecursionError):
                return None

        return payloads.map(one)

    return resolve(payload)


class Cells:
    """The reference graph of a flattened payload. A cell's template is the JSON around its references: a list of texts and of
    numbers of other cells. Templates are made in one depth-first pass without recursion, which also finds the references
    that lead back, and sizes are summed when a cell's references are done."""

    #: Scalars of more characters are, beyond the budget, written once like objects and arrays.
    LONG = 100

    def __init__(self, cells: list):
        self.cells, self.templates, self.sizes = cells, {}, {}
        root = self._inline(cells[0], False) if isinstance(cells[0], int) and not isinstance(cells[0], bool) else [0]
        self.root = root[0]
        if isinstance(self.root, int):
            self._visit(self.root)

    def _refer(self, k: int) -> str | int:
        if k in SPECIAL or not 0 <= k < len(self.cells):
            return _json(SPECIAL.get(k))
        return k

    def _inline(self, value, cell: bool) -> list:
        """The template of a value; of a cell's own value, where a name in front says what it is, if `cell`."""
        if isinstance(value, dict):
            return self._object({str(k): self._inline(v, False) for k, v in value.items()})
        if isinstance(value, list):
            kind = value[0] if value and isinstance(value[0], str) else None
            if kind in WRAPPERS:
                return self._inline(value[1], False) if len(value) > 1 else ["null"]
            if cell and kind == "Date":
                return [_json(value[1] if len(value) > 1 else "")]
            if cell and kind == "Map":
                keys = map(self._key, value[1::2])
                return self._object({k: self._inline(v, False) for k, v in zip(keys, value[2::2], strict=False) if k is not None})
            return self._joined("[", [self._inline(v, False) for v in (value[1:] if cell and kind == "Set" else value)], "]")
        if isinstance(value, int) and not isinstance(value, bool) and not cell:
            return [self._refer(value)]
        return [_json(value)]

    def _key(self, value, hops: int = 0) -> str | None:
        """The key that a value of a Map stands for; none for objects, arrays and references that lead round."""
        while isinstance(value, int) and not isinstance(value, bool) and hops <= len(self.cells):
            at, hops = self._refer(value), hops + 1
            if isinstance(at, str):
                return at
            value = self.cells[at]
            if isinstance(value, list) and len(value) > 1 and isinstance(value[0], str) and value[0] in WRAPPERS:
                value = value[1]
            elif isinstance(value, list) and len(value) > 1 and value[0] == "Date":
                return str(value[1])
            else:
                break
        return None if isinstance(value, dict | list) else value if isinstance(value, str) else _json(value)

    def _object(self, items: dict[str, list]) -> list:
        return self._joined("{", [[_json(k) + ": ", *v] for k, v in items.items()], "}")

    @staticmethod
    def _joined(begin: str, items: list[list], end: str) -> list:
        out = [begin]
        for n, item in enumerate(items):
            out += [", ", *item] if n else item
        return [*out, end]

    def _visit(self, root: int) -> None:
        self.templates[root] = self._inline(self.cells[root], True)
        path, open_cells = [(root, 0)], {root}
        while path:
            cell, at = path.pop()
            template = self.templates[cell]
            while at < len(template):
                part = template[at]
                if isinstance(part, int):
                    if part in open_cells:
                        template[at] = "null"
                    elif part not in self.templates:
                        self.templates[part] = self._inline(self.cells[part], True)
                        path += [(cell, at + 1), (part, 0)]
                        open_cells.add(part)
                        break
                at += 1
            else:
                open_cells.discard(cell)
                self.sizes[cell] = sum(len(p) if isinstance(p, str) else self.sizes[p] for p in template)

    def text(self, budget: int) -> str:
        if isinstance(self.root, str):
            return self.root
        once, seen, out, left = self.sizes[self.root] > budget, set(), [], [self.root]
        while left:
            part = left.pop()
            if isinstance(part, str):
                out.append(part)
            elif part in seen:
                out.append("null")
            else:
                template = self.templates[part]
                if once and (len(template) > 1 or len(template[0] if isinstance(template[0], str) else "") > self.LONG):
                    seen.add(part)
                left += reversed(template)
        return "".join(out)


def _json(value) -> str:
    return "null" if isinstance(value, float) and not math.isfinite(value) else json.dumps(value, ensure_ascii=False)


ITEM = "struct<url: string, headline: string, description: string, datePublished: string, author: struct<name: string>>"


def json_ld_items(payload: Column) -> Column:
    """The items of a list page: @graph, then itemListElement, then item, with the list's name as section."""
    parsed = F.from_json(payload, f"`@graph` array<struct<name: string, itemListElement: array<struct<item: {ITEM}>>>>")
    return F.flatten(F.transform(parsed["@graph"], lambda g: F.transform(g["itemListElement"], lambda e: F.struct(g["name"].alias("section"), e["item"].alias("item")))))


def list_metadata(pages: DataFrame) -> DataFrame:
    """post_key, url, headline, description, published_at, author, section of the list JSON-LD of pages(seq, payload); of items
    of one key the last one stays, items without a key go."""
    each = pages.select("seq", F.posexplode(json_ld_items(F.col("payload"))).alias("pos", "x"))
    c = lambda name: text.clean(F.col(f"x.{name}"))
    rows = each.select("seq", "pos", F.regexp_extract(c("item.url"), r"/post/([^?/#]+)", 1).alias("post_key"), c("item.url").alias("url"), c("item.headline").alias("headline"), c("item.description").alias("description"), F.coalesce(dates.iso_date(F.col("x.item.datePublished")).cast("string"), F.lit("")).alias("published_at"), c("item.author.name").alias("author"), c("section").alias("section"))
    names = ["url", "headline", "description", "published_at", "author", "section"]
    return rows.filter("post_key <> ''").groupBy("post_key").agg(F.max_by(F.struct(*names), F.struct("seq", "pos")).alias("m")).select("post_key", "m.*")
