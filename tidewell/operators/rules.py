"""Classification by rules that are data: [(label, [aliases])], in order.

Aliases are folded like the text. Those of a group claim their occurrences longest first, ties in declared order; what
one has claimed, no later one can. Aliases of a-z, 0-9, _, +, - and blanks need neighbours other than a-z and 0-9. One pass
of an automaton over a text finds the aliases of all groups of all rule sets at once; claims are settled only among the hits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_of
from ..functions.text import number_or_zero

#: The fallback, content types, and role and eligibility of each.
OTHER = "기타"
OFFICIAL, EVENT, GUIDE, NATURAL = "공식 공지", "이벤트·홍보", "공략·영상", "자연 발생"
TYPES = (NATURAL, GUIDE, EVENT, OFFICIAL)
ROLES = {NATURAL: "유저 반응 후보", GUIDE: "콘텐츠·공략 참고", EVENT: "홍보·이벤트 참고", OFFICIAL: "공식 배경 참고"}
#: The columns of an analysed post, in order.
ANALYSED = """date date, source string, category string, all_categories string, content_type string, analysis_role string,
trend_eligible boolean, title string, title_ko string, original_text string, translated_text string, content_scope string,
source_note string, source_section string, published_at_source string, is_official boolean, is_campaign boolean,
is_low_signal boolean, keyword_labels array<string>, keyword_text string, keyword_counts map<string, int>, views bigint,
engagement bigint, author string, url string, translation_error string"""

Rules = list[tuple[str, list[str]]]


def folded(text: str | None) -> str:
    """NFKC, white space to single blanks, casefolded."""
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold() if text else ""


def ordered(aliases: Iterable[str]) -> list[str]:
    """Folded aliases, longest first."""
    return sorted(dict.fromkeys(f for a in aliases if (f := folded(a))), key=len, reverse=True)


class Matcher:
    """Counts of the groups, each a list of aliases, in folded texts."""

    def __init__(self, groups: tuple[tuple[str, ...], ...]):
        uses: dict[str, list[tuple[int, int]]] = {}
        for g, aliases in enumerate(groups):
            for rank, alias in enumerate(ordered(aliases)):
                uses.setdefault(alias, []).append((g, rank))
        self.n, self.automaton = len(groups), ahocorasick.Automaton()
        for alias, of in uses.items():
            self.automaton.add_word(alias, (len(alias), bool(re.fullmatch(r"[a-z0-9_+\- ]+", alias)), of))
        if uses:
            self.automaton.make_automaton()

    def counts(self, text: str) -> list[int]:
        out, hits = [0] * self.n, {}
        if not text or not len(self.automaton):
            return out
        for last, (size, whole, uses) in self.automaton.iter(text):
            start, end = last + 1 - size, last + 1
            if whole and (_joins(text, start - 1) or _joins(text, end)):
                continue
            for g, rank in uses:
                hits.setdefault(g, []).append((rank, start, end))
        for g, found in hits.items():
            taken, claims = bytearray(len(text)) if len(found) > 1 else None, 0
            for _, start, end in sorted(found):
                if taken is None or not any(taken[start:end]):
                    claims += 1
                    if taken is not None:
                        taken[start:end] = b"\1" * (end - start)
            out[g] = claims
        return out


def _joins(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at] in "abcdefghijklmnopqrstuvwxyz0123456789"


@lru_cache(8)
def matcher(groups: tuple[tuple[str, ...], ...]) -> Matcher:
    return Matcher(groups)


def _tuples(groups: Rules) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(aliases) for _, aliases in groups)


def claimed(groups: Rules):
    """An Arrow UDF from a text to the counts of all groups."""
    each = _tuples(groups)

    @F.pandas_udf("array<int>")
    def count(texts: pd.Series) -> pd.Series:
        m = matcher(each)
        return texts.map(lambda t: m.counts(folded(t)))

    return count


def alias_count(text: Column, aliases: list[str]) -> Column:
    """Claimed occurrences of one group."""
    return F.get(claimed([("", aliases)])(text), F.lit(0))


def matched(sets: dict[str, Rules]):
    """An Arrow UDF of (title, title_ko, original, translated) to the counts that a post needs, from one fold of each
    field: `categories` over all fields joined by blanks, `event` and `guide` over title and original, and the largest
    count of each of `keywords` in any field, with the place of the first field that has it."""
    categories, kinds, keywords = (_tuples(sets[k]) for k in ("categories", "types", "keywords"))

    @F.pandas_udf("categories array<int>, types array<int>, keywords array<int>, first array<int>")
    def count(title: pd.Series, title_ko: pd.Series, original: pd.Series, translated: pd.Series) -> pd.DataFrame:
        all_of, type_of, words_of = matcher(categories), matcher(kinds), matcher(keywords)
        rows = []
        for fields in zip(title, original, title_ko, translated, strict=True):
            t, o, tk, tr = map(folded, fields)
            source = " ".join(filter(None, (t, o)))
            whole = " ".join(filter(None, (t, tk, o, tr))) if tk or tr else source
            most, first = [0] * len(keywords), [4] * len(keywords)
            for k, field in enumerate((t, o, tk, tr)):
                for w, n in enumerate(words_of.counts(field) if field else ()):
                    if n:
                        most[w], first[w] = max(most[w], n), min(first[w], k)
            rows.append((all_of.counts(whole), type_of.counts(source), most, first))
        return pd.DataFrame(rows, columns=["categories", "types", "keywords", "first"])

    return count


def labels_of(counts: Column, groups: Rules) -> Column:
    """Labels with a count, highest first, then in order of rules."""
    each = F.transform(counts, lambda n, k: F.struct((-n).alias("s"), k.alias("o")))
    names = F.array(*[F.lit(label) for label, _ in groups]) if groups else F.array().cast("array<string>")
    return F.transform(F.array_sort(F.filter(each, lambda x: x["s"] < 0)), lambda x: F.get(names, x["o"]))


def categories(counts: Column, groups: Rules) -> Column:
    """labels_of(), or the fallback alone where no group has a count."""
    found = labels_of(counts, groups)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(OTHER)))


def content_type(source: Column, official: Column, event: Column, guide: Column, official_source: str | None = None, video_source: str | None = None) -> Column:
    """The first that holds: the official source or flag; an event alias; a guide alias; the video source; else natural."""
    named = lambda s: F.coalesce(source == s, F.lit(False)) if s else F.lit(False)
    return F.when(named(official_source) | F.coalesce(official, F.lit(False)), OFFICIAL).when(event > 0, EVENT).when((guide > 0) | named(video_source), GUIDE).otherwise(NATURAL)


def role(kind: Column) -> Column:
    out = F.lit(ROLES[OFFICIAL])
    for name, text in ROLES.items():
        out = F.when(kind == name, text).otherwise(out)
    return out


def registered(groups: Rules) -> list[str]:
    """All aliases of the rules, as they are written."""
    return sorted({a for _, aliases in groups for a in aliases})


def analysed(posts: DataFrame, category_rules: Rules, keyword_rules: Rules, event: list[str], guide: list[str], official_source: str | None = None, video_source: str | None = None) -> DataFrame:
    """The columns of ANALYSED, in order, of posts; what posts don't have is empty. Other columns (a post's seq or key)
    follow. In no order: see by_recency()."""
    have = set(posts.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
    number = lambda c: number_or_zero(F.col(c)) if c in have else F.lit(0).cast("long")
    count = matched({"categories": category_rules, "types": [(EVENT, event), (GUIDE, guide)], "keywords": keyword_rules})
    p = posts.withColumn("_n", count(text("title"), text("title_ko"), text("original_text"), text("translated_text")))
    found = categories(F.col("_n.categories"), category_rules)
    names = F.array(*[F.lit(label) for label, _ in keyword_rules]) if keyword_rules else F.array().cast("array<string>")
    hits = F.filter(F.transform("_n.keywords", lambda n, k: F.struct(F.get("_n.first", k).alias("f"), k.alias("k"), n.alias("n"))), lambda x: x["n"] > 0)
    hits = F.transform(F.array_sort(hits), lambda x: F.struct(F.get(names, x["k"]).alias("key"), x["n"].alias("value")))
    kind = content_type(text("source"), flag("is_official"), F.get("_n.types", F.lit(0)), F.get("_n.types", F.lit(1)), official_source, video_source)
    p = p.withColumns({"_found": found, "_hits": hits, "_kind": kind})
    keys = F.transform("_hits", lambda x: x["key"])
    date = F.col("published_at") if "published_at" in have else F.lit(None)
    made = {
        "date": date if dict(posts.dtypes).get("published_at") == "date" else date_of(date.cast("string")), "category": F.get("_found", F.lit(0)), "all_categories": F.array_join("_found", ", "), "content_type": F.col("_kind"), "analysis_role": role(F.col("_kind")),
        "trend_eligible": F.col("_kind") == NATURAL, "keyword_labels": keys, "keyword_text": F.array_join(keys, ", "), "keyword_counts": F.map_from_entries("_hits"), "views": number("views"), "engagement": number("comments"),
    }
    names, kinds = zip(*(f.strip().split(" ", 1) for f in re.split(r",(?![^<]*>)\s*", ANALYSED)), strict=True)
    columns = [(made[n] if n in made else flag(n) if k == "boolean" else text(n)).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)]
    return p.select(*columns, *[c for c in posts.columns if c not in names and c not in ("published_at", "comments")])


def nothing_analysed(spark) -> DataFrame:
    """The empty result, with its columns."""
    return spark.createDataFrame([], ANALYSED)


def by_recency(analysed_posts: DataFrame, last: str = "seq") -> DataFrame:
    """Newest first, undated last; then engagement, views and the unique column `last`."""
    return analysed_posts.orderBy(F.desc_nulls_last("date"), F.desc("engagement"), F.desc("views"), last)
