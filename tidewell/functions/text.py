"""Text functions on columns. Null counts as the empty string, and the empty string stands for a missing value.

Java's \\s, \\d and \\W are ASCII by default; (?U) makes them Unicode, so that other scripts survive.
"""

from __future__ import annotations

import html
import re
import unicodedata
import urllib.parse
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Units of counts.
UNITS = {"千": 1_000, "万": 10_000, "億": 100_000_000, "亿": 100_000_000}
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """HTML entities to characters; Spark has no such function."""
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """NFKC, white space to single blanks, casefolded; Spark has neither NFKC nor casefolding."""
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()).casefold(), na_action="ignore").fillna("")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def clean(text: Column) -> Column:
    """Entities resolved only where the text has an ampersand: Python sees a null for all other rows."""
    has = F.contains(text, F.lit("&"))
    return collapse(F.when(has, unescape(F.when(has, text))).otherwise(text))


def excerpt(text: Column, size: int = 72) -> Column:
    short = collapse(text)
    return F.when(F.length(short) <= size, short).otherwise(F.concat(F.rtrim(F.substring(short, 1, size - 1)), F.lit("…")))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank, else the empty string."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def canonical_url(url: Column, keep_query: str | None = None) -> Column:
    """Without fragment, without query unless the URL matches keep_query; https where there's no scheme."""
    bare = F.regexp_replace(F.trim(url), r"(?s)[?#].*$", "")
    if keep_query:
        bare = F.when(url.rlike(keep_query), F.regexp_replace(F.trim(url), r"(?s)#.*$", "")).otherwise(bare)
    return F.when(F.coalesce(bare, F.lit("")) == "", "").when(bare.startswith("//"), F.concat(F.lit("https:"), bare)).when(bare.contains("://"), bare).otherwise(F.concat(F.lit("https://"), bare))


@F.pandas_udf(StringType())
def _joined_url(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    def join(base, href):
        try:
            return urllib.parse.urljoin(base or "", href or "")
        except ValueError:
            return href

    return pd.Series([join(b, h) for b, h in zip(bases, hrefs, strict=True)])


def absolute_url(base: Column, href: Column) -> Column:
    """href as seen from base; what has a host of its own stays in the JVM."""
    return F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), href).otherwise(_joined_url(base, href))


def entry_url(raw: Column, root: str) -> Column:
    """An entry of the channel at root: its address with at most the parameter subc; empty for posts and other places."""
    url = absolute_url(F.lit(root), clean(raw))
    path = F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), "/+$", "")
    part = F.regexp_extract(url, r"^[^?#]*\?(?:[^#]*&)?subc=([^&#]+)", 1)
    wrong = (clean(raw) == "") | clean(raw).contains("/post/") | (F.regexp_replace(path, "^[a-z]+:", "") != re.sub("^[a-z]+:", "", root.rstrip("/")))
    return F.when(wrong, "").when(part != "", F.concat(F.lit(f"{root}?subc="), part)).otherwise(F.lit(root))


def post_key(url: Column, source: Column, date: Column, title: Column) -> Column:
    """/post/<id>, else the canonical URL, else source|date|title without other characters than letters and digits."""
    special = F.regexp_extract(F.coalesce(url, F.lit("")), r"/post/([^?/#]+)", 1)
    plain = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\W+", ""))
    fallback = F.concat_ws("|", F.coalesce(source, F.lit("")), F.coalesce(date.cast("string"), F.lit("")), plain)
    return F.when(special != "", special).when(canonical_url(url) != "", canonical_url(url)).otherwise(fallback)


def is_meaningful(text: Column) -> Column:
    return (F.length(clean(text)) >= 3) & ~clean(text).rlike(r"(?U)^[\d\W_]+$")


def is_low_signal(text: Column, exact: list[str] = (), cleaned: bool = False) -> Column:
    """One of the exact texts, or fewer than two word characters besides #tags. `cleaned`: the text is so already."""
    text = text if cleaned else clean(text)
    rest = F.regexp_replace(F.regexp_replace(text, r"(?U)#\S+", ""), r"(?U)[\W_]", "")
    return text.isin(*exact) | (F.length(rest) < 2) if exact else F.length(rest) < 2


def has_any(text: Column, markers: list[str]) -> Column:
    """Whether a literal marker occurs, in this case."""
    out = F.lit(False)
    for m in markers:
        out = out | F.coalesce(text, F.lit("")).contains(m)
    return out


def is_relevant(text: Column, aliases: list[str]) -> Column:
    """Whether an alias occurs, whatever its case; full-width colons count as plain ones."""
    plain = F.replace(F.lower(clean(text)), F.lit("："), F.lit(":"))
    return has_any(plain, [a.lower().replace("：", ":") for a in aliases])


def is_roundup(title: Column, markers: list[str], aliases: list[str]) -> Column:
    """A list of many subjects: a marker, and at least three parts or another beginning than an alias."""
    text = clean(title)
    parts = F.size(F.filter(F.split(text, "[,，、|｜/；;]"), lambda p: F.trim(p) != ""))
    begins = F.lit(False)
    for a in aliases:
        begins = begins | F.lower(text).startswith(a.lower())
    return has_any(text, markers) & ((parts >= 3) | ~begins)


def is_campaign(text: Column, section: Column, author: Column, sections: list[str], authors: list[str], markers: list[str], cleaned: bool = False) -> Column:
    """An event section, an event account, or a marker in the text or the author's name."""
    both = F.lower((collapse if cleaned else clean)(F.concat_ws(" ", text, author)))
    return F.coalesce(section.isin(*sections), F.lit(False)) | has_any(author, authors) | has_any(both, markers)


def without_placeholder(text: Column, placeholders: list[str]) -> Column:
    """Empty where the text only says that there's none."""
    return F.when(text.isin(*placeholders), "").otherwise(F.coalesce(text, F.lit("")))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = []

    def handle_data(self, data):
        self.parts.append(data)


@F.pandas_udf(StringType())
def _tagless(texts: pd.Series) -> pd.Series:
    def one(text):
        p = _Text()
        p.feed(text)
        p.close()
        return " ".join(p.parts)

    return texts.map(one, na_action="ignore")


def strip_html(text: Column) -> Column:
    """Tags to blanks, then cleaned; of texts without < or & Python sees a null."""
    has = text.rlike("[<&]")
    return collapse(F.when(has, unescape(_tagless(F.when(has, text)))).otherwise(text))


def without_tail(text: Column, pattern: str) -> Column:
    """Without what begins with pattern, to the end."""
    return F.trim(F.regexp_replace(text, rf"(?s)(?U:\s)*(?:{pattern}).*$", ""))


def post_label(title_ko: Column, title: Column, translated: Column, original: Column, size: int = 68) -> Column:
    return excerpt(first_filled(title_ko, title, translated, original), size)


def title_key(title: Column) -> Column:
    """Letters, digits and _ alone, folded."""
    return F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\W+", ""))


def counted(label: Column, n: Column) -> Column:
    """A label with its number, as in lists of options."""
    return F.concat(label, F.lit(" ("), F.format_number(n, 0), F.lit(")"))


def needs_translation(text: Column) -> Column:
    return F.coalesce(text.rlike(HAN), F.lit(False))


def parse_count(text: Column) -> Column:
    """The first number times its unit, cut to an integer; null without a number."""
    plain = F.regexp_replace(text, ",", "")
    number = F.nullif(F.regexp_extract(plain, r"([0-9]+(?:\.[0-9]+)?)\s*[千万億亿]?", 1), F.lit(""))
    unit = F.regexp_extract(plain, r"[0-9]+(?:\.[0-9]+)?\s*([千万億亿]?)", 1)
    times = F.lit(1)
    for name, value in UNITS.items():
        times = F.when(unit == name, value).otherwise(times)
    return (number.try_cast("decimal(28,8)") * times).cast("bigint")


def number_or_zero(value: Column) -> Column:
    d = value.cast("string").try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), 0).otherwise(d.try_cast("bigint"))


def drop_repeats(lines: Column) -> Column:
    """Blank lines and lines equal to the one before go."""
    kept = F.filter(F.transform(lines, collapse), lambda x: x != "")
    return F.filter(kept, lambda x, i: (i == 0) | (x != F.get(kept, i - 1)))
