"""Operator 2: secret scans.

An Aho-Corasick automaton over all literal openings (letters A-Z folded where a kind asks for it) finds
where a secret may begin; only there is the kind's regular expression tried, anchored at that place. Hex
digests have no literal opening, their runs are found by their character class. Kinds with an embedded
checksum keep a match only if its checksum holds.

Kinds, in the order in which spans at one place are listed:

* base: assign (the whole `name = value` match), access, hex, as leftmost non-overlapping matches of each kind;
* added: `forge` (a two- or three-letter family prefix, `_`, 30 base-62 characters and the CRC-32 of those
  in 6 more), `package` (npm_ with the same checksum), `card` (13 to 19 digits after a card keyword, Luhn)
  and `iban` (after the keyword iban, remainder 1 modulo 97).

Positions are code points, ends exclusive. Defined results: null text counts as empty (no spans); a null
doc_id and repeated rows give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_texts, read
from .tokens import held

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of those between prefix and checksum."""
    body, check = match["body"], match["check"]
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out == check


def luhn(match: re.Match) -> bool:
    digits = [int(c) for c in match["body"] if c.isdigit()]
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return 13 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def mod97(match: re.Match) -> bool:
    body = match["body"].replace(" ", "")
    return 15 <= len(body) <= 34 and int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    openings: tuple[str, ...] = ()  # lower-case; none: found by the pattern itself
    keep: Callable[[re.Match], bool] = field(default=lambda m: True)
    base: bool = False


KINDS = (
    Kind("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ("password", "passwd", "secret", "token", "apikey", "api_key"), lambda m: len(m[2]) >= 8, True),
    Kind("access", r"AKIA[A-Z0-9]+", ("akia",), lambda m: m.end() - m.start() >= 16, True),
    Kind("hex", r"[0-9a-f]{32,}", (), base=True),
    Kind("forge", r"gh[pousr]_(?P<body>[0-9A-Za-z]{30})(?P<check>[0-9A-Za-z]{6})(?![0-9A-Za-z])", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), crc_base62),
    Kind("package", r"npm_(?P<body>[0-9A-Za-z]{30})(?P<check>[0-9A-Za-z]{6})(?![0-9A-Za-z])", ("npm_",), crc_base62),
    Kind("card", r"(?ai:card)(?ai: number| no)?\x20?[:=#]?\x20?(?P<body>[0-9](?:[ -]?[0-9]){12,18})(?![0-9])", ("card",), luhn),
    Kind("iban", r"(?ai:iban)\x20?[:=#]?\x20?(?P<body>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Z0-9])", ("iban",), mod97),
)


class Scanner:
    """Finds the spans of all kinds in a text."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        import ahocorasick

        self.kinds = kinds
        self.patterns = [re.compile(k.pattern) for k in kinds]
        self.free = [i for i, k in enumerate(kinds) if not k.openings]
        self.automaton = ahocorasick.Automaton()
        for i, kind in enumerate(kinds):
            for word in kind.openings:
                self.automaton.add_word(word, (len(word), (*self.automaton.get(word, (0, ()))[1], i)))
        self.automaton.make_automaton()

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind's number, end), in order."""
        if not text:
            return []
        folded = text.lower() if text.isascii() else text.encode().lower().decode()  # A-Z only: positions stay
        hits = sorted((end + 1 - size, i) for end, (size, kinds) in self.automaton.iter(folded) for i in kinds)
        out, done = [], [0] * len(self.kinds)
        for start, i in hits:
            if start >= done[i] and (m := self.patterns[i].match(text, start)):
                done[i] = m.end()
                if self.kinds[i].keep(m):
                    out.append((start, i, m.end()))
        for i in self.free:
            out += [(m.start(), i, m.end()) for m in self.patterns[i].finditer(text) if self.kinds[i].keep(m)]
        return sorted(out)

    def listed(self, spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{self.kinds[i].name}:{a}:{b}" for a, i, b in spans)


def scanner() -> Scanner:
    return held(Scanner)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the array of spans(kind, start, end) of each document; no shuffle."""

    def make():
        s = scanner()
        return lambda texts: ([[{"kind": KINDS[i].name, "start": a, "end": b} for a, i, b in s.spans(t)] for t in texts],)

    return map_texts(docs, make, "spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with each stretch that spans cover replaced by mask; n_chars, if there, follows the text. A null
    text stays null; all rows and columns stay."""

    @F.pandas_udf("string")
    def cover(texts: pd.Series) -> pd.Series:
        s = scanner()

        def one(text):
            spans = s.spans(text)
            if not spans:
                return text
            out, at = [], 0
            for a, _, b in spans:
                if a >= at:
                    out += [text[at:a], mask]
                at = max(at, b)
            return "".join(out) + text[at:]

        return texts.map(one, na_action="ignore")

    out = docs.withColumn("text", cover("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans of each document."""

    def make():
        s = scanner()

        def report(texts):
            rows = []
            for text in texts:
                spans = s.spans(text)
                base = [x for x in spans if KINDS[x[1]].base]
                counts = [sum(x[1] == i for x in base) for i in range(3)]
                rows.append((*counts, hashlib.sha256(s.listed(base).encode()).hexdigest(), s.listed(spans)))
            return tuple(zip(*rows, strict=True))

        return report

    return map_texts(docs, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read(spark, sf_dir, "documents"))
