"""Operator 7: language identification by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of labelled text. A word, with a blank
before and after it, is cut from the left into the longest stretches that occur in that text; a stretch
that occurs nowhere costs a character. A document is cross-parsed word by word, so the numbers of phrases
of repeated words are remembered. The language with the fewest phrases, divided by those that the
characters would make one by one, wins; ties go to the language first in order.

Learning is the only bounded part: about `texts` labelled documents a language, chosen by a hash of doc_id
against each language's own count, and of each at most `chars` characters from a hashed place. Every
document is parsed in full.

Defined results: `und` with score 0 for a text that is null or has no letter, and where nothing was
learned; a null doc_id counts as held out and isn't learned from; repeated rows give a row each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_texts, read
from .tokens import Memo, held

WORD = re.compile(r"[^\W\d_]+")


class SuffixAutomaton:
    """All substrings of a text, with the longest match from a place on."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and c not in self.next[at]:
                self.next[at][c] = new
                at = link[at]
            if at >= 0:
                to = self.next[at][c]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[to]))
                    link.append(link[to])
                    length.append(length[at] + 1)
                    while at >= 0 and self.next[at].get(c) == to:
                        self.next[at][c] = copy
                        at = link[at]
                    link[to] = link[new] = copy
            last = new

    def phrases(self, text: str) -> int:
        """How many longest matches, one after another, make up the text."""
        count, state, states = 0, 0, self.next
        for c in text:
            to = states[state].get(c)
            if to is None:
                count += state != 0
                to = states[0].get(c, 0)
                count += to == 0  # a character that the text doesn't have
            state = to
        return count + (state != 0)


class Model:
    """samples: (language, text), in order."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [x for x, _ in samples]
        self.automata = [SuffixAutomaton(text) for _, text in samples]
        self.memo = Memo(lambda word: tuple(a.phrases(f" {word} ") for a in self.automata), 300_000)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(WORD.findall(text.lower())) if text else None
        if not words or not self.languages or not any(c.isalpha() for c in text):
            return "und", 0.0
        phrases = np.array([self.memo[w] for w in words]).T @ np.fromiter(words.values(), np.int64, len(words))
        share = phrases / sum((len(w) + 2) * n for w, n in words.items())
        best = int(np.argmin(share))
        others = np.delete(share, best)
        return self.languages[best], float(1 - share[best] / others.min()) if len(others) else 1.0


def learn(docs: DataFrame, texts: int = 300, chars: int = 400, letters: int = 60_000) -> dict[str, str]:
    """A sample of text by language of the rows of docs(doc_id, text, lang): at most `letters` characters each."""
    labelled = docs.filter("lang is not null and text is not null and doc_id is not null")
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = {x: n for x, n in labelled.groupBy("lang").count().collect()}  # a row a language
    share = F.create_map(*[F.lit(v) for x, n in counts.items() for v in (x, min(1.0, 1.5 * texts / n))]) if counts else None
    if share is None:
        return {}
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    chosen = labelled.filter(dice < share[F.col("lang")]).select("lang", dice.alias("dice"), F.substring("text", place, F.lit(chars)).alias("text"))
    samples: dict[str, str] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r["lang"], r["dice"], r["text"])):  # about 1.5 * texts stretches a language
        text = samples.get(row["lang"], "")
        samples[row["lang"]] = (text + " ".join(["", *WORD.findall(row["text"].lower()), ""]))[:letters]
    return samples


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def predict_languages(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred and score of docs(doc_id, text); no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # bounded: letters * languages

    def make():
        model = held(Model, tuple(sorted(shared.value.items())))
        return lambda texts: tuple(zip(*[model.predict(t) for t in texts], strict=True))

    return map_texts(docs, make, "lang_pred string, score double")


def language_of(spark: SparkSession, text: Column, samples: dict[str, str]) -> Column:
    """The prediction for a column of texts, as a struct (lang_pred, score); other columns don't enter Python. It counts as
    not deterministic, so that Spark works it out once where a filter and a projection use it."""
    shared = spark.sparkContext.broadcast(samples)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = held(Model, tuple(sorted(shared.value.items())))
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"]).astype({"lang_pred": object, "score": float})

    return predict.asNondeterministic()(text)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    judged = predict_languages(docs, learn(docs.filter(~held_out())))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
