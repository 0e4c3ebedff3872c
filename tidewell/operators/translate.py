"""Translation through a cache: split, look up, translate what is missing, put together again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import needs_translation
from ..sources import values

STOPS = "。！？\n"  # fixed values


def split_text(text: str | None, limit: int) -> list[str]:
    """Chunks of at most limit characters: cut after the last stop mark if that is in the second half, else hard; white space
    around a chunk goes before the next one is cut."""
    out, left = [], (text or "").strip()
    while len(left) > limit:
        stop = max(left.rfind(c, 0, limit) for c in STOPS)
        end = stop + 1 if stop >= limit // 2 else limit
        out.append(left[:end].strip())
        left = left[end:].strip()
    return [c for c in (*out, left) if c]


def chunks(posts: DataFrame, text: str = "original_text", limit: int = 800) -> DataFrame:
    """seq, pos, chunk."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, limit))

    return posts.select("seq", F.posexplode(split(F.col(text))).alias("pos", "chunk"))


def pending(parts: DataFrame, cache: DataFrame) -> DataFrame:
    return parts.select("chunk").distinct().join(cache, "chunk", "left_anti")


def translate(missing: DataFrame, send: Callable[[list[str]], list[str | None]], most: int = 8, chars: int = 1200, failures: int = 8) -> DataFrame:
    """chunk, translated of what send() translates, in batches of at most so many items and characters. A partition
    stops after so many failures in a row; chunks without a result stay pending."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for batch in batches:
            queue, out = [], []
            texts = batch["chunk"].tolist()
            for k, text in enumerate(texts):
                queue.append(text)
                if len(queue) == most or k + 1 == len(texts) or sum(map(len, queue)) + len(texts[k + 1]) > chars:
                    if failed < failures:
                        found = [(c, t) for c, t in zip(queue, send(queue), strict=True) if t]
                        failed = 0 if found else failed + 1
                        out += found
                    queue = []
            yield pd.DataFrame(out, columns=["chunk", "translated"])

    return missing.select("chunk").mapInPandas(run, "chunk string, translated string")


def reassemble(parts: DataFrame, cache: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """seq, translated_text (empty if a chunk is missing), failed; with posts(seq) a row for those without a chunk too."""
    met = parts.join(cache.select("chunk", "translated"), "chunk", "left")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "translated"))), lambda x: x["translated"]), "\n")
    sums = met.groupBy("seq").agg(whole.alias("_text"), F.bool_or(F.col("translated").isNull()).alias("failed"))
    if posts is not None:
        sums = posts.select("seq").join(sums, "seq", "left").na.fill("", ["_text"]).na.fill(False, ["failed"])
    return sums.select("seq", F.when(F.col("failed"), "").otherwise(F.col("_text")).alias("translated_text"), "failed")


#: Field, what it translates, and its name in messages.
TRANSLATED = (("title_ko", "title", values.TITLE_LABEL), ("translated_text", "original_text", values.BODY_LABEL))


def parts_of(posts: DataFrame, needs: Callable[[Column], Column] = needs_translation, limit: int = 800) -> DataFrame:
    """seq, field, pos, chunk of the fields that need translation."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, limit))

    fields = F.array(*[F.struct(F.lit(to).alias("field"), F.col(of).alias("text")) for to, of, _ in TRANSLATED])
    each = posts.select("seq", F.explode(fields).alias("f")).select("seq", "f.*").filter(needs(F.col("text")))
    return each.select("seq", "field", F.posexplode(split(F.col("text"))).alias("pos", "chunk"))


def translated_posts(posts: DataFrame, parts: DataFrame, cache: DataFrame, needs: Callable[[Column], Column] = needs_translation) -> DataFrame:
    """posts with title_ko, translated_text and translation_error: fields that need no translation are copied, those with a
    missing chunk are empty and named in the error."""
    met = parts.join(cache.select("chunk", "translated"), "chunk", "left")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "translated"))), lambda x: x["translated"]), "\n")
    fields = met.groupBy("seq", "field").agg(F.when(F.bool_and(F.col("translated").isNotNull()), whole).alias("text"))
    wide = fields.groupBy("seq").agg(*[F.max(F.when(F.col("field") == to, F.col("text"))).alias(f"_{to}") for to, _, _ in TRANSLATED])
    out, errors = posts.join(wide, "seq", "left"), []
    for to, of, label in TRANSLATED:
        needed = F.coalesce(needs(F.col(of)), F.lit(False))
        out = out.withColumn(to, F.when(needed, F.coalesce(f"_{to}", F.lit(""))).otherwise(F.trim(F.coalesce(of, F.lit("")))))
        errors.append(F.when(needed & F.col(f"_{to}").isNull(), f"{label}: {values.FAILED}"))
    return out.withColumn("translation_error", F.array_join(F.array_compact(F.array(*errors)), ", ")).drop(*[f"_{to}" for to, _, _ in TRANSLATED])


def extended(cache: DataFrame, made: DataFrame) -> DataFrame | None:
    """The cache with new entries, blank ones left out; None if there is nothing new to write. Write it to a new path."""
    made = made.filter(F.trim(F.coalesce("translated", F.lit(""))) != "")
    if made.isEmpty():
        return None
    return cache.join(made.select("chunk"), "chunk", "left_anti").unionByName(made.select("chunk", "translated").dropDuplicates(["chunk"]))
