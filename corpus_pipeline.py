"""A corpus pipeline of four stages: language ID, near-dedup, secret redaction and packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame;
all but the last return the columns of documents. Models are trained here, on the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.language_id import held_out, language_of, learn
from tidewell.llm.near_dups import near_duplicates
from tidewell.llm.packing import pack
from tidewell.llm.secret_scan import redact
from tidewell.llm.shared import Scratch, fresh
from tidewell.llm.tokens import vocabulary


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents of no language (`und`: null text, or no letter) and writes the prediction where lang is null.

    A label that is there stays. Where no document has a label nothing can be learned, and all are kept as they are. Repeated
    rows and ties go alike (ties to the language first in order); texts are parsed whole; the columns stay those of docs,
    whatever their names; an empty table gives an empty one.
    """
    samples = learn(docs.filter(~held_out()))
    if not samples:
        return docs
    judged = fresh(docs, "judged")
    found = docs.withColumn(judged, language_of(spark, F.col("text"), samples)).filter(F.col(f"{judged}.lang_pred") != "und")
    return found.withColumn("lang", F.coalesce("lang", F.col(f"{judged}.lang_pred"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id in each group of near-duplicates on five-word shingles.

    Rows of a null doc_id, null or empty texts stay; all rows of a kept doc_id stay, repeated ones too; all columns stay.
    """
    judged = near_duplicates(docs, words=5, percent=80)
    gone = judged.filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; what the scan finds is replaced in the text, and n_chars follows. Null texts stay null; other
    columns stay as they are."""
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece with its sequence and place. A null text is packed as its end id; null doc_ids and repeated rows are packed
    like any other; columns other than doc_id and text are left behind."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("language_id", identify_languages),
    ("near_dups", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]
#: Cross-parsing, signatures and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    done = None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if done:
            scratch.drop(done)
        done = name
    return STAGES[-1][1](spark, docs, sf_dir)
