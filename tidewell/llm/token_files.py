"""Operator 1: token ids in seekable Zstandard files.

Layout of a file, all integers little-endian:

* a skippable frame with JSON: bytes an id takes (2 or 4), end id, number of documents;
* one independent Zstandard frame a document, with its ids;
* a skippable frame with the directory: for each document doc_id (int64), a null flag (uint8) and the
  number of ids in this file before it (uint64);
* the seek table of the public Zstandard Seekable Format: for each frame its compressed size, its
  decompressed size and a checksum (low 32 bits of XXH64 of the content), then the number of frames,
  a descriptor byte and the magic number. Skippable frames have table entries too, of decompressed size 0.

A reader fetches the tail of the file, then only the byte ranges of the frames it wants.

Documents are range-partitioned and sorted by (doc_id, a hash of the text, text); file k holds no higher ids
than file k+1. A task writes under an attempt's own name and renames at its end, so a retried task replaces its file by
an equal one. Only one row a file (its counts) leaves the writing stage.

Defined results: null text counts as empty (only the end id); a null doc_id sorts first; repeated doc_ids
are all written, ordered by that hash and the text; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, read
from .tokens import library_encoder, vocabulary

SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1  # fixed values of the public format
ENTRY, FOOTER, DIRECTORY = struct.Struct("<III"), struct.Struct("<IBI"), np.dtype([("doc_id", "<i8"), ("null", "u1"), ("start", "<u8")])
MANIFEST = "part int, name string, n_docs long, n_tokens long"


def open_folder(uri: str):
    """(file system, path) of a folder, for tasks. Paths without a scheme and the schemes that pyarrow knows (file, hdfs, s3, gs)
    work; s3a and s3n are read as s3. Other stores need a mount."""
    uri = re.sub("^s3[an]:", "s3:", uri)
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _skippable(payload: bytes, magic: int = SKIPPABLE) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


class Writer:
    """Writes one file; add() takes documents in order."""

    def __init__(self, out, width: int, end_id: int, level: int):
        import xxhash
        import zstandard

        self.out, self.width, self.level = out, width, level
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.hash = xxhash.xxh64_intdigest
        self.table, self.directory, self.n_tokens = [], [], 0
        self._put(_skippable(json.dumps({"width": width, "end_id": end_id}).encode()), 0, 0)

    def _put(self, frame: bytes, size: int, checksum: int) -> None:
        self.out.write(frame)
        self.table.append(ENTRY.pack(len(frame), size, checksum))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self._put(self.compress(raw), len(raw), self.hash(raw) & 0xFFFFFFFF)
        self.directory.append((doc_id or 0, doc_id is None, self.n_tokens))
        self.n_tokens += len(ids)

    def close(self) -> None:
        self._put(_skippable(np.array(self.directory, DIRECTORY).tobytes()), 0, 0)
        table = b"".join(self.table) + FOOTER.pack(len(self.table), 0x80, SEEK_MAGIC)
        self.out.write(_skippable(table, SEEK_SKIPPABLE))


class Reader:
    """Reads single documents of one file by byte range and verifies their checksums."""

    def __init__(self, source):
        import xxhash
        import zstandard

        self.source, self.size = source, source.size()
        self.decompress = zstandard.ZstdDecompressor().decompress
        self.hash = xxhash.xxh64_intdigest
        count, _, magic = FOOTER.unpack(self._at(self.size - FOOTER.size, FOOTER.size))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        table = self._at(self.size - FOOTER.size - count * ENTRY.size, count * ENTRY.size)
        self.entries = np.frombuffer(table, "<u4").reshape(count, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        self.width = json.loads(self._frame(0)[8:])["width"]
        self.directory = np.frombuffer(self._frame(count - 1)[8:], DIRECTORY)

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def _frame(self, k: int) -> bytes:
        return self._at(int(self.offsets[k]), int(self.entries[k, 0]))

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        _, size, checksum = self.entries[k + 1]
        raw = self.decompress(self._frame(k + 1), max_output_size=int(size))
        if len(raw) != size or self.hash(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"document {k} is damaged")
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, level: int = 3) -> DataFrame:
    """Encodes docs(doc_id, text) into files under folder; returns the manifest, one row a file with the
    number of ids in all files before it (base)."""
    spark = docs.sparkSession
    width = 2 if end_id < 65536 and _vocabulary_size(tokenizer) <= 65536 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = library_encoder(tokenizer), TaskContext.get()
        part, end = context.partitionId(), np.array([end_id], "<u4")
        name, n_docs, writer, out = f"part-{part:06d}.tok", 0, None, None
        files, path = open_folder(folder)
        tmp = f"{path}/_{name}.{context.taskAttemptId()}"
        for batch in batches:
            for doc_id, text in _rows(batch):
                if writer is None:
                    files.create_dir(path, recursive=True)
                    out = files.open_output_stream(tmp)
                    writer = Writer(out, width, end_id, level)
                ids = np.frombuffer(encode(text), "<u4")
                writer.add(doc_id, np.concatenate([ids, end]))
                n_docs += 1
        if writer is not None:
            writer.close()
            out.close()
            files.move(tmp, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs]), pa.array([writer.n_tokens])], ["part", "name", "n_docs", "n_tokens"])

    order = ["doc_id", "_dice", "text"]  # a doc_id of very many rows is split
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("_dice")).repartitionByRange("doc_id", "_dice").sortWithinPartitions(*order)
    ordered.drop("_dice").mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    return manifest(spark, folder)


def _rows(batch: pa.RecordBatch, step: int = 500) -> Iterator[tuple[int | None, str | None]]:
    for i in range(0, batch.num_rows, step):
        some = batch.slice(i, step)
        yield from zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)


def _vocabulary_size(tokenizer: str) -> int:
    return library_encoder(tokenizer).tokenizer.get_vocab_size()


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file. The window sees one row a file, never documents."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, folder: str, per_document: Callable[[np.ndarray], tuple], schema: str, doc_ids: list[int] | None = None) -> DataFrame:
    """A row a stored document: doc_id, start (ids of all documents before it) and what per_document makes
    of its ids. With doc_ids only those documents' frames are read and decompressed."""
    files = manifest(spark, folder)
    wanted = None if doc_ids is None else np.array(doc_ids, np.int64)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = open_folder(folder)
        for batch in batches:
            for name, base in zip(batch["name"], batch["base"], strict=True):
                with fs.open_input_file(f"{path}/{name}") as source:
                    reader = Reader(source)
                    d = reader.directory
                    chosen = np.arange(len(d)) if wanted is None else np.flatnonzero(np.isin(d["doc_id"], wanted) & (d["null"] == 0))
                    for some in np.array_split(chosen, max(1, -(-len(chosen) // 2000))):
                        made = [per_document(reader.ids(int(k))) for k in some]
                        ids = pd.Series(d["doc_id"][some], dtype="Int64").mask(d["null"][some] == 1)
                        out = pd.DataFrame(made, columns=names)
                        out.insert(0, "doc_id", ids)
                        out.insert(1, "start", d["start"][some].astype("int64") + base)
                        yield out

    count = max(1, files.count())
    return files.repartition(count, "part").mapInPandas(load, f"doc_id long, start long, {schema}")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "token-files").path("ids")
    write_token_files(read(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder, lambda ids: (len(ids), zlib.crc32(ids.tobytes())), "n_tokens long, ids_crc32 long")
