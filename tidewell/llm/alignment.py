"""Operator 13: aligning the tokens of two vocabularies on the bytes of each text.

Python only tokenises: it gives the ids of both vocabularies and the byte offset at which each token ends. Texts are cut before blanks
and line ends, where a token of both ends; the different parts of a few megabytes of text are tokenised and aligned once, as if
they were one text, and each document takes the groups and links of its parts. All else is Spark's higher-order functions. The ends
of both, sorted together, need no search: an end that is the i-th of its own list and the k-th of all has k - i ends of
the other list before it, so the token of the other list that it falls into is number k - i. Each different end closes
one stretch of bytes that lies in one token of each list, and two tokens that overlap share exactly one such stretch:
these are the links. Every end knows so whether it is a cut, and the numbers of tokens that have ended at the cuts bound the groups; a
sequence goes over the tokens of those that have several. (aggregate is not needed: nothing is carried along.)

How often a pair of ids is linked is counted corpus-wide. The counted pairs come back by a broadcast where they are few
(checked), else by a join that splits common pairs.

Defined results: texts that are null or empty, or whose bytes a vocabulary doesn't give back, have no tokens, zeros and
an empty digest. Special tokens are plain text. Null and repeated doc_ids give a row each; an empty table an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .shared import Scratch, only, read
from .tokens import BYTE_CHARS, LibraryEncoder, Memo, held, vocabulary

#: Pairs that may be broadcast (about 50 bytes each).
BROADCAST_PAIRS = 1_000_000
#: Rows and bytes of text that are tokenised before they are handed on; a text that is longer goes alone.
ROWS, BYTES = 200, 1_000_000
#: The same where the different parts of all these texts are aligned once.
PORTION_ROWS, PORTION_BYTES = 10_000, 4_000_000
#: Parts that are tokenised in one call.
CALL = 25
#: Entries of each memo of token_ends(): a worker holds two, beside two vocabularies.
MEMO = 150_000


class ByteLevel(LibraryEncoder):
    """Ids of a byte-level .json vocabulary; the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special, self.memo = [], Memo(self.chunk, MEMO)
        of = {c: b for b, c in BYTE_CHARS.items()}
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.bytes[k] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()


class Pieces:
    """Ids of a .model vocabulary. No merge joins a blank to what stands before it where no piece does, so texts are cut
    before blanks (and line ends, where no piece holds one) and the parts remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.blank = self.model.piece_to_id("▁")
        cut = not any(re.search("[^▁]▁", p) for p in pieces) and self.model.id_to_piece(self.blank) == "▁"
        lines = cut and not any("\n" in p for p in pieces) and self.model.encode("\n")[:1] == [self.blank]
        self.parts = re.compile(r" +[^ \n]*|\n[^ \n]*" if lines else r" +[^ ]*").findall if cut else None
        ends = r" \n" if lines else " "
        #: Parts that begin with a blank (or line end) after another character than white space: no token of a byte-level vocabulary crosses that either.
        self.words = re.compile(rf"[{ends}]\s*\S*(?:[^\S{ends}]\s*\S*)*").findall if cut else None
        self.memo = Memo(self.part, MEMO)

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, num_threads=1), "<u4").tobytes()

    def part(self, part: str) -> bytes:
        """A part of a text; the vocabulary puts a blank first, which a part that starts with one doesn't get twice."""
        if part == " ":
            return np.array([self.blank], "<u4").tobytes()
        return self.whole(part[1:]) if part[0] == " " else self.whole(part)[4:]

    def __call__(self, text: str) -> bytes:
        if self.parts is None or "▁" in text:
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, self.parts(f" {text}")))


class Pair:
    """Both vocabularies, one a Python worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        if len(self.b.bytes) > 65536:
            raise ValueError("ids of the second vocabulary must fit in 16 bits")
        self.sizes = [np.array([len(x) for x in side.bytes], np.int32) for side in (self.a, self.b)]

    def ids(self, text: str) -> tuple[bytes, bytes] | None:
        """The ids of a text with a blank (or line end) before it in both vocabularies, None where one doesn't give its bytes back."""
        found, data = (self.a.whole(text), self.b.part(text)), text.encode()
        for side, ids in zip((self.a, self.b), found, strict=True):
            if b"".join(map(side.bytes.__getitem__, memoryview(ids).cast("I"))) != data:
                return None
        return found

    def parts(self, text: str) -> list[str]:
        """A blank and the text in parts where a token of both ends; a text that can't be cut so is one part."""
        return [f" {text}"] if self.b.words is None or "▁" in text else self.b.words(f" {text}")

    def tokenised(self, parts: list[str], alone: set[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Of both vocabularies the ids of all parts and how many each has; whether each part's bytes are given back (else it has no ids).
        Parts are tokenised one after another in one text, but for those that must stand alone."""
        calls = [parts[i : i + CALL] for i in range(0, len(parts), CALL)]
        found, given = [], []
        for some in calls:
            ids = self.ids("".join(some)) if len(some) == 1 or alone.isdisjoint(some) else None
            if ids:
                found.append(ids)
                given += [True] * len(some)
            else:
                each = [self.ids(part) for part in some]
                found += [x for x in each if x]
                given += [x is not None for x in each]
        given = np.array(given, bool)
        part_ends = np.cumsum(np.where(given, [len(p.encode()) for p in parts], 0), dtype=np.int64)
        out, counts = [], []
        for k in (0, 1):
            out.append(np.frombuffer(b"".join([f[k] for f in found]), "<u4").astype(np.int32))
            ends = np.cumsum(self.sizes[k][out[k]], dtype=np.int64)
            upto = np.searchsorted(ends, part_ends, "right")
            if not np.array_equal(np.concatenate([[0], ends])[upto], part_ends):
                return self.tokenised(parts, set(parts))  # a token lies in two parts: each alone
            counts.append(np.diff(upto, prepend=0))
        return out, counts, given

    def tokens(self, text: str | None) -> list[np.ndarray]:
        """Of both, ids, ends and marks: end, side (b: 1) and place of each token in one long, so that marks sort by end."""
        if text:
            data, out = f" {text}".encode(), []
            for side, sizes, given, mark in ((self.a, self.sizes[0], f" {text}", 0), (self.b, self.sizes[1], text, SIDE)):
                ids = np.frombuffer(side(given), "<u4")
                if b"".join(map(side.bytes.__getitem__, ids.tolist())) != data:
                    break
                ends = np.cumsum(sizes[ids], dtype=np.int64)
                out += [ids.astype(np.int32), ends.astype(np.int32), ends * END + np.arange(mark, mark + len(ids), dtype=np.int64)]
            else:
                return out
        return [np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)] * 2


#: In a mark: its end, its side, and whether it is the last of a part.
END, SIDE, LAST = 1 << 32, 1 << 31, 1 << 30
SIDES = [f"{side}_{what}" for side in "ab" for what in ("ids", "ends", "marks")]
KINDS = {"ids": (IntegerType(), pa.int32()), "ends": (IntegerType(), pa.int32()), "marks": (LongType(), pa.int64())}
TOKENS = StructType([StructField("doc_id", LongType())] + [StructField(c, ArrayType(KINDS[c[2:]][0], containsNull=False), False) for c in SIDES])
ARROW = pa.schema([("doc_id", pa.int64())] + [pa.field(c, pa.list_(pa.field("element", KINDS[c[2:]][1], False)), False) for c in SIDES])


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of doc_id and text in slices of at most ROWS rows and BYTES bytes, or one row."""
    sizes, begin, total = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin == ROWS or total + n > BYTES):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def token_ends(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id with the tokens of a blank and the text in both vocabularies: ids, byte offsets where they end, marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = held(Pair, path_a, path_b)
        for batch in batches:
            for some in portions(batch):
                columns = []
                for arrays, field in zip(zip(*map(pair.tokens, some.column(1).to_pylist()), strict=True), list(ARROW)[1:], strict=True):
                    offsets = np.zeros(len(arrays) + 1, np.int32)
                    np.cumsum([len(x) for x in arrays], out=offsets[1:])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)), type=field.type))
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], schema=ARROW)

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENS)


#: A portion of documents: the tokens of its different parts one after another, how many marks have come at the end of each
#: part, and the documents as numbers of parts.
PORTION = StructType([
    *[StructField(c, ArrayType(KINDS[c[2:]][0], containsNull=False), False) for c in SIDES if not c.endswith("ends")], StructField("upto", ArrayType(IntegerType(), containsNull=False), False),
    StructField("docs", ArrayType(StructType([StructField("doc_id", LongType()), StructField("n_a", LongType(), False), StructField("n_b", LongType(), False), StructField("parts", ArrayType(IntegerType(), containsNull=False), False)]), containsNull=False), False),
])
PORTION_ARROW = to_arrow_schema(PORTION)


def one_row(values: np.ndarray | pa.Array, field: pa.Field) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values), type=field.type)


class Portion:
    """Documents whose different parts are tokenised once."""

    def __init__(self, pair: Pair):
        self.pair, self.numbers, self.alone, self.ids, self.docs, self.bytes = pair, {}, set(), [], [], 0

    def add(self, doc_id: int | None, parts: list[str], size: int = 0) -> None:
        numbers = self.numbers
        for part in parts:
            if part not in numbers:
                numbers[part] = len(numbers)
        if parts and (len(parts) == 1 or parts[-1][-1].isspace()):  # whole texts, and blanks that would join with the next part's
            self.alone.add(parts[-1])
        self.ids.append(doc_id)
        self.docs.append(np.fromiter(map(numbers.__getitem__, parts), np.int32, len(parts)))
        self.bytes += size

    def without(self, given: np.ndarray) -> Portion:
        """The same documents; those with a part whose bytes aren't given back are tried as a whole, and without success have no parts."""
        out, parts = Portion(self.pair), list(self.numbers)
        for doc_id, doc in zip(self.ids, self.docs, strict=True):
            own = [parts[i] for i in doc]
            out.add(doc_id, own if given[doc].all() else ["".join(own)] if len(own) > 1 else [])
        return out

    def batch(self) -> pa.RecordBatch:
        ids, counts, given = self.pair.tokenised(list(self.numbers), self.alone)
        if not given.all():
            return self.without(given).batch()
        columns = {}
        for side, mark, of, sizes, n in zip("ab", (0, SIDE), ids, self.pair.sizes, counts, strict=True):
            marks = np.cumsum(sizes[of], dtype=np.int64) * END + np.arange(mark, mark + len(of), dtype=np.int64)
            marks[np.cumsum(n) - 1] |= LAST
            columns |= {f"{side}_ids": of, f"{side}_marks": marks}
        flat, offsets = np.concatenate(self.docs), np.concatenate([[0], np.cumsum([len(d) for d in self.docs])])
        sums = [np.concatenate([[0], np.cumsum(n[flat])])[offsets] for n in counts]
        kind = PORTION_ARROW.field("docs").type.value_type
        parts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), type=kind.field("parts").type)
        docs = pa.StructArray.from_arrays([pa.array(self.ids, pa.int64()), *[pa.array(np.diff(n), pa.int64()) for n in sums], parts], fields=list(kind))
        columns |= {"upto": np.cumsum(counts[0] + counts[1]).astype(np.int32), "docs": docs}
        return pa.RecordBatch.from_arrays([one_row(columns[f.name], f) for f in PORTION_ARROW], schema=PORTION_ARROW)


def token_parts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of at most PORTION_ROWS documents and PORTION_BYTES of text (or one document): PORTION."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = held(Pair, path_a, path_b)
        now = Portion(pair)
        for batch in batches:
            for doc_id, text, size in zip(batch.column(0).to_pylist(), batch.column(1), pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), strict=True):
                if now.ids and (len(now.ids) == PORTION_ROWS or now.bytes + size > PORTION_BYTES):
                    made, now = now.batch(), Portion(pair)
                    yield made
                now.add(doc_id, pair.parts(text.as_py()) if size else [], size)
        if now.ids:
            yield now.batch()

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PORTION)


def linked(tokens: DataFrame) -> DataFrame:
    """tokens with links (a's id * 65536 + b's id of each pair of overlapping tokens, in the order of the marks; at each cut a negative
    number, -1 - n, where n has how many tokens of a (in the high half) and of b have ended, and LAST at the end of a part). A lambda is
    evaluated without generated code, so each has few terms; casts, sorting and joining are left to functions that have such code."""
    marked = tokens.withColumn("_marks", F.sort_array(F.concat("a_marks", "b_marks")))
    place = lambda x: x.bitwiseAND(F.lit(LAST - 1)).cast("int")
    pair = lambda a, b: F.get("a_ids", a).cast("long") * 65536 + F.get("b_ids", b)

    def link(x: Column, k: Column) -> Column:
        """At a b end: an a end that has come just before, at the same byte, makes a cut."""
        of_a, cut = x.bitwiseAND(F.lit(SIDE)) == 0, F.shiftright(F.get("_marks", k - 1), 32) == F.shiftright(x, 32)
        ended = (place(x) - k).cast("long") * END - x.bitwiseAND(F.lit(SIDE - 1)) - 2
        return F.when(of_a, pair(place(x), k - place(x))).when(cut, ended).otherwise(pair(k - place(x), place(x)))

    return marked.withColumn("links", F.transform("_marks", link))


def grouped(each: DataFrame, parts: bool = False) -> DataFrame:
    """linked() with groups: a text of the ids of both between two cuts, as a1,a2|b1; with `parts` a semicolon follows each, a line end the last of a part."""
    each = each.withColumns({"_upto": F.transform(F.filter("links", lambda x: x < 0), lambda x: F.lit(-1) - x), "links": F.col("links")})
    high, low = lambda x: F.shiftright(x, 32).cast("int"), lambda x: x.bitwiseAND(F.lit(LAST - 1)).cast("int")

    def group(to: Column, c: Column) -> Column:
        """Most groups have one token of each."""
        begin = F.coalesce(F.get("_upto", c - 1), F.lit(0).cast("long"))
        some = lambda ids, lo, hi: F.array_join(F.transform(F.sequence(lo, hi - 1), lambda i: F.get(ids, i).cast("string")), ",")
        tail = [F.when(to.bitwiseAND(F.lit(LAST)) == 0, ";").otherwise("\n")] if parts else []
        one = F.concat(F.get("a_ids", high(to) - 1).cast("string"), F.lit("|"), F.get("b_ids", low(to) - 1).cast("string"), *tail)
        single = (to - begin).isin(END + 1, END + 1 + LAST, END + 1 - LAST)
        return F.when(single, one).otherwise(F.concat(some("a_ids", high(begin), high(to)), F.lit("|"), some("b_ids", low(begin), low(to)), *tail))

    return each.withColumn("groups", F.transform("_upto", group))


def alignment(tokens: DataFrame) -> DataFrame:
    """token_ends() with cuts (byte offsets), groups (texts) and links (ids), see linked()."""
    return grouped(linked(tokens.withColumn("cuts", F.array_intersect("a_ends", "b_ends")))).select(*tokens.columns, "cuts", "groups", "links")


def digests(portions: DataFrame) -> DataFrame:
    """A row a document of token_parts(): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its links as they come, -1 at each cut.
    The different parts of a portion are aligned as if they were one text; a document's groups and links are those of its parts."""
    each = grouped(linked(portions), parts=True)

    def part_links(to: Column, p: Column) -> Column:
        begin = F.coalesce(F.get("upto", p - 1), F.lit(0))
        return F.transform(F.sequence(begin, to - 1), lambda i: F.greatest(F.get("links", i), F.lit(-1).cast("long")))

    each = each.select("docs", F.split(F.array_join("groups", ""), "\n").alias("_groups"), F.transform("upto", part_links).alias("_links"))

    def document(d: Column) -> Column:
        of = lambda c: F.transform(d["parts"], lambda p: F.get(c, p))
        return F.struct(d["doc_id"].alias("doc_id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), F.array_join(of("_groups"), ";").alias("groups"), F.flatten(of("_links")).alias("links"))

    # the lambda stands in the generator, where no projection of an earlier step is put into it
    rows = each.select(F.inline(F.transform("docs", document)))
    n_groups = (F.length("groups") - F.length(F.replace("groups", F.lit("|"), F.lit("")))).cast("long")
    return rows.withColumn("n_groups", n_groups).select(
        "doc_id", "n_a", "n_b", "n_groups", (F.size("links").cast("long") - F.col("n_groups")).alias("n_links"), F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"), "links",
    )


def pair_counts(documents: DataFrame) -> DataFrame:
    """pair, count, best (no pair of its b id has more) over all documents: counted in each task first. A b id has at most as many
    pairs as a has ids."""
    counts = documents.select(F.explode("links").alias("pair")).filter("pair >= 0").groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    most = counts.groupBy(F.col("pair").bitwiseAND(F.lit(65535)).alias("b")).agg(F.max("count").alias("most"))
    joined = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(65535))).join(most, "b")
    return joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """digests() with n_best (links whose pair is its b id's most frequent) and count_sum (the counts of all links)."""
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = scratch.table(digests(token_parts(docs, path_a, path_b)).withColumn("_row", F.monotonically_increasing_id()), "documents")
    counts = scratch.table(pair_counts(rows), "pairs")
    each = rows.select("_row", F.explode("links").alias("pair")).filter("pair >= 0")
    if counts.count() <= BROADCAST_PAIRS:
        each, n = each.join(F.broadcast(counts), "pair"), F.lit(1)
    else:  # one row a document and pair; a join splits common pairs
        each, n = each.groupBy("_row", "pair").agg(F.count(F.lit(1)).alias("n")).join(counts, "pair"), F.col("n")
    summed = each.groupBy("_row").agg(F.sum(F.when(F.col("best"), n)).alias("n_best"), F.sum(n * F.col("count")).alias("count_sum"))
    total = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(summed, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best"), total("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
