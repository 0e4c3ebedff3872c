"""Operators 11 to 13 against brute-force versions, on odd rows and on the synthetic tables."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from test_operators import LONG, ODD_TEXTS, rows_of
from tidewell.llm import alignment, filter_audit, mixing, queries
from tidewell.llm.tokens import vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SOURCES = ["b", "a", None, "", "é", "a", "a", "z"]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mask int, part string, row long, TEXT_ string")


@pytest.fixture(scope="module")
def odd_rows():
    rows = [(k, t, SOURCES[k % 8]) for k, t in enumerate([*ODD_TEXTS, *ODD_TEXTS[:9], "The Cat SAT. " * 60, "w" + " x" * 70, " ".join(f"u{k}" for k in range(80)) + " #"])]
    return [*rows, (None, "a", "a"), (None, "no id", None), (3, "again", "b"), (3, "again", "b"), (7, "one two", "zz")]


@pytest.fixture(scope="module")
def odd_docs(spark, odd_rows):
    return docs_of(spark, [(*r, 1, "p", 2, "t") for r in odd_rows])


# 11
def plain_mask(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i]
        out.append({c for c, f in zip("ABCDE", fails, strict=True) if f})
    return out


def plain_audit(rows, labels):
    good, bad = ({i for i, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for (i, _, s), fails in zip(rows, plain_mask(rows), strict=True):
        parts[s or ""].append((fails, i in good and i is not None, i in bad and i is not None))
    out, total = [], Counter()
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, c in enumerate(order, 1):
                here = [d for d in left if c in d[0]]
                left = [d for d in left if c not in d[0]]
                total[part, c] += len(here)
                fails = sum(c in d[0] for d in docs)
                out.append((part, "".join(order), step, len(left), len(here), fails - len(here), sum(d[0] == {c} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)))
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit(spark, odd_docs, odd_rows):
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (None, 1, 1), (3, 1, 1), (4, None, None), (999, 1, 1), (27, 0, 1)]
    found = filter_audit.filter_audit(odd_docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, found.collect())) == plain_audit(odd_rows, labels)


def test_filter_audit_real(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    want = plain_audit(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert sorted(map(tuple, queries.QUERIES["op11_filter_audit"](spark, sf_dir).collect())) == want
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    names = "part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley"
    assert sorted(con.sql(f"SELECT {names} FROM ({filter_audit.OP11_SQL})").fetchall()) == want


def test_polynomials():
    counts = {0: 4, 0b1: 2, 0b11: 5, 0b110: 1, 0b111: 10**15}
    p = filter_audit.removal_polynomial(counts)
    at = filter_audit.corners(p, 3)
    assert at == [sum(n for m, n in counts.items() if m & s) for s in range(8)]
    for i in range(3):  # by all orders
        shares = []
        for order in itertools.permutations(range(3)):
            before = sum(1 << j for j in order[: order.index(i)])
            shares.append(at[before | 1 << i] - at[before])
        assert filter_audit.shapley(p, i) == Fraction(sum(shares), 6)


def test_filter_audit_empty(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int, extra int")
    assert filter_audit.filter_audit(odd_docs.limit(0), labels).collect() == []


def test_names_that_differ_in_case(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = spark.createDataFrame([(1, "wrong", "one two", "s", "S")], "doc_id long, TEXT string, text string, source string, SOURCE string")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert [r["size"] for r in mixing.mix(docs).collect()] == [2]


# 12
def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, full = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return {s: float(share.get(s, 2 * sizes[s])) for s in order}
        full |= set(over)


def check_mix(rows, found):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    targets, taken = plain_targets(sizes), Counter()
    assert sorted(map(repr, ((r["doc_id"], r["size"], r["source"]) for r in found))) == sorted(map(repr, ((i, len(WORDS.findall(t or "")), s) for i, t, s in rows)))
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]], rel=1e-12, abs=1e-9)
        assert r["size"] * r["epochs"] <= r["taken"] <= r["size"] * (r["epochs"] + 1) <= 3 * r["size"] and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    for s in sizes:  # at most one document a source is taken in part
        assert sum(r["source"] == s and r["size"] > 0 and r["taken"] % r["size"] > 0 for r in found) <= 1


def test_mix(spark, odd_docs, odd_rows):
    quality = spark.createDataFrame([(0, 2.0), (1, None), (2, -1.0), (3, float("nan")), (3, 5.0), (None, 1.0), (12, 0.0)], "doc_id long, weight double")
    for q in (None, quality):
        mixed = mixing.mix(odd_docs, q)
        check_mix(odd_rows, mixed.collect())
    again = mixing.mix(odd_docs.repartition(7), quality)
    assert rows_of(mixed, *mixed.columns) == rows_of(again, *again.columns)


def test_mix_real(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    check_mix(rows, mixing.mix(docs).collect())
    asked = queries.QUERIES["op12_source_mix"](spark, sf_dir)
    assert asked.columns == ["doc_id", "size", "source_size", "target", "taken"] and asked.count() == len(rows)


def test_mix_one_source_and_nothing(spark, odd_docs):
    one = odd_docs.withColumn("source", F.lit("s"))
    found = mixing.mix(one).collect()
    assert sum(r["taken"] for r in found) == int(1.5 * sum(r["size"] for r in found) + 0.5)
    assert mixing.mix(odd_docs.limit(0)).collect() == []
    assert {r["taken"] for r in mixing.mix(odd_docs.filter("doc_id in (1, 2)")).collect()} == {0}  # no words at all


def test_mix_prefers_quality(spark):
    """A sample of weights 4 and 1: the chance of every first place is by weight, so good documents come up about as they should."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.when(F.col("id") % 2 == 0, "s").otherwise("t").alias("source"))
    quality = docs.select("doc_id", F.when(F.col("doc_id") % 4 < 2, 4.0).otherwise(1.0).alias("weight"))
    found = mixing.mix(docs, quality, weights=(1, 1), share=Fraction(1, 5)).collect()
    for parity in (0, 1):
        mine = [r for r in found if r["doc_id"] % 2 == parity]
        assert sum(r["taken"] for r in mine) == 600
        # 1 - exp(-4 x) + 1 - exp(-x) = 0.4 gives x = 0.0894: 30.1 % of the good, 8.6 % of the others
        good = sum(r["taken"] for r in mine if r["doc_id"] % 4 < 2)
        assert 420 < good < 515


# 13
class Plain:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}

    def __call__(self, text):
        if not text:
            return [], [], [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
        ab = [bytes(self.of[c] for c in self.a.id_to_token(i)) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(self.b.id_to_piece, b)]
        if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            return [], [], [], []
        return a, list(itertools.accumulate(map(len, ab))), b, list(itertools.accumulate(map(len, bb)))


def plain_alignment(rows):
    encode, each, counts = Plain(), [], Counter()
    for i, t, *_ in rows:
        a, ae, b, be = encode(t)
        spans = lambda ends: list(zip([0, *ends], ends))  # noqa: B905, E731
        links, j0 = [], 0
        sa, sb = spans(ae), spans(be)
        for x, (p, q) in zip(a, sa, strict=True):
            while j0 < len(sb) and sb[j0][1] <= p:
                j0 += 1
            for j in range(j0, len(sb)):
                if sb[j][0] >= q:
                    break
                links.append((x, b[j]))
        cuts = [0, *sorted(set(ae) & set(be))]
        groups = ";".join(",".join(str(x) for x, e in zip(a, ae, strict=True) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(b, be, strict=True) if lo < e <= hi) for lo, hi in zip(cuts, cuts[1:])) if len(cuts) < 3000 else None  # noqa: B905
        counts.update(links)
        each.append((i, len(a), len(b), len(cuts) - 1, links, groups))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(i, n_a, n_b, n_g, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), "" if not n_a else g and hashlib.sha256(g.encode()).hexdigest()) for i, n_a, n_b, n_g, ls, g in each]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
BLANKS = ["  ", " \n x", "a  b   c ", "\n", "\n\nx\n y  \n", "x▁y", "▁", "a▁ b", "<s>x</s>", "<unk>", "<0x41>", "\x00a\x7f", " \t\r\n", "é" * 500, "日本語" * 300, "a" * 20000, "́x ̈", "🙂‍🔥" * 20]


def held_against(found, want):
    found, want = (sorted(rows, key=str) for rows in ([tuple(r) for r in found.select(*COLUMNS).collect()], want))
    assert len(found) == len(want)
    for f, w in zip(sorted(found, key=lambda r: str(r[:7])), sorted(want, key=lambda r: str(r[:7])), strict=True):
        assert f[:7] == w[:7] and (w[7] is None or f[7] == w[7])


def test_alignment(spark, odd_rows):
    rows = [*odd_rows, *[(600 + k, t, "s") for k, t in enumerate(BLANKS)], *[(800 + k, f"tail {t} end", "s") for k, t in enumerate(BLANKS)]]
    docs = docs_of(spark, [(*r, 1, "p", 2, "t") for r in rows]).repartition(2)
    found = alignment.aligned_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    held_against(found, plain_alignment(rows))


def test_alignment_random(spark):
    import random

    r = random.Random(13)
    marks = [" ", "  ", "\n", "\t", "a", "the", "ing", "é", "▁", "日", "🙂", "<|endoftext|>", "<s>", "1", "2024", "'s", " ", "　", "ß", "Ω", "\r", ".", "...", "x_y", "́"]
    rows = [(k, "".join(r.choice(marks) for _ in range(r.randrange(0, 40)))) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    held_against(alignment.aligned_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")), plain_alignment(rows))


def test_alignment_real(spark, sf_dir, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_alignment(rows)
    held_against(queries.QUERIES["op13_token_alignment"](spark, sf_dir), want)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)  # the join that splits common pairs
    held_against(queries.QUERIES["op13_token_alignment"](spark, sf_dir), want)


def test_alignment_outputs(spark):
    docs = spark.createDataFrame([(1, "don't stop"), (2, LONG), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in alignment.alignment(alignment.token_ends(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))).collect()}
    one = found[1]
    for side in (0, 1):
        assert [int(i) for g in one["groups"] for i in g.split("|")[side].split(",")] == one["ab"[side] + "_ids"]
    assert one["cuts"] == sorted(set(one["a_ends"]) & set(one["b_ends"])) and one["cuts"][-1] == len(" don't stop")
    assert found[3]["groups"] == found[3]["links"] == [] and len(found[2]["a_ids"]) > 12000


def test_portions():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "text": [None if k % 7 == 0 else "x" * (700_000 if k in (3, 4, 30, 31) else 5) for k in range(500)]})
    some = list(alignment.portions(batch))
    assert pa.Table.from_batches(some).to_pydict() == batch.to_pydict() and max(b.num_rows for b in some) == 200
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 1_000_000 for b in some) and list(alignment.portions(batch.slice(0, 0))) == []


def test_alignment_parts(spark):
    """Parts that repeat are tokenised and aligned once a portion; the documents are those of plain sums."""
    texts = ["the don't stop the", "the  the \n", "the\tthe the", None, "", "stop\nthe", "the▁ the", "\n", " ", "xylophones\u3000the", "the " * 300]
    rows = [(k, t) for k, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    (portion,) = alignment.token_parts(docs, *paths).collect()
    total = sum(d["n_a"] + d["n_b"] for d in portion["docs"])
    assert portion["upto"][-1] == len(portion["a_marks"]) + len(portion["b_marks"]) < 100 < 1000 < total and len(portion["docs"]) == len(rows)
    held_against(alignment.aligned_documents(docs, *paths), plain_alignment(rows))
    held_against(alignment.aligned_documents(docs.filter("text is null"), *paths), [(k, 0, 0, 0, 0, 0, 0, "") for k, t in rows if t is None])


def test_alignment_bytes_not_given_back():
    """A part whose bytes a vocabulary changes goes alone into the whole text, and that has no tokens; its neighbours keep theirs."""
    pair = alignment.Pair(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    ids = pair.ids
    pair.ids = lambda text: None if "bad" in text else ids(text)
    portion = alignment.Portion(pair)
    for k, t in enumerate(["one two", "one bad two", "bad", "two"]):
        portion.add(k, pair.parts(t))
    docs = portion.batch().to_pylist()[0]["docs"]
    assert [len(d["parts"]) for d in docs] == [2, 0, 0, 1] and [d["n_a"] > 0 for d in docs] == [True, False, False, True]


def test_alignment_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, links int")
    assert alignment.aligned_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).collect() == []
