"""The join with a rule table against the automaton, and scans against windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import rule_table, rules
from tidewell.operators.rule_table import rule_table_counts
from tidewell.operators.scan import Scan
from tidewell.queries import CATEGORIES, KEYWORD_RULES


def test_rule_table_equals_the_automaton(spark, sf_dir):
    r = random.Random(9)
    groups = [*CATEGORIES, *KEYWORD_RULES, ("odd", ["aa", "aaa", "a b", "ß", "日本", "日", "c++", "x", "AbC"]), ("odd2", ["日本語", "b", "aab"])]
    made = ["".join(r.choice(["a", "b", " ", "aa", "日本", "語", "c++", "ABC", "x", "ss", "the ", "für", ".", "1"]) for _ in range(r.randrange(30))) for _ in range(400)]
    texts = [None, "", " ", "日", "日" * 30, "a" * 5000, *made, *(x["text"] for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())]
    posts = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "das c++", "x"), (None, "das c++", "x")], "k long, body string, alias string").repartition(8)
    table = spark.createDataFrame([(label, a, n) for label, aliases in groups for n, a in enumerate(aliases)] + [(None, "das", 0), ("none", None, 0), ("none", " ", 1), ("alpha", "the", 7), ("far", "never met here", 0)], "label string, alias string, place int")
    m = rules.matcher(tuple(tuple(aliases) for _, aliases in groups))
    want = sorted(str((k, label, n)) for k, t in [*enumerate(texts), (None, "das c++"), (None, "das c++")] for (label, _), n in zip(groups, m.counts(rules.folded(t)), strict=True) if n)
    assert sorted(str(tuple(x)) for x in rule_table_counts(posts, table, "k", F.col("body")).collect()) == want
    assert rule_table_counts(posts.limit(0), table, "k", F.col("body")).collect() == rule_table_counts(posts, table.limit(0), "k", F.col("body")).collect() == []


def test_only_hits_go_on_to_the_join(spark):
    """Neither pass over the texts hands on more than what the rules ask for; before, each text's q-grams all went to the JVM."""
    texts = spark.range(4000).select(F.col("id").alias("row"), F.concat(F.lit("the ipsum is number "), "id", F.lit(" of very many ipsum"), F.repeat(F.lit(" words"), 40)).alias("t")).repartition(4)
    grams = rule_table._alias_grams(spark.createDataFrame([("ipsum",), ("sit",)], "alias string"), 4)
    assert sorted(r["alias"] for r in grams.collect()) == ["ipsum", "ipsum", "sit"]
    bits = spark.sparkContext.broadcast(rule_table._bitmap(grams))
    sums = rule_table._summed(texts, [3, 4], bits)
    assert sums.count() <= 3 * sums.rdd.getNumPartitions()
    known = {r["gram"] for r in grams.filter("alias = 'ipsum'").collect()}
    assert {r["gram"]: r["n"] for r in sums.groupBy("gram").agg(F.sum("n").alias("n")).collect()} == dict.fromkeys(known, 8000)
    assert sorted(map(tuple, rule_table._met(texts, [3, 4], bits).collect())) == sorted((k, g) for k in range(4000) for g in known)


def test_scans_equal_windows(spark):
    """Half of all rows have one key, which lies in many stretches; some stretches have fewer rows of a key than the frame."""
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 31 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 97))
    rows = spark.range(1500).select(key.alias("k"), F.col("id").alias("o"), F.when(F.hash("id") % 3 == 0, F.col("id")).alias("v")).repartition(5)
    w, texts = Window.partitionBy("k").orderBy("o"), lambda df: sorted(map(str, df.collect()))
    for stretches in (3, 60):
        scan = Scan(rows, ["k"], ["o"], stretches)
        assert stretches == 3 or scan.rows.filter("k = 'hot'").select("_stretch").distinct().count() > 15
        v = F.col("v")
        got = scan.running(a=("sum", v), m=("min", v % 50), x=("max", v), last=("last", v))
        assert texts(got) == texts(rows.withColumns({"a": F.coalesce(F.sum(v).over(w), F.lit(0)), "m": F.min(v % 50).over(w), "x": F.max(v).over(w), "last": F.last(v, True).over(w)}))
        frames = {"p": lambda w: F.last(F.col("v"), True).over(w.rowsBetween(-5, -1)), "c": lambda w: F.sum("v").over(w.rowsBetween(-9, 0))}
        assert texts(scan.framed(9, **frames)) == texts(rows.withColumns({n: f(w) for n, f in frames.items()}))
        islands = rows.withColumn("i", F.sum(F.when(v.isNotNull(), 0).otherwise(1)).over(w))
        want = islands.withColumn("streak", F.sum(v.isNotNull().cast("long")).over(Window.partitionBy("k", "i").orderBy("o"))).drop("i")
        assert texts(scan.streaks(v.isNotNull())) == texts(want)
    empty = Scan(rows.limit(0), ["k"], ["o"])
    assert empty.running(a=("sum", F.col("v"))).collect() == empty.streaks(F.col("v") > 0).collect() == empty.framed(3, p=lambda w: F.lag("v").over(w)).collect() == []
