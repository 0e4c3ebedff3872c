"""Hand rows with worked-out results, and every query against its SQL."""

import datetime
import html
import json
import random
import re
import time
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions import dates, text
from tidewell.operators import analytics, coverage, rules, store, translate, validate
from tidewell.plans import collect, report
from tidewell.queries import ORACLE_SQL, QUERIES, analysed_posts
from tidewell.sources import pages, payloads
from tidewell.streaming import upserts


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


def test_relative_dates(spark):
    rows = {"2024-01-03 10:00": "2024-01-03", "2024年1月3日": "2024-01-03", "2024-13-01 昨天": None, "12-30": "2023-12-30", "01/12": "2024-01-12", "01/13": "2023-01-13", "9.7": "2023-09-07", "版本1.2.3": "2024-01-02", "昨天 06:40": "2024-01-04", "前天": "2024-01-03", "3小时前": "2024-01-05", "5 天前": "2023-12-31", "2-30": None, "": None}
    got = column(spark, list(rows), lambda v: dates.relative_date(v, F.lit("2024-01-05").cast("date")).cast("string"))
    assert got == list(rows.values())


def test_other_dates(spark):
    assert column(spark, ["2024-01-01T20:00:00Z", "2024-01-01T20:00:00", "2024-02-30", "x", None], lambda v: dates.iso_date(v).cast("string")) == ["2024-01-02", "2024-01-01", None, None, None]
    assert column(spark, ["1704067200", "1704067200123", "x", None], lambda v: dates.epoch_date(v).cast("string")) == ["2024-01-01", "2024-01-01", None, None]


def test_counts(spark):
    assert column(spark, ["1.2万", "3,456 浏览", "2.5千", "1億", "0", "千", "无", None], text.parse_count) == [12000, 3456, 2500, 100_000_000, 0, None, None, None]
    assert column(spark, ["1.9", "nan", "inf", "", "x", None], text.number_or_zero) == [1, 0, 0, 0, 0, 0]


def test_text(spark):
    assert column(spark, ["爽", "#话题 #活动", "#a 好", "!!", "_ _", "分享图片 ", "好的"], lambda v: text.is_low_signal(v, ["分享图片"])) == [True, True, True, True, True, True, False]
    assert column(spark, ["ab", "abc", "123!", "1a!", "  好的吗 ", "&amp;&amp;&amp;"], text.is_meaningful) == [False, True, False, True, True, False]
    assert column(spark, ["a　 b\t", None, "&lt;x&gt;"], text.clean) == ["a b", "", "<x>"]
    assert column(spark, ["//x.y/a?b#c", "http://x/a#c", "x.y/p", "", None], text.canonical_url) == ["https://x.y/a", "http://x/a", "https://x.y/p", "", ""]
    assert column(spark, ["//h/p", "/p", "q", "http://z/"], lambda v: text.absolute_url(F.lit("http://a/b/c?d"), v)) == ["https://h/p", "http://a/p", "http://a/b/q", "http://z/"]
    assert column(spark, ["汉", "abc", None], text.needs_translation) == [True, False, False]
    assert column(spark, ["Straße Ａ", None], text.fold) == ["strasse a", ""]
    assert column(spark, [["a", " a ", "", "b", "a"]], text.drop_repeats, "array<string>") == [["a", "b", "a"]]
    assert column(spark, ["x" * 80], text.excerpt) == ["x" * 71 + "…"]


def test_whole_texts(spark, tmp_path):
    """Documents with entities pass through as well, held against html.unescape."""
    values = ["a &amp; b", "&lt;p&gt;  x&nbsp;y", "&#72;i &#x4f60;&#22909;", "Q&A", "&amp;&amp;&amp;", "#a&amp;b &hearts;", "&eacute;", "&notit; &ampx", "plain", "", "&nbsp;", None]
    spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [" ".join(html.unescape(v or "").split()) for v in values]
    got = QUERIES["clean_text_whole"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["cleaned"] for r in got] == want
    got = QUERIES["text_flags_whole"](spark, str(tmp_path)).orderBy("doc_id").collect()
    letters = lambda t: sum(c.isalnum() for c in t)
    assert [r["meaningful"] for r in got] == [len(t) >= 3 and any(c.isalpha() for c in t) for t in want]
    assert [r["low_signal"] for r in got] == [letters(" ".join(w for w in t.split() if w[0] != "#")) < 2 for t in want]


@pytest.mark.parametrize("aliases,value,want", [
    (["新区开服", "开服时间", "新区", "开服"], "新区开服时间", 1), (["boss"], "world boss, xboss", 1), (["职业转换", "转职", "职业"], "职业转换", 1),
    (["开新区", "新区开服", "开服"], "开新区开服", 1), (["世界boss", "boss"], "世界bossboss", 1), (["boss"], "", 0),
])
def test_aliases(spark, aliases, value, want):
    assert column(spark, [value], lambda v: rules.alias_count(v, aliases)) == [want]
    assert rules.Matcher((tuple(aliases),)).counts(rules.folded(value)) == [want]


def claims(text, aliases):
    """Claimed occurrences, by regular expressions and a list of taken spans."""
    taken = []
    for a in sorted(dict.fromkeys(rules.folded(x) for x in aliases if x), key=len, reverse=True):
        pattern = rf"(?<![a-z0-9]){re.escape(a)}(?![a-z0-9])" if re.fullmatch(r"[a-z0-9_+\- ]+", a) else re.escape(a)
        taken += [m.span() for m in re.finditer(pattern, text) if all(m.end() <= x or y <= m.start() for x, y in taken)]
    return len(taken)


def test_aliases_at_random():
    rng = random.Random(1)
    for _ in range(4000):
        groups = [["".join(rng.choice("ab新区 Ｂß") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5))] for _ in range(3)]
        groups = [[a for a in g if rules.folded(a) and not any(rules.folded(a).startswith(rules.folded(a)[k:]) for k in range(1, len(rules.folded(a))))] for g in groups]  # none overlaps itself
        text = rules.folded("".join(rng.choice("ab新区 Ｂßc") for _ in range(rng.randint(0, 20))))
        assert rules.Matcher(tuple(map(tuple, groups))).counts(text) == [claims(text, g) for g in groups]


def test_folded_aliases(spark):
    assert column(spark, ["the boss", "STRASSE", "x"], lambda v: rules.claimed([("a", ["BOSS"]), ("b", ["straße"])])(v)) == [[1, 0], [0, 1], [0, 0]]


def test_categories(spark):
    groups = [("a", ["x"]), ("b", ["y"]), ("c", ["z"])]
    assert column(spark, ["y x y", "z", "-"], lambda v: rules.categories(rules.claimed(groups)(v), groups)) == [["b", "a"], ["c"], [rules.OTHER]]


def test_analysed_frame(spark):
    names = [f.split()[0] for f in rules.ANALYSED.replace("map<string, int>", "map<>").split(",")]
    assert rules.nothing_analysed(spark).columns == names and len(names) == 26
    rows = [(1, "src", "kw one", "two kw kw three", "2024-01-02", None, 3), (2, "src", "none", "-", "no date", "x", None)]
    posts = spark.createDataFrame(rows, "seq long, source string, title string, original_text string, published_at string, title_ko string, comments long")
    a = rules.by_recency(rules.analysed(posts, [("c", ["kw"])], [("three", ["three"]), ("kw", ["kw"])], ["none"], [])).collect()
    assert [r["seq"] for r in a] == [1, 2] and a[0]["keyword_labels"] == ["kw", "three"] and a[0]["keyword_counts"] == {"kw": 2, "three": 1}
    assert (a[0]["category"], a[0]["engagement"], a[1]["category"], a[1]["content_type"], a[1]["date"], a[1]["views"]) == ("c", 3, rules.OTHER, rules.EVENT, None, 0)


POST = "post_key string, seq long, title string, original_text string, url string, source string, published_at date, views long, comments long, is_official boolean, is_campaign boolean, is_low_signal boolean"


def sightings(spark, rows):
    return spark.createDataFrame([("k", i, t, t, "u", s, None, v, None, o, False, False) for i, (t, v, s, o) in enumerate(rows)], POST)


def test_merge_and_upsert(spark):
    rows = [("ab", None, "x", False), ("cd", 5, "", True), ("c", 3, "", False)]
    m = store.merged(sightings(spark, rows)).first()
    assert (m["title"], m["views"], m["source"], m["is_official"], m["n_seen"]) == ("cd", 5, "x", True, 3)
    old = sightings(spark, rows[:1])
    assert store.upsert(old, sightings(spark, rows[1:])).first()["change"] == "updated"
    assert store.upsert(old, old).first()["change"] == "unchanged"
    assert store.upsert(old.limit(0), old).first()["change"] == "new"


def test_reasons(spark):
    d = lambda s: datetime.date.fromisoformat(s)
    rows = [(None, True, False, "abc", "unknown_date"), (d("2023-12-31"), True, False, "abc", "out_of_range"), (d("2024-01-02"), True, True, "abc", "campaign"), (d("2024-01-02"), False, True, "abc", "low_signal"), (d("2024-01-02"), False, False, "12", "invalid"), (d("2024-01-02"), False, False, "abc", "valid")]
    df = spark.createDataFrame([(p, c, low, t, "long text", w) for p, c, low, t, w in rows], "published_at date, is_campaign boolean, is_low_signal boolean, title string, original_text string, want string")
    got = df.select(validate.reason(F.lit("2024-01-01").cast("date"), F.lit("2024-01-07").cast("date")).alias("r"), "want").collect()
    assert [r["r"] for r in got] == [r["want"] for r in got]


def test_split():
    assert translate.split_text("一二三四五六七。九十甲乙", 10) == ["一二三四五六七。", "九十甲乙"]
    assert translate.split_text("一。三四五六七八九十甲", 10) == ["一。三四五六七八九十", "甲"]
    assert translate.split_text(None, 10) == []
    assert translate.split_text("一二三四五六。   七八九十甲乙丙丁", 8) == ["一二三四五六。", "七八九十甲乙丙丁"]  # blanks go before the next cut


def test_translate(spark):
    parts = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "seq long, pos int, chunk string")
    made = translate.translate(translate.pending(parts, spark.createDataFrame([("a", "A")], "chunk string, translated string")), lambda q: [None if x == "c" else x.upper() for x in q])
    cache = made.unionByName(spark.createDataFrame([("a", "A")], "chunk string, translated string"))
    assert sorted(map(tuple, translate.reassemble(parts, cache).collect())) == [(1, "A\nB", False), (2, "", True)]


def test_payloads(spark, tmp_path):
    doc = {"posts": [{"source": "s", "title": "t", "original_text": "o", "url": "u", "views": 3, "odd": 1}, {"source": "s", "title": " ", "original_text": "o", "url": "u"}]}
    (tmp_path / "store.json").write_text(json.dumps(doc, indent=1))
    assert [(r["title"], r["views"]) for r in payloads.read_post_store(spark, f"{tmp_path}/store.json").collect()] == [("t", 3)]
    (tmp_path / "cache.json").write_text(json.dumps({"entries": {"a": "b"}}))
    assert payloads.read_translation_cache(spark, f"{tmp_path}/cache.json").collect()[0]["translated"] == "b"
    assert column(spark, ['{"a":[{"vecFeed":[{"id":1}]}],"vecFeed":[2]}', "no json", None], lambda v: payloads.found_lists(v, "vecFeed")) == [["2", '{"id":1}'], [], []]
    flat = json.dumps([{"a": 1, "b": 2}, ["Date", "2024"], [3, -1], "x", 0])
    assert json.loads(column(spark, [flat], payloads.resolve_references)[0]) == {"a": "2024", "b": ["x", None]}
    cyclic, deep = json.dumps([{"self": 0, "r": 1}, ["Ref", 2], True]), "[" * 100_000 + "]" * 100_000
    assert column(spark, [cyclic, deep, "{}"], payloads.resolve_references) == ['{"self": null, "r": true}', None, None]
    assert column(spark, [deep], lambda v: payloads.found_lists(v, "a")) == [[]]
    (tmp_path / "bad.json").write_text("no json")
    assert payloads.unreadable(spark, f"{tmp_path}/bad.json").count() == 1 and payloads.read_post_store(spark, f"{tmp_path}/bad.json").count() == 0
    ld = json.dumps({"@graph": [{"name": "n", "itemListElement": [{"item": {"url": "u", "headline": "h"}}]}]})
    assert column(spark, [ld], payloads.json_ld_items)[0][0]["item"]["headline"] == "h"
    page = column(spark, ["<head><title>T&amp;</title></head><h1>H</h1><script>no</script><p>a<b>b</b>", None], pages.page)
    assert (page[0]["title"], page[0]["heading"], page[0]["lines"]) == ("T&", "H", ["H", "a", "b"])


def test_coverage(spark):
    log = spark.createDataFrame([("r", k, v) for k, v in enumerate([1, 1, 9, 1, None, 1])], "run string, k int, v int")
    assert [r["streak"] for r in coverage.streaks(log, "run", "k", F.col("v") < 5).orderBy("k").collect()] == [1, 2, 0, 1, 0, 1]
    per = spark.createDataFrame([("r", k, 1 if k < 25 else 0) for k in range(40)], "run string, n int, new long")
    assert [r["n"] for r in coverage.converged(per, "run", "n").filter("converged").orderBy("n").collect()][0] == 34


def test_store_pointer(spark, tmp_path):
    first = sightings(spark, [("ab", 1, "x", False)])
    for rows in (first, first.withColumn("views", F.lit(9))):
        store.write_store(rows, f"file://{tmp_path}/s")
    assert store.read_store(spark, f"file://{tmp_path}/s").first()["views"] == 9


def test_readers_fail_alone(spark):
    def broken(_):
        raise collect.SourceUnavailable("closed")

    posts, failures = collect.live_posts(spark, ["a", "b", "z"], {"a": lambda s: s.createDataFrame([("a", "k")], "source string, post_key string"), "b": broken})
    assert posts.count() == 1 and [tuple(r) for r in failures.collect()] == [("b", "blocked", "closed")]


def test_streaks_across_stretches(spark):
    rng, rows, streak, want = random.Random(2), [], {}, []
    for k in range(400):
        run, holds = k % 2, rng.random() < 0.93
        streak[run] = streak.get(run, 0) + 1 if holds else 0
        rows.append((run, k, holds))
        want.append(streak[run])
    df = spark.createDataFrame(rows, "run int, k long, holds boolean")
    for width in (7, 50, 1000):
        assert [r["streak"] for r in coverage.streaks(df, "run", "k", F.col("holds"), width).orderBy("k").collect()] == want


def test_export_file(spark, sf_dir, tmp_path):
    report.write_csv(report.export(analysed_posts(spark, sf_dir)).coalesce(1), f"{tmp_path}/csv")
    data = next(Path(f"{tmp_path}/csv").glob("*.csv")).read_bytes()
    assert data.startswith(b"\xef\xbb\xbfdate,source,category") and report.grid(analysed_posts(spark, sf_dir)).columns[0] == "일자"


def test_reports(spark, sf_dir):
    from tidewell.queries import CATEGORIES, CATEGORY_OF

    a = analysed_posts(spark, sf_dir).cache()
    order = [c for c, _ in CATEGORIES]
    assert report.report_draft(a, CATEGORY_OF, order).count("- ") >= 2 and report.report_draft(a.limit(0), CATEGORY_OF, order) == "no results"
    told = report.trend_report(a, analytics.crosstab(report.split_evidence(a)[0], order), CATEGORY_OF, "2024")
    assert told.startswith("- 2024: ") and "keywords" in told
    assert "caution" in report.narrative(a, CATEGORY_OF, ["a note"])


def test_terms_hide(spark):
    posts = spark.createDataFrame([(k, "t", "abc") for k in range(4)] + [(9, "t", "ab")], "seq long, title string, original_text string")
    assert [(r["term"], r["posts"]) for r in analytics.terms(posts, "[a-z]").collect()] == [("ab", 5), ("abc", 4)]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, rows in enumerate([[("ab", None, "x", False)], [("cd", 5, "", True)]]):
        df = sightings(spark, rows).withColumn("seq", F.lit(n).cast("long"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    upserts.upsert_stream(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint").awaitTermination()
    m = upserts.stored(spark, f"{tmp_path}/store").first()
    assert (m["views"], m["source"], m["is_official"]) == (5, "x", True)
    daily = upserts.daily_counts(stream.withColumn("t", F.lit("2024-01-01").cast("timestamp")), "t")
    counted = daily.writeStream.format("memory").queryName("daily_test").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert sum(r["count"] for r in spark.table("daily_test").collect()) == 2


def test_report(spark, sf_dir, tmp_path):
    a = analysed_posts(spark, sf_dir)
    assert report.narrative(a).startswith("- ") and report.narrative(a.limit(0)).startswith("- no posts in this period")
    report.write_csv(a.groupBy("category").count(), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() > 0


def plain(df: pd.DataFrame) -> list:
    def one(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return ""
        return str(v)[:10] if hasattr(v, "year") else str(int(v) if isinstance(v, float) and v == int(v) else v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE_SQL:
        c = duckdb.connect()
        for f in Path(sf_dir).glob("*.parquet"):
            c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
        want = c.execute(ORACLE_SQL[name]).df()
        assert sorted(want.columns) == sorted(got.columns) and plain(got) == plain(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5 and set(e.oracle_sql()) <= set(e.queries())


def test_page_postings_read_a_page_in_one_function(spark):
    """One Python function, in one place of the plan; the first posting of several scripts, entities resolved, pages without one go."""
    script = lambda x: f'<script type="application/ld+json">{x}</script>'
    post = lambda h: json.dumps({"@type": "SocialMediaPosting", "headline": h, "text": "a &amp;  b", "author": {"name": " w&lt; "}})
    html = [(1, script("no json") + script("[]") + script(post("one")) + script(post("two"))), (2, script('{"@type": "Other"}')), (3, None), (4, script(post("&eacute;"))), (4, "x")]
    got = pages.page_postings(spark.createDataFrame(html, "seq long, html string"))
    assert sorted(map(tuple, got.select("seq", "headline", "description", "author", "published_at").collect())) == [(1, "one", "a & b", "w<", ""), (4, "é", "a & b", "w<", "")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("Initial Plan") if "Initial Plan" in plan else len(plan)].count("ArrowEvalPython") == 1


def test_list_pages_name_writers_and_times(spark, sf_dir):
    """Each document has a page whose nearest line is its writer and one whose nearest line is a time or a date."""
    got = sorted((r["seq"], r["author"]) for r in QUERIES["list_pages"](spark, sf_dir).select("seq", "author").collect())
    ids = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    assert got == sorted((n, who) for n in ids for who in (("news", "news") if n % 3 == 0 else (f"writer{n}", "06:40" if n % 3 == 1 else "12-30")))
