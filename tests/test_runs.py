"""The store of sorted runs, and counters that follow it."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import counters, store, validate
from tidewell.operators.runs import STATE, RunStore
from tidewell.scratch import written

PERIOD = (datetime.date(2024, 1, 5), datetime.date(2024, 1, 20))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Many small jobs: two partitions are enough."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def batch_of(spark, rows):
    posts = spark.createDataFrame(rows, "post_key string, seq long, source string, title string, original_text string, url string, published_at date, views long, is_campaign boolean, is_low_signal boolean")
    return store.whole(posts)


def random_batches(spark, n_batches, keys, rows, seed):
    r, out, seq = random.Random(seed), [], 0
    for _ in range(n_batches):
        batch = []
        for _ in range(rows):
            k = r.randrange(keys)
            seq += 1
            day = r.choice([None, datetime.date(2024, 1, r.randrange(1, 28))])
            batch.append((f"s{k % 3}|{k:06}", seq, f"s{k % 3}", f"title {k} " + "x" * r.randrange(3), "text " + "y" * r.randrange(3), f"https://h/{k}", day, r.randrange(5), r.random() < 0.2, r.random() < 0.2))
        out.append(batch_of(spark, batch))
    return out


def state(df):
    return sorted(map(str, df.select("post_key", *STATE).collect()))


def whole_merge(batches, upto):
    return store.combined(batches[:upto])


def test_upserts_equal_the_full_merge(spark, tmp_path):
    batches = random_batches(spark, 3, 300, 120, 1)
    runs = RunStore(spark, str(tmp_path / "s"), rows_per_file=60)
    assert runs.read() is None
    known = None
    for k, batch in enumerate(batches):
        changes = {r["post_key"]: r["change"] for r in runs.upsert(batch).collect()}
        want = store.merged(batch) if known is None else store.upsert(known, batch)
        if known is not None:
            assert changes == {r["post_key"]: r["change"] for r in want.collect() if r["change"] != "unchanged"}
        known = spark.createDataFrame(want.select("post_key", "seq", *STATE).collect(), want.select("post_key", "seq", *STATE).schema)
        assert state(runs.read()) == state(known) == state(whole_merge(batches, k + 1))
    done = runs.compact()
    assert done["rewritten"] > 0 and state(runs.read()) == state(known)
    assert runs.snapshot()["dead"] == [] or done["carried"]
    assert state(runs.read(version=1)) == state(whole_merge(batches, 2))  # older snapshots stay readable
    assert runs.expire(1) == runs.versions() and state(runs.read()) == state(known)
    assert runs.upsert(batches[0].limit(0)).count() == 0 and runs.versions() == runs.expire(1)
    assert runs.upsert(batches[2].withColumn("views", F.col("views") + 100)).count() > 0 and len(runs.versions()) == 2


def test_an_upsert_touches_few_files(spark, tmp_path):
    """One per cent of the keys, of one source: reads, writes and compaction stay with their range."""
    posts = batch_of(spark, [(f"s{k // 500}|{k:06}", k, f"s{k // 500}", f"title {k}", "a text", f"u{k}", None, 1, False, False) for k in range(5000)])
    runs = RunStore(spark, str(tmp_path / "s"), rows_per_file=100, small=20)
    runs.upsert(posts)
    assert len(runs.snapshot()["files"]) >= 45
    few = posts.filter("seq between 2100 and 2149").withColumn("views", F.lit(9).cast("long"))
    assert runs.upsert(few.withColumn("seq", F.col("seq") + 100000)).count() == 50
    assert runs.touched["read"] <= 3 and runs.touched["written"] == 1 and runs.touched["of"] >= 45
    done = runs.compact()
    assert done["rewritten"] <= 4 and done["carried"] >= 42
    assert runs.read().count() == 5000 and runs.read().filter("views = 9").count() == 50
    new = batch_of(spark, [(f"s4|{k:06}x", k, "s4", "new", "a text", "u", None, 1, False, False) for k in range(2000, 2490, 10)])
    assert {r["change"] for r in runs.upsert(new).collect()} == {"new"}
    assert runs.touched["read"] <= 5  # the ranges of 10 files hold these keys, their bitmaps hardly any


def test_a_killed_writer_is_not_seen(spark, tmp_path):
    batches = random_batches(spark, 2, 100, 60, 3)
    runs = RunStore(spark, str(tmp_path / "s"), rows_per_file=20)
    runs.upsert(batches[0])
    before = state(runs.read())
    broken = RunStore(spark, str(tmp_path / "s"), rows_per_file=20)

    def dies(*_):
        raise KeyboardInterrupt

    broken._commit = dies
    with pytest.raises(KeyboardInterrupt):
        broken.upsert(batches[1])
    assert state(runs.read()) == before
    runs.upsert(batches[1])  # the next writer uses the same version anew
    assert state(runs.read()) == state(whole_merge(batches, 2))
    late = RunStore(spark, str(tmp_path / "s"), rows_per_file=20)
    late.snapshot = lambda version=None: RunStore.snapshot(runs, 0)  # a writer that has not seen version 1
    with pytest.raises(Exception, match="[Ee]xist"):
        late.upsert(batches[0].withColumn("views", F.lit(77).cast("long")))
    assert state(runs.read()) == state(whole_merge(batches, 2))


def test_counters_follow_the_store(spark, tmp_path):
    batches = random_batches(spark, 3, 150, 120, 5)
    runs, summary, samples = RunStore(spark, str(tmp_path / "s"), rows_per_file=80), None, None
    for batch in batches:
        judged = written(counters.judged_changes(runs.upsert(batch)), "judged")
        summary = written(counters.counted(summary, judged), "summary")
        now = runs.read()
        samples = written(counters.sampled(now, n=3) if samples is None else counters.resampled(samples, judged, now, n=3), "samples")
        for first, last in ([F.lit(d) for d in days] for days in (PERIOD, (datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)))):
            want = validate.exclusion_counts(now.withColumn("reason", validate.reason(first, last)))
            assert sorted(map(tuple, counters.period_counts(summary, first, last).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
            excluded = sorted(tuple(r) for r in now.withColumn("reason", validate.reason(first, last)).filter("reason in ('campaign', 'low_signal')").select("source", "post_key", "reason", "title").collect())
            want = [x for s in ("s0", "s1", "s2") for x in [e for e in excluded if e[0] == s][:3]]
            got = counters.period_samples(samples, first, last, n=3)
            assert sorted(tuple(r) for r in got.select("source", "post_key", "reason", "title").collect()) == want
        cells = samples.groupBy("source", "published_at").count()
        assert cells.filter("count > 6").count() == 0


def test_samples_survive_deletions(spark):
    day = datetime.date(2024, 1, 9)
    rows = [(f"k{k:03}", k, "s", f"title {k}", "a text", "u", day, 1, True, False) for k in range(30)]
    now, gone = batch_of(spark, rows), 0
    samples = counters.sampled(now, n=2)
    assert samples.count() == 4 and not samples.first()["complete"]
    for step in range(4):  # three leave at a time: within the reserve once, then from the store
        leaving = now.filter((F.col("seq") >= gone) & (F.col("seq") < gone + 3))
        gone += 3
        state_of = F.struct("seq", *STATE)
        changes = leaving.select("post_key", F.lit("updated").alias("change"), state_of.alias("before"), F.struct("seq", *[F.lit(False).alias(c) if c == "is_campaign" else F.col(c) for c in STATE]).alias("now"))
        judged = counters.judged_changes(changes)
        left = now.filter(F.col("seq") >= gone)
        samples = written(counters.resampled(samples, judged, left, n=2), "samples")
        assert [r["post_key"] for r in counters.period_samples(samples, *map(F.lit, PERIOD), n=2).orderBy("rank").collect()] == [f"k{gone:03}", f"k{gone + 1:03}"], step


def test_files_of_a_run_are_ranges(spark, tmp_path):
    """An upsert's files don't overlap, whatever the number of shuffle partitions: a key is looked for in one file a run."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        batches = random_batches(spark, 3, 300, 240, 7)
        for rows_per_file in (100, 10_000):
            runs = RunStore(spark, str(tmp_path / f"s{rows_per_file}"), rows_per_file=rows_per_file)
            for batch in batches:
                runs.upsert(batch)
            assert state(runs.read()) == state(whole_merge(batches, 3))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_struck_files_are_rewritten_alone(spark, tmp_path):
    """Files with many struck rows don't draw the files that replaced those rows into a compaction."""
    posts = batch_of(spark, [(f"k{k:06}", k, "s", f"title {k}", "a text", f"u{k}", None, 1, False, False) for k in range(1000)])
    store = RunStore(spark, str(tmp_path / "s"), rows_per_file=100, small=0)
    store.upsert(posts)
    store.upsert(posts.filter("seq between 200 and 599 and seq % 2 = 0").withColumns({"views": F.lit(9).cast("long"), "seq": F.col("seq") + 1000}))
    before, files = state(store.read()), store.snapshot()["files"]
    struck = {f for f, (_, n, gone) in files.items() if gone > 0.3 * n}
    assert 0 < len(struck) < len(files) - 2
    assert store.compact()["rewritten"] == len(struck) and state(store.read()) == before


def test_large_batches_take_the_rows_of_their_files_along(spark, tmp_path, monkeypatch):
    """However a batch meets the store, whole rows of the store are not moved for finding those that it has."""
    posts = batch_of(spark, [(f"k{k:06}", k, "s", f"title {k}", "a text", f"u{k}", None, 1, False, False) for k in range(300)])
    more = posts.filter("seq % 2 = 0").withColumns({"views": F.lit(9).cast("long"), "seq": F.col("seq") + 1000})
    found = {}
    for keys, along in ((1000, 4), (0, 4), (0, 1)):
        monkeypatch.setattr("tidewell.operators.runs.KEYS", keys)
        monkeypatch.setattr("tidewell.operators.runs.ALONG", along)
        store = RunStore(spark, str(tmp_path / f"{keys}-{along}"), rows_per_file=50)
        store.upsert(posts)
        now = store.snapshot()["files"]
        known, rows = store._known(now, None, more, 150)
        plan = known._jdf.queryExecution().optimizedPlan().toString()
        assert ("Join" in plan) == (keys > 0 or along == 1) and ("broadcast" in plan) == (keys > 0) and rows == (450 if (keys, along) == (0, 4) else 150)
        assert store.upsert(more).filter("change = 'updated'").count() == 150
        found[keys, along] = state(store.read())
    assert len(set(map(str, found.values()))) == 1
