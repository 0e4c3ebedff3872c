"""Pending translations over batches, restarts and failures."""

import random

import pytest

from tidewell.streaming.translations import TranslationQueue, requests


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Many small jobs: two partitions are enough."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def plain_requests(sizes, most, chars):
    out, now = [], []
    for n in sizes:
        if now and (len(now) == most or sum(now) + n > chars):
            out.append(now)
            now = []
        now.append(n)
    return [*out, now] if now else out


def test_requests():
    r = random.Random(4)
    for _ in range(300):
        sizes = [r.choice([1, 50, 300, 800, 1500]) for _ in range(r.randrange(40))]
        numbers = requests(sizes, 8, 1200)
        assert [[n for n, k in zip(sizes, numbers, strict=True) if k == g] for g in range(max(numbers, default=-1) + 1)] == plain_requests(sizes, 8, 1200)


def senders():
    """Made here, so that they reach the workers by value."""

    def loud(texts):
        return [t.upper() for t in texts]

    def dumb(texts):
        raise OSError("no way")

    return loud, dumb


loud, dumb = senders()


def batch_of(spark, chunks, start=0):
    return spark.createDataFrame([(c, start + k, 0) for k, c in enumerate(chunks)], "chunk string, seq long, pos int")


def test_batches_send_once(spark, tmp_path):
    queue = TranslationQueue(spark, str(tmp_path / "q"), loud, "r1", lanes=2)
    texts = [f"chunk {k} " + "x" * (k * 37 % 700) for k in range(60)]
    queue.step(batch_of(spark, [*texts[:40], texts[3], "", " ", None]), 0)
    assert sorted(map(tuple, queue.cache().collect())) == sorted((t, t.upper().strip()) for t in texts[:40])
    done = queue.outcome()
    for lane in (0, 1):
        sent = [(r["request"], len(r["chunk"])) for r in done.filter(f"lane = {lane}").collect()]
        mine = sorted((t for t in texts[:40] if t in {r["chunk"] for r in done.filter(f"lane = {lane}").collect()}), key=texts.index)
        want = plain_requests([len(t) for t in mine], 8, 1200)
        assert [sorted(n for q, n in sent if q == k + 1) for k in range(len(want))] == [sorted(w) for w in want] and len(sent) == len(mine)
    broken = TranslationQueue(spark, str(tmp_path / "q"), dumb, "r1", lanes=2)
    broken.step(batch_of(spark, texts[:40]), 0)  # run again: nothing is sent, nothing changes
    assert queue.outcome().count() == 40
    queue.step(batch_of(spark, texts, 100), 1)
    assert queue.cache().count() == 60 and queue.outcome().filter("batch = 1").count() == 20


def test_stops_are_kept_over_batches(spark, tmp_path):
    texts = [f"{k}" * 300 for k in range(100, 124)]  # a request takes one
    broken = TranslationQueue(spark, str(tmp_path / "q"), dumb, "r1", lanes=1, failures=3)
    broken.step(batch_of(spark, texts[:2]), 0)
    assert broken.cache().count() == 0
    broken.step(batch_of(spark, texts[2:10], 10), 1)  # two that are left and one more, then none
    last = broken.outcome().filter("batch = 1")
    assert last.filter("request is not null").count() == 1 and last.count() == 10 and last.agg({"failed": "max"}).first()[0] == 3
    broken.step(batch_of(spark, texts[10:12], 30), 2)
    assert broken.outcome().filter("batch = 2 and request is not null").count() == 0
    again = TranslationQueue(spark, str(tmp_path / "q"), loud, "r2", lanes=1, failures=3)
    again.step(batch_of(spark, [], 0), 3)  # a new run takes up what is pending
    assert sorted(r["chunk"] for r in again.cache().collect()) == sorted(texts[:12])


def test_stream_and_restart(spark, tmp_path):
    texts = [f"text number {k}" for k in range(30)]
    for k in range(3):
        batch_of(spark, texts[k * 10 : k * 10 + 10] + texts[:5], k * 100).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    queue = TranslationQueue(spark, f"{tmp_path}/q", loud, "r1", lanes=2)
    for _ in range(2):
        source = spark.readStream.schema("chunk string, seq long, pos int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = queue.start(source, f"{tmp_path}/c")
        query.awaitTermination(200)
        assert query.exception() is None
    assert queue.cache().count() == 30 and queue.outcome().count() == 30 and queue.outcome().select("batch").distinct().count() == 3


def test_the_lines_of_the_query_lie_in_a_file_a_partition(spark, sf_dir):
    """So that no task reads a fixed share of all lines."""
    from pathlib import Path

    from tidewell.run_queries import translations_stream
    from tidewell.scratch import shared_folder

    files = lambda: {p for p in Path(shared_folder(spark).removeprefix("file://").removeprefix("file:")).glob("translations-*/lines/part-*")}
    before, n = files(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        translations_stream(spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert len(files() - before) == 6
