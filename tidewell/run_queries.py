"""Queries of what goes on from run to run: the store of sorted runs, its counters, stop rules in a stream, scans, payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import counters, validate
from .operators.rule_table import rule_table_counts as by_rule_table
from .operators.runs import RunStore
from .operators.scan import Scan
from .queries import FIRST, LAST, MERGED, SIGHTED, _sql_folded, query, sighted_of as sighted
from .scratch import shared_folder, written
from .sources import payloads
from .sources.synthetic import posts
from .streaming import stops
from .streaming.translations import TranslationQueue

STORED = ["post_key", "is_official", "is_campaign", "is_low_signal", "views", "comments", "title", "original_text", "url", "source", "published_at", "author", "source_section", "published_at_source", "content_scope", "source_note"]


def _period():
    return F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")


# the store: first sightings of two thirds of the documents; the others with a fifth of the second sightings; the rest of these
def arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The posts are written once, as a reader would leave them."""
    first, again = sighted(written(posts(spark, sf_dir), "posts"))
    return [first.filter("seq % 3 <> 0"), first.filter("seq % 3 = 0").unionByName(again.filter("seq % 5 = 0")), again.filter("seq % 5 <> 0")]


ARRIVED = SIGHTED.replace("twice AS (", "sightings AS (", 1) + """, twice AS (SELECT * REPLACE (seq + 10000000000000 * CASE WHEN seq >= 1000000000 THEN CASE WHEN seq % 5 = 0 THEN 1 ELSE 2 END WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS seq) FROM sightings),
stored AS (SELECT * EXCLUDE (seq, n_seen) FROM (""" + MERGED.replace("SELECT post_key, ", "SELECT post_key, bool_or(is_low_signal) AS is_low_signal, arg_max(url, {'l': length(url), 's': seq}) AS url, arg_max(original_text, {'l': length(trim(regexp_replace(original_text, '\\s+', ' ', 'g'))), 's': seq}) AS original_text, ", 1) + "))"


def _store(spark: SparkSession) -> RunStore:
    return RunStore(spark, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}", rows_per_file=50_000)


@query(f"{ARRIVED} SELECT {', '.join(STORED)} FROM stored")
def store_delta_upsert(spark, sf_dir):
    """Three arrivals, each a run of its own; read without compaction."""
    store = _store(spark)
    for batch in arrivals(spark, sf_dir):
        store.upsert(batch)
    return store.read().select(*STORED)


@query(f"{ARRIVED} SELECT {', '.join(STORED)} FROM stored")
def store_compacted(spark, sf_dir):
    """The same after a compaction between the arrivals and one at the end; only the newest snapshot stays."""
    store = _store(spark)
    for batch in arrivals(spark, sf_dir):
        store.upsert(batch)
        store.compact()
    store.expire(1)
    return store.read().select(*STORED)


JUDGED_STORE = ARRIVED + f""", judged AS (SELECT *, CASE WHEN published_at IS NULL THEN 'unknown_date' WHEN published_at NOT BETWEEN DATE '{FIRST}' AND DATE '{LAST}' THEN 'out_of_range' WHEN is_campaign THEN 'campaign' WHEN is_low_signal THEN 'low_signal'
  WHEN length(trim(regexp_replace(title, '\\s+', ' ', 'g'))) < 3 OR NOT regexp_matches(title, '[\\pL\\pM]') OR length(trim(original_text)) < 3 OR NOT regexp_matches(original_text, '[\\pL\\pM]') THEN 'invalid' ELSE 'valid' END AS reason FROM stored) """


def _followed(spark, sf_dir, with_samples: bool) -> DataFrame:
    store, summary, samples = _store(spark), None, None
    for batch in arrivals(spark, sf_dir):
        judged = written(counters.judged_changes(store.upsert(batch)), "judged")
        if with_samples:
            now = store.read()
            samples = written(counters.sampled(now) if samples is None else counters.resampled(samples, judged, now), "samples")
        else:
            summary = written(counters.counted(summary, judged), "summary")
    return samples if with_samples else summary


@query(JUDGED_STORE + f"SELECT source, {', '.join(f'''count(*) FILTER (reason = '{r}') AS {r}''' for r in validate.REASONS)} FROM judged GROUP BY source")
def reason_counters_incremental(spark, sf_dir):
    """The counters of a period from the summary that three arrivals have changed."""
    return counters.period_counts(_followed(spark, sf_dir, False), *_period())


@query(JUDGED_STORE + ", r AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY post_key) AS INT) AS rank, post_key, reason, title, url FROM judged WHERE reason IN ('campaign', 'low_signal')) SELECT * FROM r WHERE rank <= 20")
def excluded_samples_incremental(spark, sf_dir):
    return counters.period_samples(_followed(spark, sf_dir, True), *_period())


# stop rules: a run is an event type and 97th of the users, a round one of its events
RUNS = """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || '/' || user_id % 97 AS run FROM events),
rounds AS (SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY event_id) AS INT) AS round, k, event_id % 5 AS m, event_id % 3 AS q, event_id % 211 = 7 AS bad FROM e),
log AS (SELECT run, round, CASE WHEN bad THEN 400.0 ELSE round END AS seconds, m AS posts, CASE WHEN q = 0 THEN m ELSE 0 END AS new, CASE WHEN k % 2 = 0 THEN m ELSE least(m, 1) END AS old_tail, CASE WHEN q < 2 THEN 0 ELSE 7 END AS moved FROM rounds),
w AS (SELECT *, sum(CASE WHEN old_tail < posts THEN 1 ELSE 0 END) OVER r AS oi, sum(CASE WHEN new > 0 THEN 1 ELSE 0 END) OVER r AS ni, sum(CASE WHEN moved > 0 THEN 1 ELSE 0 END) OVER r AS bi FROM log WINDOW r AS (PARTITION BY run ORDER BY round)),
c AS (SELECT *, sum(old_tail) OVER (PARTITION BY run, oi ORDER BY round) AS old, sum(CASE WHEN new = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run, ni ORDER BY round) AS stale, sum(CASE WHEN moved = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run, bi ORDER BY round) AS bottoms FROM w),
s AS (SELECT run, round, CASE WHEN seconds > 300 THEN 'time_budget' WHEN old >= 12 THEN 'period_boundary_reached' WHEN stale >= 6 AND coalesce(lag(bottoms) OVER (PARTITION BY run ORDER BY round), 0) >= 2 THEN 'stable_list' WHEN round = 200 THEN 'max_scrolls' END AS stop_reason FROM c)
SELECT run, CAST(min(round) - CASE WHEN arg_min(stop_reason, round) = 'time_budget' THEN 1 ELSE 0 END AS INT) AS rounds, arg_min(stop_reason, round) AS stop_reason FROM s WHERE stop_reason IS NOT NULL GROUP BY run"""


@query(RUNS)
def stop_reasons_stream(spark, sf_dir):
    """The rounds of all runs, dealt over files without order, as a stream of two batches or more."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumn("run", F.concat_ws("/", "event_type", F.col("user_id") % 97))
    numbered = Scan(e.select("run", "event_id", "k", F.col("ts").cast("timestamp").alias("at")), ["run"], ["event_id"]).running(round=("sum", F.lit(1)))
    m, q, whole = F.col("event_id") % 5, F.col("event_id") % 3, lambda c: c.cast("int")
    log = numbered.select(
        "run", whole(F.col("round")).alias("round"), "at", F.when(F.col("event_id") % 211 == 7, 400.0).otherwise(F.col("round")).alias("seconds"), F.lit(None).cast("string").alias("error"), whole(m).alias("posts"),
        whole(F.when(q == 0, m).otherwise(0)).alias("new"), F.lit(0).alias("period_new"), whole(F.when(F.col("k") % 2 == 0, m).otherwise(F.least(m, F.lit(1)))).alias("old_tail"), F.when(q < 2, 0).otherwise(7).alias("moved"),
    )
    root = f"{shared_folder(spark)}/stops-{uuid.uuid4().hex}"
    log.repartition(6, "round").write.parquet(f"{root}/log")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stops.ROCKSDB)
    try:
        source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 3).parquet(f"{root}/log")
        stream = stops.stops(source, stops.Board(), "3650 days").writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/stops").trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema("run string, rounds int, stop_reason string").parquet(f"{root}/stops")


# scans
@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS characters, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS last_user FROM conversations")
def running_turns(spark, sf_dir):
    """Characters so far and the last turn of the user, of each turn; a conversation of any length lies in many tasks."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    return Scan(c, ["conv_id"], ["turn"]).running(characters=("sum", F.col("n")), last_user=("last", F.when(F.col("role") == "user", F.col("turn")))).select("conv_id", "turn", "characters", "last_user")


# payloads
@query("SELECT doc_id, i AS place, CASE WHEN i = 2 THEN 'again ' || source ELSE text END AS text, source AS author FROM documents, (VALUES (0), (1), (2)) v(i)")
def flattened_payloads(spark, sf_dir):
    """A flattened payload a document: three items, of which two share the text and all the author, in wrappers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    value = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    cells = ['{"data":["Reactive",1]}', '{"vecFeed":2}', "[3,4,5]", '{"text":6,"author":["Ref",7]}', '{"text":["ShallowRef",6],"author":7}', '{"text":9,"author":8}']
    flat = F.concat(F.lit(f"[{','.join(cells)},"), value(F.col("text")), F.lit(',{"name":8},'), value(F.col("source")), F.lit(","), value(F.concat(F.lit("again "), "source")), F.lit("]"))
    items = docs.select("doc_id", F.posexplode(payloads.found_lists(payloads.resolve_references(flat), "vecFeed")).alias("place", "item"))
    author = F.coalesce(F.get_json_object("item", "$.author.name"), F.get_json_object("item", "$.author"))
    return items.select("doc_id", "place", F.get_json_object("item", "$.text").alias("text"), author.alias("author"))


# a rule table: each text of benchmark and its first sentence, as the two aliases of its item
@query(f"""WITH r AS (SELECT 'item ' || item_id AS label, {_sql_folded('text')} AS a, {_sql_folded("split_part(text, '. ', 1)")} || '.' AS b FROM benchmark), d AS (SELECT doc_id, {_sql_folded('text')} AS t FROM documents),
c AS (SELECT doc_id, label, a, b, t, (length(t) - length(replace(t, a, ''))) // length(a) AS n FROM d, r WHERE contains(t, a) OR contains(t, b)),
m AS (SELECT doc_id, label, n + CASE WHEN a = b THEN 0 ELSE (length(replace(t, a, chr(1))) - length(replace(replace(t, a, chr(1)), b, ''))) // length(b) END AS n FROM c) SELECT doc_id, label, CAST(n AS INT) AS n FROM m WHERE n > 0""")
def rule_table_counts(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    label = F.concat(F.lit("item "), "item_id").alias("label")
    sentence = F.concat(F.split_part("text", F.lit(". "), F.lit(1)), F.lit("."))
    rules = read("benchmark").select(label, F.explode(F.array(F.struct(F.col("text").alias("alias"), F.lit(0).alias("place")), F.struct(sentence.alias("alias"), F.lit(1).alias("place")))).alias("x")).select("label", "x.*")
    return by_rule_table(read("documents"), rules, "doc_id", F.col("text"))


# translations: lines of the documents; the stand-in translator writes E for e and fails on some lengths
@query("WITH l AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS chunk FROM documents) SELECT chunk, trim(replace(chunk, 'e', 'E'), ' ' || chr(9) || chr(13)) AS translated FROM l WHERE length(chunk) % 7 <> 3 AND trim(chunk, ' ') <> '' AND trim(chunk, ' ' || chr(9) || chr(13)) <> ''")
def translations_stream(spark, sf_dir):
    """The lines of all documents as a stream of two batches; a line that many batches have is sent once."""

    def send(texts):
        return [None if len(t) % 7 == 3 else t.replace("e", "E") for t in texts]

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_folder(spark)}/translations-{uuid.uuid4().hex}"
    lines = docs.select(F.posexplode(F.split("text", "\n")).alias("pos", "chunk"), F.col("doc_id").alias("seq")).select("chunk", "seq", "pos")
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines.repartition(files).write.parquet(f"{root}/lines")
    source = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(f"{root}/lines")
    queue = TranslationQueue(spark, root, send, "run", lanes=32, failures=1_000_000_000)
    queue.start(source, f"{root}/checkpoint").awaitTermination()
    return queue.cache()
