"""One run over the store: merge what came in, validate the whole store for the period, report on each source, order the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import store as stores
from ..operators import validate
from ..sources import values

#: Messages of a source's state.
DONE, NONE_LEFT, NOTHING = "기간·실제 게시일·본문 검증 완료", "누적 후보는 있으나 조회 기간 검증 후 0건", "공개 페이지에서 게시글을 찾지 못함"
KEPT, CHECKED = " · 이전에 누적한 원문으로 기간 내 ", "건 검증"

#: Readers by source: each takes a session and gives its posts. Callers add their own.
Reader = Callable[[SparkSession], DataFrame]


class SourceUnavailable(Exception):
    """A source that can't be read now; the run goes on with what the store has."""


def selected(spark: SparkSession, wanted: list[str], readers: dict[str, Reader]) -> DataFrame:
    """source, place of the wanted sources that have a reader, in the order wanted."""
    rows = spark.createDataFrame([(s, k) for k, s in enumerate(dict.fromkeys(wanted))], "source string, place int")
    known = spark.createDataFrame([(s,) for s in readers], "source string")
    return rows.join(F.broadcast(known), "source", "left_semi")


def live_posts(spark: SparkSession, wanted: list[str], readers: dict[str, Reader]) -> tuple[DataFrame | None, DataFrame]:
    """The posts of all wanted sources, and failures(source, failed, reason): a reader that raises doesn't end the run."""
    found, failures = [], []
    for source in dict.fromkeys(s for s in wanted if s in readers):
        try:
            found.append(readers[source](spark))
        except SourceUnavailable as e:
            failures.append((source, "blocked", str(e)))
        except Exception as e:  # noqa: BLE001  reported in the status
            failures.append((source, "error", f"수집 오류: {type(e).__name__}"))
    posts = None
    for f in found:
        posts = f if posts is None else posts.unionByName(f, allowMissingColumns=True)
    return posts, spark.createDataFrame(failures, "source string, failed string, reason string")


@dataclass
class Run:
    posts: DataFrame  # in order, capped
    status: DataFrame  # a row a source
    store: DataFrame  # merged, with change


def run(sources: DataFrame, store: DataFrame, live: DataFrame, failures: DataFrame, first: Column, last: Column, most: int | None = None, relevant: Column | None = None) -> Run:
    """store and live have post_key, seq and the fields of a post; published_at is a date. A key that comes several times in live
    counts once, as new or updated. The store is judged as a whole, whatever came in now; write Run.store and read it again
    before using it and the rest, else the merge is worked out for each of them."""
    now = stores.upsert(store, live).join(sources.select("source"), "source", "left_semi")
    reason = validate.reason(first, last, relevant)
    judged = now.withColumn("reason", reason)
    status = status_of(sources, judged, store, live, failures, first, last)
    valid = judged.filter("reason = 'valid'")
    posts = valid.orderBy(F.desc("published_at"), F.desc("source"), F.desc("post_key"))
    picked = posts.limit(most) if most else posts
    chosen = picked.groupBy("source").agg(F.count(F.lit(1)).alias("selected_count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))  # a row a source
    status = status.join(chosen, "source", "left").withColumn("total_valid_unique", total)
    status = status.withColumns({"selected_count": F.coalesce("selected_count", F.lit(0)), "result_limit_reached": (F.col("total_valid_unique") > most) if most else F.lit(False)})
    return Run(picked, status, now)


def status_of(sources: DataFrame, judged: DataFrame, store: DataFrame, live: DataFrame, failures: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row a source: state, message, counts, samples of what was excluded."""
    count = lambda c, name: F.count_if(c).alias(name)
    counts = judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("candidate_count"), count(F.col("reason") == "valid", "count"), count(F.col("change") == "new", "new_candidate_count"), count(F.col("change") == "updated", "updated_candidate_count"),
        *[count(F.col("reason") == r, f"excluded_{r}") for r in validate.REASONS if r != "valid"],
    )
    before = store.groupBy("source").agg(F.count(F.lit(1)).alias("cache_before_count"), count(F.col("published_at").between(first, last), "cached_period_before"))
    came = live.groupBy("source").agg(F.count(F.lit(1)).alias("live_candidate_count"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("post_key"))  # keeps 20 rows a source and task
    few = judged.filter(F.col("reason").isin(*values.EXCLUDED_NAMES)).withColumn("_k", rank).filter("_k <= 20")
    name = F.create_map(*[F.lit(x) for pair in values.EXCLUDED_NAMES.items() for x in pair])
    sample = F.struct("_k", F.struct(name[F.col("reason")].alias("reason"), F.col("published_at").alias("date"), "title", "url").alias("x"))
    samples = few.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(sample)), lambda s: s["x"]).alias("excluded_samples"))
    out = sources.join(counts, "source", "left").join(before, "source", "left").join(came, "source", "left").join(failures, "source", "left").na.fill(0)
    out = out.join(samples, "source", "left")
    n, failed = F.col("count"), F.col("failed").isNotNull()
    state = F.when(failed & (n == 0), F.col("failed")).when(~failed & (n > 0), "success").otherwise("warning")
    kept = F.concat(F.col("reason"), F.lit(KEPT), F.format_number(n, 0), F.lit(CHECKED))
    message = F.when(failed & (n > 0), kept).when(failed, F.col("reason")).when(n > 0, DONE).when(F.col("candidate_count") > 0, NONE_LEFT).otherwise(NOTHING)
    return out.withColumns({"ok": n > 0, "state": state, "message": message, "cumulative_candidate_count": F.col("candidate_count")}).drop("failed", "reason", "place")


TOTALS = ["excluded_unknown_date", "excluded_out_of_range", "excluded_irrelevant", "excluded_invalid", "excluded_campaign", "excluded_low_signal", "candidate_count"]


def page_totals(status: DataFrame) -> DataFrame:
    """One row: the counts of all sources."""
    return status.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS])


def in_period(analysed: DataFrame, first: Column, last: Column, keep_unknown: bool = False) -> tuple[DataFrame, DataFrame]:
    """The posts of the period (and undated ones, if asked), and how many are undated, as one row."""
    unknown = analysed.agg(F.count_if(F.col("date").isNull()).alias("unknown"))
    wanted = F.col("date").between(first, last) | (F.col("date").isNull() & F.lit(keep_unknown))
    return analysed.filter(F.coalesce(wanted, F.lit(False))), unknown


def translation_failures(translated: DataFrame) -> DataFrame:
    return translated.agg(F.count_if(F.coalesce("translation_error", F.lit("")) != "").alias("failures"))


def notes(status: DataFrame) -> DataFrame:
    """source, message of the sources that this run didn't read as it should."""
    return status.filter(~F.coalesce("state", F.lit("")).isin("success", "") | ~F.coalesce("ok", F.lit(True))).select("source", F.coalesce(F.nullif("message", F.lit("")), F.lit("상태 미확인")).alias("message"))


def board_summary(boards: DataFrame, feeds: DataFrame, routes: DataFrame, main: str, official: str) -> DataFrame:
    """A row a run of boards(run, section, complete, rounds, candidate_count, detail_verified_count, detail_failed_count,
    old_post_count, oldest_verified_date, stop_reason), feeds(run, feed_stop_reason) and routes(run, section, discovery,
    excluded_section): sums over boards, what the main board says, and how far the period is covered."""
    of = lambda section, c: F.max(F.when(F.col("section") == section, F.col(c)))
    sums = boards.groupBy("run").agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(to) for c, to in (("rounds", "collection_rounds"), ("detail_verified_count", "detail_verified_count"), ("detail_failed_count", "detail_failed_count"))],
        F.coalesce(of(main, "candidate_count"), F.lit(0)).alias("main_board_candidate_count"), F.coalesce(of(official, "candidate_count"), F.lit(0)).alias("official_board_candidate_count"),
        of(main, "oldest_verified_date").alias("oldest_verified_date"), F.coalesce(of(main, "stop_reason"), F.lit("no_main_board")).alias("sample_stop_reason"),
        F.coalesce(F.bool_or((F.col("section") == main) & F.col("complete")), F.lit(False)).alias("_main"),
    )
    found = routes.groupBy("run").agg(F.count(F.lit(1)).alias("board_route_count"), F.bool_or((F.col("discovery") == "fallback") & F.col("section").isin(main, official)).alias("board_discovery_fallback"))
    out = sums.join(feeds.select("run", "feed_stop_reason"), "run", "left").join(found, "run", "left")
    complete = F.col("_main") | F.coalesce(F.col("feed_stop_reason") == "period_boundary_reached", F.lit(False))
    return out.withColumns({
        "period_boundary_reached": complete, "coverage_state": F.when(complete, "period_complete_public").otherwise("partial"),
        "collection_mode": F.when(complete, "chronological_period_complete").otherwise("chronological_plus_rotating_sample"),
    }).drop("_main")
