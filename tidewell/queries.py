"""The queries over the synthetic tables, with the SQL (DuckDB) that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, text
from .operators import analytics, coverage, rules, store, translate, validate
from .operators.scan import Scan
from .plans import report
from .sources import pages, payloads
from .sources.synthetic import posts

#: Demonstration rules for the synthetic texts; real rules are the caller's data.
CATEGORIES = [("alpha", ["the", "das", "ción"]), ("beta", ["avec", "with", "mit"]), ("gamma", ["dans", "from", "ñado"]), ("delta", ["pour", "para", "für"])]
KEYWORDS = [("with", "beta", ["with", "mit"]), ("for", "delta", ["pour", "para", "für"]), ("in", "gamma", ["dans", "from"]), ("cion", "alpha", ["ciónes", "ción"]), ("article", "alpha", ["the", "das"])]
KEYWORD_RULES, CATEGORY_OF = [(k, a) for k, _, a in KEYWORDS], {k: c for k, c, _ in KEYWORDS}
EVENTS, GUIDES, VIDEO_SOURCE, OFFICIAL_SOURCE = ["über"], ["that", "sobre"], "src1", "src4"
FIRST, LAST = "2024-01-05", "2024-01-25"
STOPWORDS = ["and", "der", "les"]
_STOP = ", ".join(f"'{t}'" for t in STOPWORDS + rules.registered(CATEGORIES))

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


POSTS = """posts AS (
  SELECT d.doc_id AS seq, d.source, left(trim(d.text, ' '), 72) AS title, d.text AS original_text, p.url,
    CASE WHEN d.doc_id % 17 <> 0 THEN CAST(e.ts AS DATE) END AS published_at, CAST(floor(e.value) AS BIGINT) AS views,
    CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS comments, coalesce(l.quality, 1) = 0 AS is_low_signal, coalesce(l.toxic, 0) = 1 AS is_campaign, d.doc_id % 23 = 0 AS is_official
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id * 5 LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id)"""


def _sql_count(field: str, aliases: list[str]) -> str:
    """Claimed occurrences; ASCII aliases are whole [a-z0-9] runs, others are cut out longest first."""
    parts, left = [], field
    for a in rules.ordered(aliases):
        if a.isascii():
            parts.append(f"len(list_filter(regexp_extract_all({field}, '[a-z0-9]+'), lambda x: x = '{a}'))")
        else:
            parts.append(f"(length({left}) - length(replace({left}, '{a}', ''))) // {len(a)}")
            left = f"replace({left}, '{a}', '\x01')"
    return " + ".join(parts)


def _sql_folded(field: str) -> str:
    return f"replace(lower(trim(regexp_replace({field}, '\\s+', ' ', 'g'))), 'ß', 'ss')"


_N = len(CATEGORIES)
ANALYSED = f"""{POSTS}, folded AS (SELECT *, {_sql_folded("title || ' ' || original_text")} AS t, {_sql_folded("title")} AS t1, {_sql_folded("original_text")} AS t2 FROM posts),
scored AS (SELECT *, {", ".join(f"CAST({_sql_count('t', a)} AS INT) AS s{k}" for k, (_, a) in enumerate(CATEGORIES))},
  {", ".join(f"greatest(CAST({_sql_count('t1', a)} AS INT), CAST({_sql_count('t2', a)} AS INT)) AS w{k}" for k, (_, a) in enumerate(KEYWORD_RULES))},
  CASE WHEN is_official OR source = '{OFFICIAL_SOURCE}' THEN '{rules.OFFICIAL}' WHEN ({_sql_count("t", EVENTS)}) > 0 THEN '{rules.EVENT}' WHEN ({_sql_count("t", GUIDES)}) > 0 OR source = '{VIDEO_SOURCE}' THEN '{rules.GUIDE}' ELSE '{rules.NATURAL}' END AS content_type FROM folded),
listed AS (SELECT *, list_transform(list_sort(list_filter([{", ".join(f"{{'s': -s{k}, 'o': {k}, 'c': '{c}'}}" for k, (c, _) in enumerate(CATEGORIES))}], lambda x: x.s < 0)), lambda x: x.c) AS found FROM scored),
catted AS (SELECT *, CASE WHEN len(found) = 0 THEN ['{rules.OTHER}'] ELSE found END AS cats FROM listed),
analysed AS (SELECT *, cats[1] AS category, content_type = '{rules.NATURAL}' AS eligible, coalesce(comments, 0) AS engagement, coalesce(views, 0) AS views0 FROM catted),
mentioned AS ({" UNION ALL ".join(f"SELECT seq, title, url, source, original_text, published_at, views0, category, content_type, engagement, '{k}' AS keyword, '{CATEGORY_OF[k]}' AS own, w{i} AS n FROM analysed WHERE w{i} > 0" for i, (k, _) in enumerate(KEYWORD_RULES))})"""
W = f"WITH {ANALYSED} "


def analysed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.analysed(posts(spark, sf_dir, spread=True), CATEGORIES, KEYWORD_RULES, EVENTS, GUIDES, OFFICIAL_SOURCE, VIDEO_SOURCE)


# projections and predicates
#: Entities in SQL: DuckDB has no such function, so the named ones of XML and blanks; others are held against html.unescape in tests.
def _sql_clean(field: str) -> str:
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        field = f"replace({field}, '{name}', '{to}')"
    return f"trim(regexp_replace({field}, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_sql_clean('text')} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {_sql_clean('text')} AS cleaned FROM documents")
def clean_text_whole(spark, sf_dir):
    return clean_text(spark, sf_dir)


@query("WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 72 THEN t ELSE rtrim(t[:71]) || '…' END AS title FROM c")
def excerpt_title(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.excerpt(F.col("text")).alias("title"))


@query("""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^[a-z]+:', '') WHEN 2 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 3 THEN url || '#f' ELSE NULLIF(url, url) END AS u FROM pages),
b AS (SELECT page_id, coalesce(regexp_replace(trim(u), '(?s)[?#].*$', ''), '') AS b FROM u) SELECT page_id, CASE WHEN b = '' THEN '' WHEN starts_with(b, '//') THEN 'https:' || b WHEN contains(b, '://') THEN b ELSE 'https://' || b END AS url FROM b""")
def canonical_url(spark, sf_dir):
    """All pages; a fifth each without scheme, without host marks, with a fragment, and null."""
    bare = lambda pattern: F.regexp_replace("url", pattern, "")
    kind = F.col("page_id") % 5
    url = F.when(kind == 0, F.col("url")).when(kind == 1, bare("^[a-z]+:")).when(kind == 2, bare("^[a-z]+://")).when(kind == 3, F.concat("url", F.lit("#f")))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.canonical_url(url).alias("url"))


@query(f"WITH {POSTS} SELECT seq, CASE WHEN coalesce(url, '') <> '' THEN regexp_replace(trim(url), '(?s)[?#].*$', '') ELSE source || '|' || coalesce(CAST(published_at AS VARCHAR), '') || '|' || lower(regexp_replace(title, '[^\\pL\\pN\\pM\\p{{Pc}}]+', '', 'g')) END AS post_key FROM posts")
def post_key(spark, sf_dir):
    p = posts(spark, sf_dir)
    return p.select("seq", text.post_key(F.col("url"), F.col("source"), F.col("published_at"), F.col("title")).alias("post_key"))


@query(f"WITH c AS (SELECT doc_id, {_sql_clean('text')} AS t FROM documents) SELECT doc_id, length(t) >= 3 AND regexp_matches(t, '[\\pL\\pM]') AS meaningful, length(regexp_replace(regexp_replace(t, '#\\S+', '', 'g'), '[^\\pL\\pN\\pM]', '', 'g')) < 2 AS low_signal FROM c")
def text_flags(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", text.is_meaningful(F.col("text")).alias("meaningful"), text.is_low_signal(F.col("text")).alias("low_signal"))


@query(ORACLE_SQL["text_flags"])
def text_flags_whole(spark, sf_dir):
    return text_flags(spark, sf_dir)


@query("SELECT o_orderkey, CAST(floor(CAST(regexp_extract(CAST(o_orderkey AS VARCHAR), '[0-9]+') AS DECIMAL(28,8)) * 10000) AS BIGINT) AS n FROM orders")
def parse_count(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.parse_count(F.concat(F.lit("≈"), F.format_number("o_orderkey", 0), F.lit("万"))).alias("n"))


@query("SELECT event_id, CAST(epoch_ms(1704067200000 + event_id * 60000) + INTERVAL 8 HOUR AS DATE) AS day FROM events")
def epoch_date(spark, sf_dir):
    seconds = F.lit(1704067200) + F.col("event_id") * 60
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", dates.epoch_date(F.concat(seconds.cast("string"), F.lit("123"))).alias("day"))


@query(f"WITH {POSTS} SELECT seq, published_at FROM posts WHERE published_at BETWEEN DATE '{FIRST}' AND DATE '{LAST}' OR published_at IS NULL")
def period_filter(spark, sf_dir):
    p = posts(spark, sf_dir)
    return p.filter(dates.in_period(F.col("published_at"), F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")) | F.col("published_at").isNull()).select("seq", "published_at")


# validation
JUDGED = f"""WITH {POSTS}, judged AS (SELECT *, CASE WHEN published_at IS NULL THEN 'unknown_date' WHEN published_at NOT BETWEEN DATE '{FIRST}' AND DATE '{LAST}' THEN 'out_of_range' WHEN is_campaign THEN 'campaign' WHEN is_low_signal THEN 'low_signal'
  WHEN length(trim(regexp_replace(title, '\\s+', ' ', 'g'))) < 3 OR NOT regexp_matches(title, '[\\pL\\pM]') OR length(trim(original_text)) < 3 OR NOT regexp_matches(original_text, '[\\pL\\pM]') THEN 'invalid' ELSE 'valid' END AS reason FROM posts) """


def judged(spark, sf_dir):
    return posts(spark, sf_dir).withColumn("reason", validate.reason(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")))


@query(JUDGED + "SELECT seq, reason FROM judged")
def validate_reasons(spark, sf_dir):
    return judged(spark, sf_dir).select("seq", "reason")


@query(JUDGED + f"SELECT source, {', '.join(f'''count(*) FILTER (reason = '{r}') AS {r}''' for r in validate.REASONS)} FROM judged GROUP BY source")
def exclusion_counts(spark, sf_dir):
    return validate.exclusion_counts(judged(spark, sf_dir))


@query(JUDGED + ", r AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY seq) AS INT) AS rank, seq, reason, title FROM judged WHERE reason <> 'valid') SELECT * FROM r WHERE rank <= 20")
def excluded_samples(spark, sf_dir):
    return validate.excluded_samples(judged(spark, sf_dir))


@query(JUDGED + ", s AS (SELECT source, count(*) AS candidate_count, count(*) FILTER (reason = 'valid') AS count FROM judged GROUP BY source) SELECT *, CASE WHEN count > 0 THEN 'success' ELSE 'warning' END AS state, count > 0 AS ok FROM s UNION ALL SELECT 'unseen', 0, 0, 'warning', false")
def status_table(spark, sf_dir):
    j = judged(spark, sf_dir)
    sources = j.select("source").distinct().unionByName(spark.createDataFrame([("unseen",)], "source string"))
    return validate.source_status(j, sources)


# store
SIGHTED = f"""WITH {POSTS}, keyed AS (SELECT *, lower(title) AS post_key FROM posts),
twice AS (SELECT seq, source, title, original_text, url, published_at, views, comments, is_low_signal, is_campaign, is_official, post_key, 'a' || seq % 7 AS author, 's' || seq % 3 AS source_section, 'first' AS published_at_source, 'short' AS content_scope, 'note' AS source_note FROM keyed
  UNION ALL SELECT seq + 1000000000, '', title || ' ', original_text, url, NULL, views + seq % 3, comments, false, false, seq % 2 = 0, post_key, CASE WHEN seq % 2 = 0 THEN 'b' ELSE '' END, NULL, 'again', 'longer', 'n' FROM keyed)"""
MERGED = """SELECT post_key, bool_or(is_official) AS is_official, bool_or(is_campaign) AS is_campaign, max(views) AS views, max(comments) AS comments,
  arg_max(title, {'l': length(trim(regexp_replace(title, '\\s+', ' ', 'g'))), 's': seq}) AS title, arg_max(source, seq) FILTER (source <> '') AS source, arg_max(published_at, seq) FILTER (published_at IS NOT NULL) AS published_at, max(seq) AS seq, count(*) AS n_seen,
  arg_max(author, seq) FILTER (author <> '') AS author, arg_max(source_section, seq) FILTER (source_section <> '') AS source_section, arg_max(published_at_source, seq) AS published_at_source,
  arg_max(content_scope, {'l': length(content_scope), 's': seq}) AS content_scope, arg_max(source_note, {'l': length(source_note), 's': seq}) AS source_note FROM twice GROUP BY post_key"""


def sighted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return sighted_of(posts(spark, sf_dir))


def sighted_of(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    first = first.withColumns({"post_key": F.lower("title"), "author": F.concat(F.lit("a"), F.col("seq") % 7), "source_section": F.concat(F.lit("s"), F.col("seq") % 3), "published_at_source": F.lit("first"), "content_scope": F.lit("short"), "source_note": F.lit("note")})
    again = first.withColumns({"author": F.when(F.col("seq") % 2 == 0, "b").otherwise(""), "source_section": F.lit(None).cast("string"), "published_at_source": F.lit("again"), "content_scope": F.lit("longer"), "source_note": F.lit("n"), "source": F.lit(""), "title": F.concat("title", F.lit(" ")), "published_at": F.lit(None).cast("date"), "views": F.col("views") + F.col("seq") % 3, "is_low_signal": F.lit(False), "is_campaign": F.lit(False), "is_official": F.col("seq") % 2 == 0})
    return first, again.withColumn("seq", F.col("seq") + 1_000_000_000)


MERGED_COLUMNS = ["post_key", "is_official", "is_campaign", "views", "comments", "title", "source", "published_at", "seq", "n_seen", "author", "source_section", "published_at_source", "content_scope", "source_note"]


@query(f"{SIGHTED} {MERGED}")
def dedupe_merge(spark, sf_dir):
    first, again = sighted(spark, sf_dir)
    return store.merged(first.unionByName(again)).select(*MERGED_COLUMNS)


@query(f"{SIGHTED} {MERGED}")
def store_overlay(spark, sf_dir):
    """The first sightings as the shared store, the others as the local one."""
    first, again = sighted(spark, sf_dir)
    return store.overlay(first, again).select(*MERGED_COLUMNS)


@query(f"""WITH {POSTS}, keyed AS (SELECT *, source || '|' || seq AS post_key FROM posts), changed AS (SELECT seq, CASE WHEN views IS NULL THEN 'unchanged' WHEN seq % 3 > 0 THEN 'updated' ELSE 'unchanged' END AS change FROM keyed),
fresh AS (SELECT page_id FROM pages) SELECT change, count(*) AS n FROM (SELECT change FROM changed UNION ALL SELECT 'new' FROM fresh) GROUP BY change""")
def upsert_counts(spark, sf_dir):
    known = posts(spark, sf_dir).withColumn("post_key", F.concat_ws("|", "source", "seq"))
    seen = known.withColumn("views", F.col("views") + F.col("seq") % 3)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    fresh = pages.select(F.concat(F.lit("page|"), F.col("page_id")).alias("post_key"), (F.col("page_id") + 2_000_000_000).alias("seq"), "url", F.lit("page").alias("source"), F.lit("page").alias("title"))
    return store.upsert(known, seen.unionByName(fresh, allowMissingColumns=True), unique=True).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


# classification
@query(W + "SELECT seq, category, array_to_string(cats, ', ') AS all_categories FROM analysed")
def category_main(spark, sf_dir):
    return analysed_posts(spark, sf_dir).select("seq", "category", "all_categories")


@query(W + f"SELECT seq, content_type, eligible, CASE content_type {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in rules.ROLES.items())} END AS role FROM analysed")
def content_type(spark, sf_dir):
    return analysed_posts(spark, sf_dir).select("seq", "content_type", F.col("trend_eligible").alias("eligible"), F.col("analysis_role").alias("role"))


@query(W + "SELECT seq, keyword, n FROM mentioned")
def keyword_map(spark, sf_dir):
    return analysed_posts(spark, sf_dir).select("seq", F.explode("keyword_counts").alias("keyword", "n"))


_KINDS = ", ".join(f"count(*) FILTER (content_type = '{k}') AS {n}" for n, k in (("natural", rules.NATURAL), ("guide", rules.GUIDE), ("event", rules.EVENT), ("official", rules.OFFICIAL)))


@query(W + f", dim AS (SELECT * FROM (VALUES {', '.join(f'''({k}, '{c}')''' for k, c in enumerate([*[c for c, _ in CATEGORIES], rules.OTHER]))}) v(category_order, category)), counts AS (SELECT category, {_KINDS}, count(*) AS total FROM analysed GROUP BY category) SELECT CAST(category_order AS INT) AS category_order, category, coalesce(\"natural\", 0) AS \"natural\", coalesce(guide, 0) AS guide, coalesce(event, 0) AS event, coalesce(official, 0) AS official, coalesce(total, 0) AS total FROM dim LEFT JOIN counts USING (category)".replace(" AS natural", ' AS "natural"'))
def category_crosstab(spark, sf_dir):
    return analytics.crosstab(analysed_posts(spark, sf_dir), [c for c, _ in CATEGORIES])


@query(W + "SELECT keyword, any_value(own) AS category, count(*) AS posts, CAST(sum(n) AS BIGINT) AS mentions, CAST(row_number() OVER (ORDER BY count(*) DESC, sum(n) DESC, keyword) AS INT) AS rank FROM mentioned GROUP BY keyword")
def keyword_stats(spark, sf_dir):
    return analytics.keyword_stats(analysed_posts(spark, sf_dir), CATEGORY_OF)


@query(W + "SELECT eligible, count(*) AS n, CAST(sum(engagement) AS BIGINT) AS engagement FROM analysed GROUP BY eligible")
def split_evidence(spark, sf_dir):
    return analysed_posts(spark, sf_dir).groupBy(F.col("trend_eligible").alias("eligible")).agg(F.count(F.lit(1)).alias("n"), F.sum("engagement").alias("engagement"))


@query(W + f"SELECT a.seq FROM analysed a JOIN mentioned m USING (seq) WHERE m.keyword = 'with' AND a.category = 'beta' AND a.content_type = '{rules.NATURAL}'")
def display_filter(spark, sf_dir):
    return analysed_posts(spark, sf_dir).filter((F.col("category") == "beta") & (F.col("content_type") == rules.NATURAL) & F.map_contains_key("keyword_counts", "with")).select("seq")


@query(W + f"SELECT published_at AS date, count(*) AS total, count(*) FILTER (content_type = '{rules.NATURAL}') AS \"natural\" FROM analysed WHERE published_at IS NOT NULL GROUP BY published_at")
def daily_counts(spark, sf_dir):
    return analytics.daily(analysed_posts(spark, sf_dir))


@query(W + f"SELECT source, count(*) AS total, {_KINDS} FROM analysed GROUP BY source".replace(" AS natural", ' AS "natural"'))
def source_counts(spark, sf_dir):
    return analytics.by_source(analysed_posts(spark, sf_dir))


@query(W + "SELECT category, content_type, source, count(*) AS n FROM analysed GROUP BY ALL")
def value_counts(spark, sf_dir):
    return analysed_posts(spark, sf_dir).groupBy("category", "content_type", "source").agg(F.count(F.lit(1)).alias("n"))


@query(W + "SELECT seq, views0 AS views, title FROM analysed WHERE views0 > 0 ORDER BY views0 DESC, seq LIMIT 10")
def top_by_metric(spark, sf_dir):
    return analytics.top(analysed_posts(spark, sf_dir), "views", 10).select("seq", "views", "title")


@query(W + ", r AS (SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY engagement DESC, views0 DESC, seq) AS INT) AS rank, seq FROM analysed) SELECT * FROM r WHERE rank <= 12")
def top_per_category(spark, sf_dir):
    return analytics.top_per_group(analysed_posts(spark, sf_dir), "category", [F.desc("engagement"), F.desc("views"), "seq"], 12).select("category", "rank", "seq")


@query(W + f""", lab AS (SELECT category, seq, engagement * 3 + views0 AS score, trim(regexp_replace(CASE WHEN trim(title) = '' THEN original_text ELSE title END, '\\s+', ' ', 'g')) AS t FROM analysed WHERE eligible),
one AS (SELECT category, CASE WHEN length(t) <= 68 THEN t ELSE rtrim(t[:67]) || '…' END AS title, score, seq, row_number() OVER (PARTITION BY category, CASE WHEN length(t) <= 68 THEN t ELSE rtrim(t[:67]) || '…' END ORDER BY score DESC, seq) AS k FROM lab),
r AS (SELECT category, title, row_number() OVER (PARTITION BY category ORDER BY score DESC, seq) AS rank FROM one WHERE k = 1 AND title <> ''), c AS (SELECT category, count(*) AS posts FROM analysed WHERE eligible GROUP BY category) SELECT category, posts, CAST(round_even(posts * 100 / (SELECT sum(posts) FROM c), 0) AS INT) AS percent, (SELECT string_agg(title, ' / ' ORDER BY rank) FROM r WHERE r.category = c.category AND rank <= 2) AS titles FROM c""")
def narrative_inputs(spark, sf_dir):
    return report.narrative_inputs(analysed_posts(spark, sf_dir))


@query(W + f""", runs AS (SELECT seq, title, unnest(list_distinct(regexp_extract_all(concat_ws(' ', title, original_text), '\\pL+'))) AS r FROM analysed WHERE category = '{rules.OTHER}'),
each AS (SELECT DISTINCT seq, left(title, 60) AS title, r[i:i + s - 1] AS term FROM (SELECT seq, title, r, s, unnest(range(1, length(r) - s + 2)) AS i FROM runs, (VALUES (2), (3)) v(s) WHERE length(r) >= s) WHERE term NOT IN ({_STOP})),
counts AS (SELECT term, count(*) AS posts, arg_min(title, seq) AS example FROM each GROUP BY term HAVING count(*) >= 2)
SELECT term, posts, example FROM counts c WHERE length(term) = 3 OR NOT EXISTS (SELECT 1 FROM counts l WHERE length(l.term) = 3 AND l.posts >= c.posts AND (l.term[1:2] = c.term OR l.term[2:3] = c.term)) ORDER BY posts DESC, term LIMIT 25""")
def ngram_terms(spark, sf_dir):
    """Over the posts of the fallback category, without stop words and registered aliases."""
    rest = analysed_posts(spark, sf_dir).filter(F.col("category") == rules.OTHER)
    return analytics.terms(rest, r"\p{L}", stop=STOPWORDS + rules.registered(CATEGORIES))


TOPICS_CTE = W + f""", own AS (SELECT * FROM mentioned WHERE own = category AND content_type = '{rules.NATURAL}'), g AS (SELECT keyword AS topic, category, count(*) AS posts, list(coalesce(nullif(url, ''), source || '|' || title) ORDER BY coalesce(nullif(url, ''), source || '|' || title)) AS members, arg_max(title, {{'e': engagement, 's': -seq}}) AS example FROM own GROUP BY ALL HAVING count(*) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY members ORDER BY length(topic) DESC, topic) AS k FROM g), topics AS (SELECT topic, category, posts, example FROM k WHERE k = 1)"""


@query(TOPICS_CTE + " SELECT * FROM topics")
def repeated_topics(spark, sf_dir):
    return analytics.repeated_topics(analysed_posts(spark, sf_dir), CATEGORY_OF)


# translation; the stand-in translator writes E for e
CHUNKS = f"""WITH RECURSIVE {POSTS}, cut AS (
  SELECT seq, -1 AS pos, '' AS chunk, regexp_replace(original_text, '^\\s+|\\s+$', '', 'g') AS rest FROM posts WHERE original_text IS NOT NULL
  UNION ALL SELECT seq, pos + 1, left(rest, n), regexp_replace(substr(rest, n + 1), '^\\s+', '') FROM (
    SELECT seq, pos, rest, CASE WHEN length(rest) <= 800 THEN length(rest) WHEN length(regexp_extract(left(rest, 800), '(?s)^.*[。！？\n]')) > 400 THEN length(regexp_extract(left(rest, 800), '(?s)^.*[。！？\n]')) ELSE 800 END AS n FROM cut WHERE rest <> ''))
SELECT seq, CAST(pos AS INT) AS pos, regexp_replace(chunk, '\\s+$', '') AS chunk FROM cut WHERE pos >= 0"""


@query(CHUNKS)
def chunk_split(spark, sf_dir):
    return translate.chunks(posts(spark, sf_dir))


@query(f"WITH {POSTS}, lines AS (SELECT seq, unnest(string_split(original_text, chr(10))) AS chunk FROM posts) SELECT DISTINCT chunk FROM lines WHERE chunk NOT IN (SELECT text FROM benchmark)")
def pending_chunks(spark, sf_dir):
    lines = posts(spark, sf_dir).select("seq", F.explode(F.split("original_text", "\n")).alias("chunk"))
    return translate.pending(lines, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("text").alias("chunk")).distinct())


@query(f"WITH {POSTS}, c AS (SELECT seq, len(list_filter(string_split(original_text, chr(10)), lambda x: length(x) % 7 = 3)) > 0 AS failed, replace(original_text, 'e', 'E') AS t FROM posts WHERE original_text IS NOT NULL UNION ALL SELECT seq, false, '' FROM posts WHERE original_text IS NULL) SELECT seq, CASE WHEN failed THEN '' ELSE t END AS translated_text, failed FROM c")
def reassemble(spark, sf_dir):
    p = posts(spark, sf_dir)
    parts = p.select("seq", F.posexplode(F.split("original_text", "\n")).alias("pos", "chunk"))
    cache = parts.select("chunk").distinct().filter(F.length("chunk") % 7 != 3).withColumn("translated", F.replace("chunk", F.lit("e"), F.lit("E")))
    return translate.reassemble(parts, cache, p)


# sources
@query("SELECT d.doc_id, d.source, coalesce(n.n_name, '') AS section FROM documents d LEFT JOIN nation n ON d.source = 'src' || n.n_nationkey")
def section_join(spark, sf_dir):
    docs, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "nation"))
    sections = nation.select(F.concat(F.lit("src"), F.col("n_nationkey")).alias("source"), F.col("n_name").alias("name"))
    return docs.select("doc_id", "source").join(sections, "source", "left").select("doc_id", "source", F.coalesce("name", F.lit("")).alias("section"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + i AS k FROM events, (VALUES (0), (1)) v(i)")
def json_walk(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(k.alias("k")), F.struct((k + 1).alias("k"))).alias("vecFeed")).alias("data")))
    each = events.select("event_id", F.explode(payloads.found_lists(payload, "vecFeed")).alias("item"))
    return each.select("event_id", F.get_json_object("item", "$.k").cast("bigint").alias("k"))


@query()
def page_parse(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", pages.page(F.col("html")).alias("p"))
    return p.select("page_id", "p.title", "p.heading", F.size(text.drop_repeats(F.col("p.lines"))).alias("n_lines"))


@query("WITH l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn FROM l WHERE role IS DISTINCT FROM before")
def line_dedupe(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    c = Scan(c.select("conv_id", "turn", "role"), ["conv_id"], ["turn"]).framed(1, before=lambda w: F.last("role").over(w.rowsBetween(-1, -1)))
    return c.filter(~F.col("role").eqNullSafe(F.col("before"))).select("conv_id", "turn")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS user_turn FROM conversations")
def nearest_previous(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = Scan(c.select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("user")), ["conv_id"], ["turn"])
    return turns.framed(5, user_turn=lambda w: F.last("user", ignorenulls=True).over(w.rowsBetween(-5, -1))).select("conv_id", "turn", "user_turn")


# coverage: a run is an event type, a round an hour, a key a user
LOG = "WITH log AS (SELECT event_type, event_id, user_id, value, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS round FROM events)"


def round_log(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_type", "event_id", "user_id", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).alias("round"))


ROUNDS = LOG + ", firsts AS (SELECT event_type, user_id, min(event_id) AS f FROM log GROUP BY ALL), rounds AS (SELECT event_type, round, count(*) AS posts, count(*) FILTER (event_id = f) AS new FROM log JOIN firsts USING (event_type, user_id) GROUP BY ALL)"


@query(ROUNDS + ", w AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round) AS n, CAST(sum(new) OVER (PARTITION BY event_type ORDER BY round ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent_new FROM rounds) SELECT event_type, round, posts, new, CAST(n AS INT) AS rounds, recent_new, n >= 30 AND recent_new = 0 AS converged FROM w")
def convergence(spark, sf_dir):
    return coverage.converged(coverage.rounds(round_log(spark, sf_dir), "event_type", "user_id", "event_id", "round"), "event_type", "round")


@query(LOG + ", i AS (SELECT *, sum(CASE WHEN value < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY event_id) AS island FROM log) SELECT event_type, event_id, CAST(sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, island ORDER BY event_id) AS BIGINT) AS streak FROM i")
def old_streak(spark, sf_dir):
    return coverage.streaks(round_log(spark, sf_dir), "event_type", "event_id", F.col("value") < 50).select("event_type", "event_id", "streak")


@query(ROUNDS + ", i AS (SELECT *, sum(CASE WHEN new = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY round) AS island FROM rounds) SELECT event_type, round, CAST(sum(CASE WHEN new = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, island ORDER BY round) AS BIGINT) AS streak FROM i")
def stale_rounds(spark, sf_dir):
    per_round = coverage.rounds(round_log(spark, sf_dir), "event_type", "user_id", "event_id", "round")
    return coverage.streaks(per_round, "event_type", "round", F.col("new") == 0).select("event_type", "round", "streak")


@query(LOG + ", s AS (SELECT event_type, count(DISTINCT user_id) AS links, max(user_id) AS reported, min(value) < 1 AS boundary FROM log GROUP BY event_type) SELECT event_type, CASE WHEN reported > 0 AND links >= reported THEN 'complete_public' WHEN boundary THEN 'period_complete_public' ELSE 'partial' END AS state FROM s")
def coverage_state(spark, sf_dir):
    s = round_log(spark, sf_dir).groupBy("event_type").agg(F.countDistinct("user_id").alias("links"), F.max("user_id").alias("reported"), (F.min("value") < 1).alias("boundary"))
    return s.select("event_type", coverage.state(F.col("links"), F.col("reported"), F.col("boundary")).alias("state"))


from . import more_queries, run_queries  # noqa: E402, F401  register their queries here
