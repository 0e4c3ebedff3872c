"""Queries of readers, runs, reports and coverage over the synthetic tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import dates, text
from .operators import analytics, coverage, rules, store, translate
from .plans import collect, report
from .queries import CATEGORIES, CATEGORY_OF, FIRST, JUDGED, KEYWORDS, LAST, LOG, POSTS, TOPICS_CTE, W, _sql_clean, analysed_posts, posts, query, round_log
from .sources import cards, feeds, pages, payloads, values

ROOT = "https://example.org/g/1"
ORDER = [c for c, _ in CATEGORIES]
NAT = rules.NATURAL


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _list(xs):
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


# text
@query(f"SELECT doc_id, contains(replace(lower({_sql_clean('text')}), '：', ':'), 'benefit:') OR contains(lower({_sql_clean('text')}), 'the th') AS relevant FROM documents")
def relevance(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.is_relevant(F.col("text"), ["Benefit：", "THE TH"]).alias("relevant"))


@query(f"SELECT doc_id, doc_id % 9 = 0 OR doc_id % 7 = 0 OR ({' OR '.join(f'''contains(lower({_sql_clean('text')} || ' ' || coalesce(source, '')), '{m}')''' for m in ('src1', 'tion the'))}) AS campaign FROM documents")
def campaign(spark, sf_dir):
    section = F.when(F.col("doc_id") % 9 == 0, values.EVENT_SECTIONS[0]).otherwise("")
    author = F.concat(F.coalesce("source", F.lit("")), F.when(F.col("doc_id") % 7 == 0, values.CAMPAIGN_AUTHORS[0]).otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", text.is_campaign(F.col("text"), section, author, values.EVENT_SECTIONS, values.CAMPAIGN_AUTHORS, ["src1", "tion the"]).alias("campaign"))


@query(f"SELECT doc_id, contains({_sql_clean('text')}, 'ing') AND (len(list_filter(regexp_split_to_array({_sql_clean('text')}, '[,，、|｜/；;]'), lambda x: trim(x) <> '')) >= 3 OR NOT starts_with(lower({_sql_clean('text')}), 'the')) AS roundup FROM documents WHERE text IS NOT NULL")
def roundup(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.is_roundup(F.col("text"), ["ing"], ["The"]).alias("roundup"))


@query("SELECT doc_id, contains(source, '1') OR contains(source, 'C9') AS official FROM documents")
def official_poster(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.has_any(F.col("source"), ["1", "C9"]).alias("official"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR lang = 'en' THEN '' ELSE lang END AS about FROM documents")
def placeholder(spark, sf_dir):
    said = F.when(F.col("doc_id") % 4 == 0, F.lit(values.PLACEHOLDERS[3])).otherwise(F.col("lang"))
    return read(spark, sf_dir, "documents").select("doc_id", text.without_placeholder(said, [*values.PLACEHOLDERS, "en"]).alias("about")).na.fill("")


@query(f"SELECT doc_id, {_sql_clean('text')} AS stripped FROM documents")
def strip_html(spark, sf_dir):
    """Every text between tags comes back as it was."""
    marked = F.concat(F.lit("<div class='a>b'><p>"), F.replace("text", F.lit("\n"), F.lit("<br>\n")), F.lit("</p><!-- no --></div>"))
    return read(spark, sf_dir, "documents").select("doc_id", text.strip_html(F.coalesce(marked, F.lit(""))).alias("stripped"))


@query(f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN '{ROOT}?subc=' || page_id WHEN 1 THEN '{ROOT}' ELSE '' END AS url FROM pages")
def entry_urls(spark, sf_dir):
    n, k = F.col("page_id"), F.col("page_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("//example.org/g/1/?a=b&subc="), n, F.lit("&c=d#e"))).when(k == 1, F.lit("1?x=y")).when(k == 2, F.concat(F.lit(f"{ROOT}/post/"), n)).otherwise("https://example.com/g/1")
    return read(spark, sf_dir, "pages").select("page_id", text.entry_url(raw, ROOT).alias("url"))


@query("SELECT page_id, 'https://example.org/a/' || CASE page_id % 4 WHEN 0 THEN 'c/x' || page_id WHEN 1 THEN 'b?q=' || page_id WHEN 2 THEN 'x' || page_id ELSE 'b#f' END AS url FROM pages")
def absolute_url(spark, sf_dir):
    n, k = F.col("page_id"), F.col("page_id") % 4
    href = F.when(k == 0, F.concat(F.lit("./c/x"), n)).when(k == 1, F.concat(F.lit("?q="), n)).when(k == 2, F.concat(F.lit("d/../x"), n)).otherwise("#f")
    return read(spark, sf_dir, "pages").select("page_id", text.absolute_url(F.lit("https://example.org/a/b"), href).alias("url"))


@query(f"WITH c AS (SELECT doc_id, {_sql_clean('CASE WHEN doc_id % 3 = 0 THEN text ELSE lang END')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 68 THEN t ELSE rtrim(t[:67]) || '…' END AS label, lower(regexp_replace(t, '[^\\pL\\pN\\pM_]+', '', 'g')) AS title_key FROM c")
def post_label(spark, sf_dir):
    title = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    cleaned = text.clean(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.col("lang")))
    return docs.select("doc_id", text.post_label(F.lit(" "), title, F.lit(None), F.when(F.col("doc_id") % 3 == 0, F.col("text"))).alias("label"), text.title_key(cleaned).alias("title_key"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def date_formats(spark, sf_dir):
    forms = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd", "MM/dd/yyyy"]
    shown = F.lit("no date")
    for k, f in enumerate(forms):
        shown = F.when(F.col("o_orderkey") % 9 == k, F.date_format(F.col("o_orderdate").cast("timestamp"), f)).otherwise(shown)
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.date_of(shown).alias("day"))


@query(f"SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS today, greatest(least(DATE '{FIRST}', CAST(CAST(ts AS DATE) - INTERVAL 14 DAY AS DATE)), CAST(CAST(ts AS DATE) - INTERVAL 30 DAY AS DATE)) AS scan_start FROM events")
def run_dates(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", dates.today(F.col("ts").cast("timestamp")).alias("today"), dates.scan_start(F.lit(FIRST).cast("date"), F.col("ts").cast("date")).alias("scan_start"))


# feeds
FEED = f"""WITH t AS (SELECT doc_id, source, left({_sql_clean('text')}, 200) AS c FROM documents WHERE doc_id % 50 <> 49),
f AS (SELECT doc_id, CASE WHEN trim(c) <> '' AND doc_id % 10 <> 3 THEN trim(c) WHEN doc_id % 20 = 3 THEN 'abstract' ELSE '{values.ONLY_IMAGES}' END AS x, 'user' || source || CASE WHEN doc_id % 11 = 0 THEN '{values.OFFICIAL_MARKERS[0]}' ELSE '' END AS author FROM t)
SELECT 'id' || doc_id AS post_key, '{ROOT}/post/id' || doc_id || '?subc=c' || doc_id % 3 AS url, x AS original_text, CASE WHEN length(x) <= 72 THEN x ELSE rtrim(x[:71]) || '…' END AS title,
  CAST(CAST(epoch_ms(1704067200000 + doc_id * 3600000) + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS published_at, author, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 7 * 10000 END AS views, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 5 END AS comments,
  doc_id % 11 = 0 OR doc_id % 13 = 0 AS is_official, false AS is_campaign, x = '{values.ONLY_IMAGES}' OR length(regexp_replace(regexp_replace(x, '#\\S+', '', 'g'), '[^\\pL\\pN\\pM]', '', 'g')) < 2 AS is_low_signal FROM f"""


def feed_payloads(spark, sf_dir):
    """Documents as feed items, twenty a payload, nested three levels deep; each payload comes twice."""
    n = F.col("doc_id")
    body = F.substring(text.clean(F.col("text")), 1, 200)
    nested = F.when(n % 10 != 3, F.struct(F.array(F.struct(F.struct(body.alias("text")).alias("text_content"))).alias("contents")))
    item = F.struct(
        F.when(n % 50 != 49, F.concat(F.lit("id"), n)).alias("id"), nested.alias("contents"), F.struct(F.when(n % 10 != 3, F.substring(body, 1, 30)).alias("text")).alias("title"),
        F.when(n % 20 == 3, "abstract").alias("feed_abstract"), F.array(F.lit("i")).alias("images"), F.struct(F.struct(F.concat(F.lit("c"), n % 3).alias("channel_id")).alias("sign")).alias("channelInfo"),
        F.struct(F.concat(F.lit("user"), F.col("source"), F.when(n % 11 == 0, values.OFFICIAL_MARKERS[0]).otherwise("")).alias("nick"), F.struct(F.when(n % 13 == 0, F.lit(f" {values.OFFICIAL_MARKERS[1]} ")).otherwise("").alias("x"), F.lit(7).alias("y")).alias("manage_tag")).alias("poster"),
        (F.lit(1704067200) + n * 3600).alias("createTime"), F.struct(F.concat(n % 7, F.when(n % 7 == 0, "x").otherwise("万")).alias("v")).alias("z"), F.struct(F.when(n % 7 != 0, F.concat(n % 7, F.lit("万"))).alias("viewCount")).alias("visitorInfo"), (n % 5).alias("commentCount"),
    )
    each = read(spark, sf_dir, "documents").groupBy(F.floor(n / 20).alias("seq")).agg(F.sort_array(F.collect_list(F.struct(n.alias("n"), item.alias("item")))).alias("items"))
    payload = F.to_json(F.struct(F.array(F.struct(F.struct(F.transform("items", lambda x: x["item"]).alias("vecFeed"), F.lit("a").alias("feedAttchInfo"), F.lit(True).alias("isFinish")).alias("data"))).alias("pages")))
    once = each.select("seq", payload.alias("payload"), F.lit("s").alias("section"), F.lit("").alias("channel_id"))
    return once.unionByName(once.withColumn("seq", F.col("seq") + 1_000_000))


@query(FEED)
def feed_posts(spark, sf_dir):
    p = feeds.payload_posts(feed_payloads(spark, sf_dir), ROOT)
    return p.select("post_key", "url", "original_text", "title", "published_at", "author", "views", "comments", "is_official", "is_campaign", "is_low_signal")


@query("SELECT CAST(doc_id // 20 AS BIGINT) AS payload, count(*) AS items, 'a' AS attach, true AS finished FROM documents GROUP BY ALL")
def feed_batches(spark, sf_dir):
    p = feed_payloads(spark, sf_dir).filter("seq < 1000000").select(F.col("seq").alias("payload"), F.explode(feeds.batches(F.col("payload"))).alias("b"))
    return p.select("payload", F.size("b.items").cast("long").alias("items"), "b.attach", "b.finished")


@query(f"""WITH s AS (SELECT r_regionkey AS run, n_name AS section, CAST(100 + n_nationkey AS VARCHAR) AS channel_id FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0),
d AS (SELECT *, 'page_payload' AS discovery FROM s UNION ALL SELECT r_regionkey, 'hidden', '9' || r_regionkey, 'page_payload' FROM region),
f AS (SELECT r_regionkey AS run, section, channel_id FROM region, (VALUES ('hot', 'main'), ('7', 'ALGERIA'), ('8', 'CHINA'), ('5', '{values.EVENT_SECTIONS[0]}')) v(channel_id, section)),
a AS (SELECT * FROM d UNION ALL SELECT run, section, channel_id, 'fallback' FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.run = f.run AND d.section = f.section))
SELECT CAST(run AS BIGINT) AS run, section, channel_id, discovery, CASE section WHEN 'main' THEN 0 WHEN 'hidden' THEN 1 WHEN 'CHINA' THEN 2 ELSE 3 END AS priority, section IN ({_list(values.EVENT_SECTIONS)}) AS excluded_section, '{ROOT}?subc=' || channel_id AS url FROM a""")
def board_routes(spark, sf_dir):
    """A flattened payload a region names its nations as boards; a smaller one repeats them with other numbers."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("run"), "n_nationkey", "n_name")
    tabs = lambda plus: F.sort_array(F.collect_list(F.struct(F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") + plus).cast("string").alias("channel_id"), F.concat(F.lit(" "), "n_name").alias("name"))))
    grouped = nation.groupBy("run").agg(tabs(100).alias("a"), tabs(500).alias("b"))
    doc = lambda hidden, t, pad: F.to_json(F.struct(F.struct(F.struct(hidden.alias("hiddenChannelId"), F.col(t).alias("tabInfoList")).alias("commonGuildStore"), F.lit(pad).alias("pad")).alias("pinia")))
    first = grouped.select("run", doc(F.concat(F.lit("9"), "run"), "a", "x" * 50).alias("payload"))
    more = grouped.select("run", doc(F.lit("hot"), "b", "").alias("payload"))
    fallback = spark.createDataFrame([("hot", "main"), ("7", "ALGERIA"), ("8", "CHINA"), ("5", values.EVENT_SECTIONS[0])], "channel_id string, section string")
    return feeds.board_routes(first.unionByName(more), fallback, ROOT, "hidden", "main", "CHINA")


# cards
def _cards(spark, sf_dir):
    docs, n = read(spark, sf_dir, "documents"), F.col("doc_id")
    url = F.concat(F.lit(f"{ROOT}/"), F.when(n % 10 == 9, "no").otherwise("post"), F.lit("/p"), n, F.lit("?x=1#y"))
    cards_ = docs.select(n.alias("seq"), url.alias("url"), F.when(n % 3 == 0, F.col("source")).alias("author"), F.when(n % 4 != 0, F.substring("text", 1, 50)).alias("text"), F.concat(n % 6, F.lit("千")).alias("comments"), (n % 8 == 0).alias("is_official"))
    item = F.struct(F.concat(F.lit(f"{ROOT}/post/p"), n).alias("url"), F.lit("head").alias("headline"), F.when(n % 5 != 0, F.substring("text", 1, 40)).alias("description"), F.when(n % 2 == 0, F.lit("2024-01-01T20:00:00Z")).alias("datePublished"), F.struct(F.lit("by").alias("name")).alias("author"))
    lists = docs.groupBy(F.floor(n / 10).alias("seq")).agg(F.sort_array(F.collect_list(F.struct(n.alias("n"), F.struct(item.alias("item")).alias("e")))).alias("x"))
    lists = lists.select("seq", F.to_json(F.struct(F.array(F.struct(F.lit("sec").alias("name"), F.transform("x", lambda e: e["e"]).alias("itemListElement"))).alias("@graph"))).alias("payload"))
    return docs, cards_, payloads.list_metadata(lists)


_META = f"""m AS (SELECT doc_id, 'head' AS headline, coalesce({_sql_clean("CASE WHEN doc_id % 5 <> 0 THEN left(text, 40) END")}, '') AS description, CASE WHEN doc_id % 2 = 0 THEN '2024-01-02' ELSE '' END AS published_at, 'by' AS author, 'sec' AS section FROM documents)"""
_CARD = f"""{_META}, k AS (SELECT doc_id, doc_id % 8 = 0 AS o, doc_id % 6 * 1000 AS comments, m.*, CASE WHEN doc_id % 3 = 0 AND coalesce(source, '') <> '' THEN source ELSE 'by' END AS who,
  CASE WHEN doc_id % 4 <> 0 AND coalesce({_sql_clean('left(text, 50)')}, '') <> '' THEN {_sql_clean('left(text, 50)')} WHEN description <> '' THEN description ELSE headline END AS x FROM documents JOIN m USING (doc_id) WHERE doc_id % 10 <> 9)"""


@query(f"WITH {_META} SELECT 'p' || doc_id AS post_key, '{ROOT}/post/p' || doc_id AS url, headline, description, published_at, author, section FROM m")
def list_metadata(spark, sf_dir):
    return _cards(spark, sf_dir)[2]


@query(f"WITH {_CARD} SELECT doc_id AS seq, 'p' || doc_id AS post_key, '{ROOT}/post/p' || doc_id AS url, x AS original_text, nullif(published_at, '') AS published_at, who AS author, comments, section AS source_section, o AS is_official, CASE WHEN published_at = '' THEN '{values.UNKNOWN}' ELSE '{values.DATED_BY['card']}' END AS published_at_source FROM k")
def card_posts(spark, sf_dir):
    _, cards_, meta = _cards(spark, sf_dir)
    return cards.card_posts(cards_, meta).select("seq", "post_key", "url", "original_text", "published_at", "author", "comments", "source_section", "is_official", "published_at_source")


@query(f"""WITH {_CARD}, d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '' ELSE coalesce({_sql_clean('left(text, 60)')}, '') END AS dd, CASE WHEN doc_id % 4 = 1 THEN 'who' ELSE '' END AS dw, CASE WHEN doc_id % 3 = 1 THEN '2024-01-09' ELSE '' END AS dp FROM documents WHERE doc_id % 7 <> 0),
j AS (SELECT *, CASE WHEN dd <> '' THEN dd ELSE 'detail' END AS own, CASE WHEN doc_id % 4 <> 0 AND coalesce(x0, '') <> '' THEN x0 WHEN dd <> '' THEN dd WHEN description <> '' THEN description ELSE 'detail' END AS base FROM (SELECT k.*, {_sql_clean('left(text, 50)')} AS x0 FROM k JOIN documents USING (doc_id)) JOIN d USING (doc_id))
SELECT doc_id AS seq, CASE WHEN length(own) >= length(base) THEN own ELSE base END AS original_text, CASE WHEN dw <> '' THEN dw ELSE who END AS author, CASE WHEN dp <> '' THEN dp ELSE nullif(published_at, '') END AS published_at, 'new' AS source_section FROM j""")
def detail_posts(spark, sf_dir):
    docs, cards_, meta = _cards(spark, sf_dir)
    n = F.col("doc_id")
    details = docs.filter(n % 7 != 0).select(
        F.concat(F.lit("p"), n).alias("post_key"), F.lit("").alias("url"), F.lit("detail").alias("headline"), F.when(n % 6 == 0, "").otherwise(F.substring("text", 1, 60)).alias("description"),
        F.when(n % 3 == 1, "2024-01-09").otherwise("").alias("published_at"), F.when(n % 4 == 1, "who").otherwise("").alias("author"), F.lit("new").alias("section"),
    )
    return cards.detail_posts(cards_, meta, details).select("seq", "original_text", "author", "published_at", "source_section")


@query(f"""WITH v AS (SELECT min(doc_id) AS seq, doc_id // 2 AS id FROM documents GROUP BY ALL), p AS (SELECT v.id, v.seq, 'the ' || left({_sql_clean('text')}, 40) AS t, CASE WHEN id % 3 = 0 THEN '' ELSE 'about ' || id END AS a FROM v JOIN documents ON doc_id = seq)
SELECT seq, trim(t) AS title, CASE WHEN a <> '' THEN a ELSE trim(t) END AS original_text, 'https://video.example/video/BV' || id AS url, '2024-01-01' AS published_at, CASE WHEN id % 2 = 0 THEN 'owner' ELSE 'found' END AS author, CASE WHEN id % 2 = 0 THEN id + 1 ELSE 5 END AS views FROM p""")
def video_posts(spark, sf_dir):
    n = F.col("doc_id")
    id_ = F.floor(n / 2).cast("long")
    docs = read(spark, sf_dir, "documents")
    title = F.concat(F.lit("<em>the</em> "), F.substring(text.clean(F.col("text")), 1, 40))
    found = docs.select(
        n.alias("seq"), F.when(id_ % 2 == 0, F.concat(F.lit("BV"), id_)).alias("video_id"), F.concat(F.lit("http://v/video/BV"), id_).alias("address"), title.alias("title"), F.when(id_ % 3 == 0, "-").otherwise(F.concat(F.lit("about "), id_)).alias("description"),
        F.lit(0).cast("long").alias("published"), F.lit(1704067200).cast("long").alias("sent"), F.lit("5").alias("plays"), F.lit(None).cast("long").alias("reviews"), F.lit(None).cast("long").alias("video_reviews"), F.lit("found").alias("author"),
    )
    details = docs.filter(n % 4 == 0).select(F.concat(F.lit("BV"), id_).alias("video_id"), F.lit("").alias("title"), F.lit("").alias("description"), F.lit(None).cast("long").alias("published"), (id_ + 1).alias("views"), F.lit(0).cast("long").alias("replies"), F.lit("owner").alias("owner"))
    return cards.video_posts(found, details, ["THE"], "https://video.example").select("seq", "title", "original_text", "url", "published_at", "author", "views")


@query(f"WITH {POSTS} SELECT seq, published_at AS listed_at FROM posts WHERE published_at IS NULL OR published_at BETWEEN DATE '{FIRST}' - INTERVAL 1 DAY AND DATE '{LAST}' + INTERVAL 1 DAY")
def listing_to_read(spark, sf_dir):
    links = posts(spark, sf_dir).select("seq", F.col("published_at").alias("listed_at"))
    return cards.listing_to_read(links, F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"))


# pages
@query(f"SELECT doc_id AS seq, {_sql_clean('left(text, 80)')} AS description, 'h' || doc_id AS headline, '2024-01-02' AS published_at FROM documents WHERE doc_id % 4 <> 3")
def page_postings(spark, sf_dir):
    """The first posting of each page, whatever its place: alone, in a list, in a graph of a graph; a quarter has none."""
    n = F.col("doc_id")
    node = F.struct(F.when(n % 4 == 3, F.array(F.lit("Other"))).otherwise(F.array(F.lit("Thing"), F.lit("SocialMediaPosting"))).alias("@type"), F.concat(F.lit("h"), n).alias("headline"), F.substring(F.replace("text", F.lit("<"), F.lit(" ")), 1, 80).alias("text"), F.lit("2024-01-01T20:00:00+00:00").alias("datePublished"))
    graph = F.to_json(F.struct(F.array(F.struct(F.array(node).alias("@graph"))).alias("@graph")))
    script = F.when(n % 4 == 0, F.to_json(node)).when(n % 4 == 1, F.to_json(F.array(node))).otherwise(graph)
    html = F.concat(F.lit('<html><head><script type="application/ld+json">no json</script><script type="application/ld+json">'), script, F.lit("</script></head><body>x</body></html>"))
    return pages.page_postings(read(spark, sf_dir, "documents").select(n.alias("seq"), html.alias("html"))).select("seq", "description", "headline", "published_at")


@query("""SELECT doc_id AS seq, nearest, 'Title ' || doc_id AS title, 'first line of ' || doc_id || ' second line' AS original_text, CASE WHEN doc_id % 3 = 0 THEN '2024-03-01' WHEN doc_id % 3 = 1 THEN '2024-01-04' ELSE '2023-12-30' END AS published_at,
  CASE WHEN doc_id % 3 = 0 THEN 'news' WHEN nearest = 'writer' THEN 'writer' || doc_id WHEN doc_id % 3 = 1 THEN '06:40' ELSE '12-30' END AS author, CAST(doc_id % 100 * 1000 AS BIGINT) AS views
FROM documents CROSS JOIN (VALUES ('writer'), ('time')) AS layouts(nearest)""")
def list_pages(spark, sf_dir):
    """Pages of the line-oriented kind, made of documents' numbers: a third with JSON-LD, a third with a date in the meta line. The
    nearest line before the meta line that isn't excluded counts as the author, be it a time or a date: each document has a page
    where the writer is nearest and one where a time or a date is."""
    n, nearest = F.col("doc_id"), F.col("nearest")
    news = F.when(n % 3 == 0, F.lit('<script type="application/ld+json">[{"@type":"NewsArticle","datePublished":"2024-03-01T23:00:00Z","author":{"name":"news"}}]</script>')).otherwise("")
    meta = F.concat(F.when(n % 3 == 1, F.lit("昨天 ")).otherwise(""), n % 100, F.lit("千 "), F.lit(values.SEEN))
    time, writer = F.when(n % 3 == 2, "<p>12-30</p>").otherwise("<p>06:40</p>"), F.concat(F.lit("<p>writer"), n, F.lit("</p>"))
    before = F.when(nearest == "writer", F.concat(time, writer)).otherwise(F.concat(writer, time))
    html = F.concat(
        F.lit("<html><head><title>t</title>"), news, F.lit("</head><body><h1>Title "), n, F.lit(" - tail</h1><p>menu</p>"), before, F.lit(f"<p>{values.FOLLOW}</p><p>"), meta, F.lit(f"</p><p>{values.FOLLOW}</p><p>first  line of "), n,
        F.lit("</p><p>second line</p><p>"), F.when(n % 2 == 0, F.lit("17")).otherwise(values.STOP_LINES[0]), F.lit("</p><p>never</p></body></html>"),
    )
    docs = read(spark, sf_dir, "documents").select(n, F.explode(F.array(F.lit("writer"), F.lit("time"))).alias("nearest"))
    rows = docs.select(F.struct(n.alias("seq"), nearest).alias("seq"), html.alias("html"), F.lit("https://a.example/moment/1?x").alias("url"), F.lit("fallback").alias("fallback_title"))
    p = pages.list_posts(rows, F.lit("2024-01-05").cast("date"), title_tail="- tail")
    return p.select("seq.seq", "seq.nearest", "title", "original_text", "published_at", "author", "views")


@query("SELECT doc_id AS seq, CASE WHEN doc_id % 4 = 0 THEN 'T' || doc_id ELSE 'page' END AS title, CASE WHEN doc_id % 2 = 0 THEN 'body ' || doc_id || ' more' ELSE 'summary' END AS original_text, CASE WHEN doc_id % 3 = 0 THEN 'https://a.example/s' ELSE 'https://b.example/f' || doc_id END AS url, CASE WHEN doc_id % 5 = 0 THEN '2024-01-01' ELSE '2023-06-01' END AS published_at FROM documents")
def article_pages(spark, sf_dir):
    n = F.col("doc_id")
    html = F.concat(
        F.lit("<html><head><title>page</title><script>"), F.when(n % 3 == 0, 'var msg_link = "https://a.example/s?a=b&amp;amp;c";').otherwise(""), F.when(n % 5 == 0, 'var ct = "1704067200";').otherwise(""), F.lit("</script></head><body>"),
        F.when(n % 4 == 0, F.concat(F.lit('<h2 id="activity-name"> T'), n, F.lit(" </h2>"))).otherwise(""), F.when(n % 2 == 0, F.concat(F.lit('<div id="js_content"><p>body</p> <b>'), n, F.lit("</b><p>more</p></div>"))).otherwise(""), F.lit("<p>z</p></body></html>"),
    )
    rows = read(spark, sf_dir, "documents").select(n.alias("seq"), html.alias("html"), F.concat(F.lit("https://b.example/f"), n, F.lit("?t")).alias("url"), F.lit("f").alias("fallback_title"), F.lit("summary").alias("summary"), F.lit("2023-06-01").alias("fallback_date"), F.lit("a").alias("account"))
    return pages.article_posts(rows).select("seq", "title", "original_text", "url", "published_at")


@query("SELECT doc_id AS seq, 'Title ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'text ' || doc_id ELSE 'Title ' || doc_id END AS original_text, 'who' AS author, CASE WHEN doc_id = 0 THEN 0 ELSE doc_id END AS comments, '2024-01-03' AS published_at FROM documents")
def forum_pages(spark, sf_dir):
    n = F.col("doc_id")
    html = F.concat(
        F.lit('<body><h3 class="core_title_txt x">Title '), n, F.lit('</h3><ul><li class="l_reply_num">'), n, F.lit(' replies</li></ul><div class="l_post"><a class="d_name">who</a>'),
        F.when(n % 2 == 0, F.concat(F.lit('<div class="d_post_content j">text '), n, F.lit("</div>"))).otherwise(""), F.lit('<span title="2024-01-03 10:00">now</span></div></body>'),
    )
    rows = read(spark, sf_dir, "documents").select(n.alias("seq"), html.alias("html"), F.lit("https://f.example/p").alias("url"), F.lit("f").alias("fallback_title"))
    return pages.forum_posts(rows, F.lit("2024-01-05").cast("date")).select("seq", "title", "original_text", "author", "comments", "published_at")


@query(FEED)
def page_script_posts(spark, sf_dir):
    """The feed payloads as JSON scripts of pages."""
    p = feed_payloads(spark, sf_dir).withColumn("html", F.concat(F.lit('<html><script type="application/json">'), F.replace("payload", F.lit("</"), F.lit("<\\/")), F.lit("</script><script>var x;</script></html>")))
    out = feeds.payload_posts(pages.script_payloads(p), ROOT)
    return out.select("post_key", "url", "original_text", "title", "published_at", "author", "views", "comments", "is_official", "is_campaign", "is_low_signal")


# runs
WANTED = ["src1", "src2", "src3", "src4", "unseen", "unknown"]
KNOWN = ["src1", "src2", "src3", "src4", "src5", "unseen"]
_RUN = f"""{JUDGED.replace("FROM posts) ", "FROM (SELECT seq, source, title, original_text, 'k' || seq AS post_key, url, published_at, CASE WHEN seq % 4 = 0 THEN greatest(views, 77) ELSE views END AS views, comments, is_low_signal, is_campaign, is_official FROM posts WHERE source IN ('src1', 'src2', 'src3', 'src4'))) ")}"""
_COUNTS = f""", st AS (SELECT source, count(*) AS candidate_count, count(*) FILTER (reason = 'valid') AS count, count(*) FILTER (seq % 5 = 0) AS new_candidate_count, {", ".join(f"count(*) FILTER (reason = '{r}') AS excluded_{r}" for r in ("unknown_date", "out_of_range", "campaign", "low_signal", "invalid"))} FROM judged GROUP BY source),
pr AS (SELECT p.source, count(*) FILTER (p.seq % 5 <> 0) AS cache_before_count, count(*) FILTER (p.seq % 5 <> 0 AND p.published_at BETWEEN DATE '{FIRST}' AND DATE '{LAST}') AS cached_period_before, count(*) FILTER (p.seq % 5 = 0 OR p.seq % 4 = 0) AS live_candidate_count, count(*) FILTER (p.seq % 5 <> 0 AND p.seq % 4 = 0 AND (views IS NULL OR views < 77)) AS updated_candidate_count FROM posts p GROUP BY p.source),
ss AS (SELECT * FROM (VALUES ('src1'), ('src2'), ('src3'), ('src4'), ('unseen')) v(source)),
status AS (SELECT ss.source, coalesce(count, 0) AS count, coalesce(candidate_count, 0) AS candidate_count, coalesce(new_candidate_count, 0) AS new_candidate_count, coalesce(updated_candidate_count, 0) AS updated_candidate_count, coalesce(cache_before_count, 0) AS cache_before_count, coalesce(cached_period_before, 0) AS cached_period_before, coalesce(live_candidate_count, 0) AS live_candidate_count,
  coalesce(excluded_unknown_date, 0) AS excluded_unknown_date, coalesce(excluded_out_of_range, 0) AS excluded_out_of_range, coalesce(excluded_campaign, 0) AS excluded_campaign, coalesce(excluded_low_signal, 0) AS excluded_low_signal, coalesce(excluded_invalid, 0) AS excluded_invalid,
  CASE WHEN ss.source IN ('src3', 'unseen') THEN CASE WHEN coalesce(count, 0) > 0 THEN 'warning' ELSE 'blocked' END WHEN count > 0 THEN 'success' ELSE 'warning' END AS state,
  CASE WHEN ss.source IN ('src3', 'unseen') THEN CASE WHEN coalesce(count, 0) > 0 THEN 'no answer{collect.KEPT}' || format('{{:,}}', count) || '{collect.CHECKED}' ELSE 'no answer' END WHEN count > 0 THEN '{collect.DONE}' WHEN candidate_count > 0 THEN '{collect.NONE_LEFT}' ELSE '{collect.NOTHING}' END AS message FROM ss LEFT JOIN st USING (source) LEFT JOIN pr USING (source))"""


def collected(spark, sf_dir, most=None):
    """Four fifths of the posts are in the store; the others, and a quarter again with more views, come in now. Two readers fail."""
    p = posts(spark, sf_dir).withColumn("post_key", F.concat(F.lit("k"), "seq"))
    known = p.filter("seq % 5 <> 0")
    live = p.filter("seq % 5 = 0 or seq % 4 = 0").withColumn("views", F.when(F.col("seq") % 4 == 0, F.greatest("views", F.lit(77))).otherwise(F.col("views")))
    sources = collect.selected(spark, WANTED, dict.fromkeys(KNOWN))
    failures = spark.createDataFrame([("src3", "blocked", "no answer"), ("unseen", "blocked", "no answer")], "source string, failed string, reason string")
    return collect.run(sources, known, live, failures, F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"), most)


@query("SELECT source, CAST(place AS INT) AS place FROM (VALUES ('src1', 0), ('src2', 1), ('src3', 2), ('src4', 3), ('unseen', 4)) v(source, place)")
def selected_sources(spark, sf_dir):
    return collect.selected(spark, WANTED, dict.fromkeys(KNOWN))


@query(_RUN + _COUNTS + f", t AS (SELECT sum(count) AS total FROM status), chosen AS (SELECT source, count(*) AS n FROM (SELECT source FROM judged WHERE reason = 'valid' ORDER BY published_at DESC, source DESC, post_key DESC LIMIT 40) GROUP BY source) SELECT s.*, s.count > 0 AS ok, CAST(total AS BIGINT) AS total_valid_unique, total > 40 AS result_limit_reached, coalesce(n, 0) AS selected_count FROM status s CROSS JOIN t LEFT JOIN chosen USING (source)")
def collect_status(spark, sf_dir):
    return collected(spark, sf_dir, 40).status.drop("excluded_samples", "excluded_irrelevant", "cumulative_candidate_count")


@query(_RUN + "SELECT post_key, published_at, source, views, CAST(row_number() OVER (ORDER BY published_at DESC, source DESC, post_key DESC) AS INT) AS place FROM judged WHERE reason = 'valid' ORDER BY place LIMIT 40")
def collect_result(spark, sf_dir):
    rows = collected(spark, sf_dir, 40).posts.select("post_key", "published_at", "source", "views")
    return rows.withColumn("place", F.row_number().over(analytics.Window.orderBy(F.desc("published_at"), F.desc("source"), F.desc("post_key"))))  # the 40 picked


@query(_RUN + f", r AS (SELECT source, CASE reason WHEN 'campaign' THEN '{values.EXCLUDED_NAMES['campaign']}' ELSE '{values.EXCLUDED_NAMES['low_signal']}' END AS reason, published_at AS date, title, row_number() OVER (PARTITION BY source ORDER BY post_key) AS k FROM judged WHERE reason IN ('campaign', 'low_signal')) SELECT source, reason, date, title FROM r WHERE k <= 20")
def collect_samples(spark, sf_dir):
    return collected(spark, sf_dir).status.select("source", F.explode("excluded_samples").alias("x")).select("source", "x.reason", "x.date", "x.title")


@query(_RUN + _COUNTS + "SELECT CAST(sum(excluded_unknown_date) AS BIGINT) AS excluded_unknown_date, CAST(sum(excluded_out_of_range) AS BIGINT) AS excluded_out_of_range, CAST(0 AS BIGINT) AS excluded_irrelevant, CAST(sum(excluded_invalid) AS BIGINT) AS excluded_invalid, CAST(sum(excluded_campaign) AS BIGINT) AS excluded_campaign, CAST(sum(excluded_low_signal) AS BIGINT) AS excluded_low_signal, CAST(sum(candidate_count) AS BIGINT) AS candidate_count FROM status")
def page_totals(spark, sf_dir):
    return collect.page_totals(collected(spark, sf_dir).status)


@query(_RUN + _COUNTS + "SELECT source, message FROM status WHERE state <> 'success' OR count = 0")
def collection_notes(spark, sf_dir):
    return collect.notes(collected(spark, sf_dir).status)


@query(f"WITH {POSTS}, b AS (SELECT 'k' || seq % 100 AS post_key, seq, title, views FROM posts) SELECT post_key, max(views) AS views, arg_max(title, {{'l': length(trim(regexp_replace(title, '\\s+', ' ', 'g'))), 'a': seq % 3, 's': seq}}) AS title, count(*) AS n_seen FROM b GROUP BY post_key")
def combined_batches(spark, sf_dir):
    """Feed, board and fallback posts of one source as one batch, merged by key in this order."""
    p = posts(spark, sf_dir).withColumn("post_key", F.concat(F.lit("k"), F.col("seq") % 100))
    return store.combined([p.filter(F.col("seq") % 3 == k) for k in range(3)]).select("post_key", "views", "title", "n_seen")


@query("SELECT lang, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def distinct_first(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("lang is not null").select("lang", "doc_id", "source")
    return store.distinct_first(docs, "lang", ["doc_id"])


@query(f"WITH {POSTS} SELECT seq, published_at FROM posts WHERE published_at BETWEEN DATE '{FIRST}' AND DATE '{LAST}' OR published_at IS NULL")
def period_posts(spark, sf_dir):
    p = posts(spark, sf_dir).withColumnRenamed("published_at", "date")
    return collect.in_period(p, F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"), keep_unknown=True)[0].select("seq", F.col("date").alias("published_at"))


@query(f"WITH {POSTS} SELECT count(*) FILTER (published_at IS NULL) AS unknown FROM posts")
def period_unknown(spark, sf_dir):
    p = posts(spark, sf_dir).withColumnRenamed("published_at", "date")
    return collect.in_period(p, F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"))[1]


# translation
_TR = f"""WITH {POSTS}, f AS (SELECT seq, trim(title) AS t, contains(title, 'e') AS nt, regexp_replace(original_text, '^\\s+|\\s+$', '', 'g') AS o, contains(original_text, 'e') AS no FROM posts),
g AS (SELECT *, nt AND length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) % 7 = 3 AS ft, no AND length(o) % 7 = 3 AS fo FROM f) """


def _translated(spark, sf_dir):
    p = posts(spark, sf_dir)
    needs = lambda c: c.contains("e")
    parts = translate.parts_of(p, needs, limit=10_000_000)
    cache = parts.select("chunk").distinct().filter(F.length("chunk") % 7 != 3).withColumn("translated", F.replace("chunk", F.lit("e"), F.lit("E")))
    return translate.translated_posts(p, parts, cache, needs)


@query(_TR + f"SELECT seq, CASE WHEN ft THEN '' WHEN nt THEN replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), 'e', 'E') ELSE t END AS title_ko, CASE WHEN fo THEN '{values.TITLE_LABEL}' ELSE '' END <> '' AS body_failed, concat_ws(', ', CASE WHEN ft THEN '{values.TITLE_LABEL}: {values.FAILED}' END, CASE WHEN fo THEN '{values.BODY_LABEL}: {values.FAILED}' END) AS translation_error FROM g")
def translated_posts(spark, sf_dir):
    return _translated(spark, sf_dir).select("seq", "title_ko", F.col("translation_error").contains(values.BODY_LABEL).alias("body_failed"), "translation_error")


@query(_TR + "SELECT count(*) FILTER (ft OR fo) AS failures FROM g")
def translation_failures(spark, sf_dir):
    return collect.translation_failures(_translated(spark, sf_dir))


# analysed posts
_FIRST_FIELD = ", ".join(f"{{'f': CASE WHEN w1_{k} > 0 THEN 0 ELSE 1 END, 'k': {k}, 'n': '{label}'}}" for k, (label, _, _) in enumerate(KEYWORDS))


@query(W + f"SELECT a.seq, a.published_at AS date, a.source, a.category, array_to_string(a.cats, ', ') AS all_categories, a.content_type, CASE a.content_type {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in rules.ROLES.items())} END AS analysis_role, a.eligible AS trend_eligible, a.title, a.views0 AS views, a.engagement, CAST((SELECT count(*) FROM mentioned m WHERE m.seq = a.seq) AS BIGINT) AS n_keywords, CAST(row_number() OVER (ORDER BY a.published_at DESC NULLS LAST, a.engagement DESC, a.views0 DESC, a.seq) AS INT) AS place FROM analysed a")
def analysed_frame(spark, sf_dir):
    """The frame in its order; the place is a check on it and needs the one window over all rows that a global order is."""
    a = analysed_posts(spark, sf_dir)
    assert a.columns[:26] == [f.split()[0] for f in rules.ANALYSED.replace("map<string, int>", "map<>").split(",")]
    order = [F.desc_nulls_last("date"), F.desc("engagement"), F.desc("views"), "seq"]
    a = a.withColumn("place", F.row_number().over(analytics.Window.orderBy(*order)))
    return a.select("seq", "date", "source", "category", "all_categories", "content_type", "analysis_role", "trend_eligible", "title", "views", "engagement", F.size("keyword_labels").cast("long").alias("n_keywords"), "place")


@query("SELECT 1 AS n WHERE false")
def empty_frame(spark, sf_dir):
    return rules.nothing_analysed(spark).select(F.lit(1).alias("n"))


@query(f"SELECT alias FROM (VALUES {', '.join(f'''('{a}')''' for a in rules.registered(CATEGORIES))}) v(alias)")
def registered_aliases(spark, sf_dir):
    return spark.createDataFrame([(a,) for a in rules.registered(CATEGORIES)], "alias string")


@query(W + f", c AS (SELECT category, count(*) AS total FROM analysed GROUP BY category) SELECT category, total, CAST(row_number() OVER (ORDER BY category = '{rules.OTHER}', total DESC, category) AS INT) AS place FROM c")
def category_metrics(spark, sf_dir):
    t = report.category_metrics(analytics.crosstab(analysed_posts(spark, sf_dir), ORDER)).select("category", "total")
    return t.withColumn("place", F.row_number().over(analytics.Window.orderBy(F.col("category") == rules.OTHER, F.desc("total"), "category")))  # a row a category


@query(W + ", k AS (SELECT category, keyword, count(*) AS posts, sum(n) AS mentions FROM mentioned GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY posts DESC, mentions DESC, keyword) AS rank FROM k) SELECT category, string_agg(keyword || ' ' || format('{:,}', posts) || '건', ' · ' ORDER BY rank) AS keywords FROM r WHERE rank <= 5 GROUP BY category")
def keyword_text(spark, sf_dir):
    return report.keyword_text(analysed_posts(spark, sf_dir))


@query(W + f"""SELECT * FROM (SELECT 'comments' AS list, CAST(row_number() OVER (ORDER BY engagement DESC, seq) AS INT) AS rank, seq, engagement AS value FROM analysed WHERE engagement > 0 ORDER BY rank LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'views', CAST(row_number() OVER (ORDER BY views0 DESC, seq) AS INT) AS rank, seq, views0 FROM analysed WHERE views0 > 0 ORDER BY rank LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'videos', CAST(row_number() OVER (ORDER BY views0 DESC, seq) AS INT) AS rank, seq, views0 FROM analysed WHERE views0 > 0 AND content_type = '{rules.GUIDE}' ORDER BY rank LIMIT 5)""")
def popular_posts(spark, sf_dir):
    return report.popular(analysed_posts(spark, sf_dir)).select("list", "rank", "seq", "value")


_LABELLED = """, lab AS (SELECT category, seq, engagement * 3 + views0 AS score, trim(regexp_replace(CASE WHEN trim(title) = '' THEN original_text ELSE title END, '\\s+', ' ', 'g')) AS t FROM analysed),
one AS (SELECT category, CASE WHEN length(t) <= 68 THEN t ELSE rtrim(t[:67]) || '…' END AS label, max(score) AS score, arg_min(seq, {'a': -score, 'b': seq}) AS seq FROM lab GROUP BY ALL)"""


@query(W + _LABELLED + ", r AS (SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, seq) AS INT) AS rank, label FROM one WHERE label <> '') SELECT * FROM r WHERE rank <= 3")
def representative_posts(spark, sf_dir):
    return report.representative(analysed_posts(spark, sf_dir), "category", 3)


_TOPICS = TOPICS_CTE + f""", top AS (SELECT *, row_number() OVER (ORDER BY posts DESC, list_position([{_list(ORDER)}], category), topic) AS nth FROM topics),
tp AS (SELECT m.*, top.topic FROM mentioned m JOIN top ON m.keyword = top.topic AND m.category = top.category WHERE m.content_type = '{NAT}' AND nth <= 8)"""


@query(_TOPICS + ", c AS (SELECT topic, source, count(*) AS n FROM tp GROUP BY topic, source), s AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, source) AS k FROM c) SELECT t.topic, t.category, t.posts, (SELECT string_agg(source || ' (' || format('{:,}', n) || ')', ', ' ORDER BY k) FROM s WHERE s.topic = t.topic AND k <= 3) AS sources FROM top t WHERE nth <= 8")
def topic_summaries(spark, sf_dir):
    return report.topic_summaries(analysed_posts(spark, sf_dir), CATEGORY_OF, ORDER).select("topic", "category", "posts", "sources")


@query(_TOPICS + """, e AS (SELECT topic, seq, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, engagement, views0, published_at FROM tp),
f AS (SELECT *, row_number() OVER (PARTITION BY topic, lower(regexp_replace(title, '[^\\pL\\pN\\pM_]+', '', 'g')) ORDER BY engagement DESC, views0 DESC, published_at DESC NULLS LAST, seq) AS k FROM e WHERE title <> ''),
r AS (SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY engagement DESC, views0 DESC, published_at DESC NULLS LAST, seq) AS INT) AS rank, seq, title FROM f WHERE k = 1) SELECT * FROM r WHERE rank <= 5""")
def topic_examples(spark, sf_dir):
    a = analysed_posts(spark, sf_dir)
    return report.topic_examples(a, report.topics_in_order(a, CATEGORY_OF, ORDER, 8)).select("topic", "rank", "seq", "title")


@query(TOPICS_CTE + " SELECT count(*) AS topics FROM topics")
def repeated_topic_count(spark, sf_dir):
    return report.count_repeated_topics(analysed_posts(spark, sf_dir), CATEGORY_OF)


@query(W + ", t AS (SELECT category, arg_max(title, {'e': engagement, 'v': views0, 's': -seq}) AS t FROM analysed GROUP BY category) SELECT category, left(trim(regexp_replace(t, '\\s+', ' ', 'g')), 100) AS title FROM t")
def representative_title(spark, sf_dir):
    return report.representative_title(analysed_posts(spark, sf_dir), "category")


@query(W + f"SELECT published_at AS \"{values.GRID['date']}\", source AS \"{values.GRID['source']}\", category AS \"{values.GRID['category']}\", content_type AS \"{values.GRID['content_type']}\", views0 AS \"{values.GRID['views']}\", engagement AS \"{values.GRID['engagement']}\", coalesce(url, '') AS \"{values.GRID['url']}\" FROM analysed")
def result_grid(spark, sf_dir):
    return report.grid(analysed_posts(spark, sf_dir)).select(*[f"`{values.GRID[c]}`" for c in ("date", "source", "category", "content_type", "views", "engagement", "url")])


@query(W + "SELECT published_at AS \"﻿date\", source, category, array_to_string(cats, ', ') AS all_categories, title, views0 AS views, coalesce(url, '') AS url FROM analysed")
def export_rows(spark, sf_dir):
    return report.export(analysed_posts(spark, sf_dir)).select("`﻿date`", "source", "category", "all_categories", "title", "views", "url")


@query(W + f"SELECT (SELECT count(*) FROM analysed WHERE eligible) AS says, (SELECT count(*) FROM analysed WHERE NOT eligible) AS supports, (SELECT count(*) FROM analysed WHERE content_type = '{NAT}') AS by_type")
def evidence_sides(spark, sf_dir):
    a = analysed_posts(spark, sf_dir)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    says, supports = report.split_evidence(a)
    by_type = report.split_evidence(a.drop("trend_eligible"))[0]
    return one(says, "says").crossJoin(one(supports, "supports")).crossJoin(one(by_type, "by_type"))  # a row each


# coverage
@query(LOG + ", d AS (SELECT event_type, round, DATE '2024-02-01' - CAST(value AS INT) AS day FROM log) SELECT event_type, count(*) FILTER (day < DATE '2023-12-20') AS old, CAST(min(day) AS DATE) AS oldest FROM d GROUP BY event_type")
def old_posts(spark, sf_dir):
    return coverage.old_posts(_dated(spark, sf_dir), "event_type", "day", F.lit("2023-12-20").cast("date"))


def _dated(spark, sf_dir):
    log = round_log(spark, sf_dir)
    return log.withColumn("day", F.date_sub(F.lit("2024-02-01").cast("date"), F.round("value").cast("int")))


@query(LOG + ", d AS (SELECT event_type, round, min(DATE '2024-02-01' - CAST(value AS INT)) AS day FROM log GROUP BY ALL) SELECT event_type, round, CAST(min(day) OVER (PARTITION BY event_type ORDER BY round) AS DATE) AS oldest FROM d")
def oldest_so_far(spark, sf_dir):
    return coverage.oldest_so_far(_dated(spark, sf_dir), "event_type", "round", "day")


@query(LOG + """, d AS (SELECT event_type, round, event_id, CAST(DATE '2024-02-01' - CAST(value AS INT) AS DATE) AS day, row_number() OVER (PARTITION BY event_type, round ORDER BY event_id DESC) AS k FROM log),
p AS (SELECT event_type, round, count(*) = 3 AND max(day) <= DATE '2024-01-20' AS past FROM d WHERE k <= 3 GROUP BY ALL), i AS (SELECT *, sum(CASE WHEN past THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY round) AS island FROM p),
s AS (SELECT event_type, round, past, CAST(sum(CASE WHEN past THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, island ORDER BY round) AS BIGINT) AS streak FROM i) SELECT *, streak >= 2 AS reached FROM s""")
def tail_boundary(spark, sf_dir):
    return coverage.tail_boundary(_dated(spark, sf_dir), "event_type", "round", "event_id", "day", F.lit("2024-01-20").cast("date"))


@query(LOG + ", s AS (SELECT event_type, count(*) FILTER (value > 80) AS old, CAST(min(DATE '2024-02-01' - CAST(value AS INT)) AS DATE) AS oldest FROM log GROUP BY event_type) SELECT event_type, oldest <= DATE '2023-12-31' AND old >= 12 AS complete, CASE WHEN oldest <= DATE '2023-12-31' AND old >= 12 THEN 'period_boundary_by_old_posts:stable_list' ELSE 'stable_list' END AS stop_reason FROM s")
def board_complete(spark, sf_dir):
    s = _dated(spark, sf_dir).groupBy("event_type").agg(F.count_if(F.col("value") > 80).alias("old"), F.min("day").alias("oldest"))
    complete, why = coverage.board_complete(F.lit("stable_list"), F.col("oldest"), F.col("old"), F.lit("2024-01-01").cast("date"))
    return s.select("event_type", complete.alias("complete"), why.alias("stop_reason"))


@query("SELECT event_type, count(DISTINCT user_id) AS candidate_count, count(*) FILTER (event_id % 3 <> 0) AS detail_verified_count, count(*) FILTER (event_id % 7 = 0) AS detail_failed_count, count(*) FILTER (event_id % 3 = 1) AS request_verified_count, count(*) FILTER (event_id % 3 = 2) AS detail_page_verified_count FROM events GROUP BY event_type")
def scan_counters(spark, sf_dir):
    n = F.col("event_id")
    log = read(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("candidate"), F.when(n % 3 == 1, "request").when(n % 3 == 2, "page").alias("verified_by"), (n % 7 == 0).alias("failed"))
    return coverage.scan_counters(log, "event_type")


@query("""WITH b AS (SELECT n_regionkey AS run, n_name AS section, n_nationkey % 5 = 0 AS complete, n_nationkey AS rounds, n_nationkey * 10 AS candidate_count FROM nation)
SELECT CAST(run AS BIGINT) AS run, CAST(sum(rounds) AS BIGINT) AS collection_rounds, CAST(coalesce(max(CASE WHEN section = 'CHINA' THEN candidate_count END), 0) AS BIGINT) AS main_board_candidate_count, CAST(coalesce(max(CASE WHEN section = 'KENYA' THEN candidate_count END), 0) AS BIGINT) AS official_board_candidate_count,
  coalesce(bool_or(section = 'CHINA' AND complete), false) OR run = 3 AS period_boundary_reached, CASE WHEN coalesce(bool_or(section = 'CHINA' AND complete), false) OR run = 3 THEN 'period_complete_public' ELSE 'partial' END AS coverage_state, coalesce(max(CASE WHEN section = 'CHINA' THEN 'stable_list' END), 'no_main_board') AS sample_stop_reason, count(*) AS board_route_count, bool_or(section IN ('CHINA', 'KENYA')) AS board_discovery_fallback FROM b GROUP BY run""")
def board_summary(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("run"), F.col("n_name").alias("section"), F.col("n_nationkey").cast("long").alias("k"))
    boards = n.select("run", "section", (F.col("k") % 5 == 0).alias("complete"), F.col("k").alias("rounds"), (F.col("k") * 10).alias("candidate_count"), F.lit(1).alias("detail_verified_count"), F.lit(0).alias("detail_failed_count"), F.lit(0).alias("old_post_count"), F.lit("2024-01-01").alias("oldest_verified_date"), F.lit("stable_list").alias("stop_reason"))
    fed = n.select("run").distinct().withColumn("feed_stop_reason", F.when(F.col("run") == 3, "period_boundary_reached").otherwise("page_limit"))
    routes = n.select("run", "section", F.lit("fallback").alias("discovery"), F.lit(False).alias("excluded_section"))
    out = collect.board_summary(boards, fed, routes, "CHINA", "KENYA")
    return out.select("run", "collection_rounds", "main_board_candidate_count", "official_board_candidate_count", "period_boundary_reached", "coverage_state", "sample_stop_reason", "board_route_count", "board_discovery_fallback")
