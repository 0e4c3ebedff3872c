"""Operator 10 [native]: URL filters by association rules.

Spark's FP-growth mines combinations of URL tokens together with the label of the page. Rules whose
consequent is the label `block`, with enough support and confidence, are kept; a rule with an antecedent
that contains that of a kept rule of no less confidence is pruned. Rules are matched by an inverted index.
Fixed rules (host suffix and path prefix, longest first) come before the mined ones.

A page is labelled bad if its `labels` row says toxic or quality 0. Tokens of a URL are its host, its
suffixes, scheme, all path segments (the first by itself, the last by its shape, those between as they are), the
file ending and the names of all query parameters. Tokens that fewer pages than the support have are left out
before mining, so that a page's item sets stay few.

A rule is matched through its rarest token alone: only URLs that have it meet the rule, and its other tokens are then
looked up in the URL's. Frequent tokens such as the scheme anchor a rule only where it has nothing rarer.

Defined results: a null url or one without `://` has an empty host and path, no rule and the method's
verdict on an empty token set (allow); a null page_id and repeated rows give a row each; without labels
nothing is mined and the method allows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

#: Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
BLOCK = "label=block"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL, in order."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.get(segments, F.size(segments) - 1)
    shape = F.regexp_replace(F.regexp_replace(last, r"(?s)[0-9]+", "9"), r"(?s)[^9.]+", "a")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "(?s)^[^=]*", 0))
    between = F.slice(segments, 2, F.greatest(F.size(segments) - 2, F.lit(0)))
    ending = F.regexp_extract(last, r"(?s)\.([A-Za-z0-9]{1,8})$", 1)
    tokens = F.array(
        F.concat(F.lit("host="), host),
        F.when(F.size(labels) > 1, F.concat(F.lit("site="), F.array_join(F.slice(labels, -2, 2), "."))),
        F.concat(F.lit("top="), F.element_at(labels, -1)),
        F.when(F.size(labels) > 2, F.concat(F.lit("sub="), F.get(labels, F.lit(0)))),
        F.concat(F.lit("first="), F.get(segments, F.lit(0))),
        F.concat(F.lit("shape="), shape),
        F.when(ending != "", F.concat(F.lit("ending="), F.lower(ending))),
        F.concat(F.lit("scheme="), F.regexp_extract(url, "(?s)^(.*?)://", 1)),
    )
    tokens = F.concat(F.array_compact(tokens), F.transform(between, lambda s: F.concat(F.lit("in="), s)), F.transform(F.filter(names, lambda n: n != ""), lambda n: F.concat(F.lit("query="), n)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(tokens)))


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest fixed rule that fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(RULES, key=lambda r: len(r[0] + r[1])):  # the last when() wins
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, rule_verdict).otherwise(verdict)
    return name, verdict


def anchored(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """rules(antecedent) with `anchor`, the token of each that is rarest by frequency(token, n); one without a count is rarest."""
    each = rules.select("antecedent", F.explode("antecedent").alias("token")).join(frequency, "token", "left")
    rarest = each.groupBy("antecedent").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("anchor"))
    return rules.join(rarest, "antecedent")


def inside(less: Column, more: Column) -> Column:
    return F.size(F.array_except(less, more)) == 0


def mine(transactions: DataFrame, support: float, confidence: float) -> DataFrame:
    """rule_id, antecedent, confidence of the pruned rules, from rows with an array `items`."""
    total = transactions.count()
    counts = transactions.select(F.explode(F.array_distinct("items")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support * total)
    known = transactions.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.explode(F.array_distinct("items")).alias("token")).join(counts.select("token"), "token", "left_semi")
    items = known.groupBy("_row").agg(F.collect_list("token").alias("items"))
    # rows without a frequent token count for the support: they are what is missing to `total`
    share = support * total / max(1, items.count()) if total else support
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, share), minConfidence=confidence).fit(items)
    found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCK))).select(F.array_sort("antecedent").alias("antecedent"), "confidence")
    uses = found.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    shorter = anchored(found, uses).select(F.col("antecedent").alias("less"), F.col("confidence").alias("no_less"), F.col("anchor").alias("token"))
    met = found.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(shorter, "token")
    covered = met.filter((F.size("less") < F.size("antecedent")) & (F.col("no_less") >= F.col("confidence")) & inside(F.col("less"), F.col("antecedent")))
    pruned = found.join(covered.select("antecedent").distinct(), "antecedent", "left_anti")
    return pruned.withColumn("rule_id", F.xxhash64("antecedent"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """key and the best mined rule of each distinct token set (key, tokens) that some rule fits."""
    each = urls.select("key", "tokens", F.explode("tokens").alias("anchor"))
    frequency = each.groupBy(F.col("anchor").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    met = each.join(anchored(rules.select("antecedent", "confidence"), frequency), "anchor").filter(inside(F.col("antecedent"), F.col("tokens")))
    best = F.max(F.struct("confidence", "antecedent"))
    return met.groupBy("key").agg(best.alias("best")).select("key", F.col("best.antecedent").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, support: float = 0.005, confidence: float = 0.6) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule of each page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path"))).withColumn("key", F.xxhash64("tokens"))
    bad = F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0))
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(bad.alias("bad"))
    items = F.when(F.col("bad"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens"))
    transactions = urls.filter("size(tokens) > 0").join(marked, "page_id").select(items.alias("items"))
    sets = urls.groupBy("key").agg(F.first("tokens").alias("tokens"))  # pre-aggregated: equal token sets are matched once
    matched = match_rules(sets, mine(transactions, support, confidence))
    name, verdict = fixed_rule(F.col("host"), F.col("path"))
    method = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return urls.join(matched, "key", "left").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "mined_rule")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))
