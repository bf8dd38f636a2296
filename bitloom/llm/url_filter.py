"""URL filtering by association rules.

FP-growth mines combinations of URL tokens that go with a bad label; rules under the support or confidence
asked for are pruned, as are rules that contain another rule of at least their confidence. A URL meets a
rule if it has all of its tokens: rules stand in an inverted index under their rarest token, so a URL looks
up its own tokens only. Stated host/path rules come before mined ones: the longest that fits decides.

Labels: a page is bad if the label row of its number says toxic 1 or quality 0, good if it says neither.
Defined results: a null URL, or one without ``://``, has empty host and path and no tokens, and is allowed
unless a rule says otherwise; equal urls get equal verdicts, and rows of one page_id are judged by their own urls; without labelled pages no rule is mined and the
method allows; empty tables give empty results; columns beside the named ones are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.75
#: Mined sets are 2^n of a URL's n tokens. Where URLs have more than so many, tokens that can stand in no rule are left out of them and
#: tokens that always stand together are named as one; neither changes a confidence.
LONG = 12
MAX_RULES_BROADCAST = 50_000
SALT = 32
BAD = "label:bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column) -> Column:
    """Distinct host labels, the names of registered hosts below two labels, and path segments with digits folded."""
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.transform(parts, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "\\d+", "0"))),
    ))


def _needed(items: DataFrame, min_support: float) -> int:
    return max(1, math.ceil(min_support * items.count()))


def _often(items: DataFrame, needed: int) -> dict[str, int]:
    """Tokens of long URLs that enough bad pages have, with the number of pages that have them: mean tokens by 1 / min_support at most."""
    seen = items.where(F.size("tokens") > LONG).select(F.explode("tokens").alias("token")).distinct()
    each = items.select(F.explode("tokens").alias("token"), "bad").join(seen, "token", "left_semi").groupBy("token")
    n = each.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("int")).alias("b")).where(F.col("b") >= needed)
    return {r.token: r.n for r in n.collect()}


def _listed(tokens: list[str]) -> Column:
    return F.array(*map(F.lit, tokens)).cast("array<string>")


def labelled(urls: DataFrame) -> DataFrame:
    return urls.where(F.col("bad").isNotNull() & (F.size("tokens") > 0))


def together(urls: DataFrame, min_support: float = MIN_SUPPORT) -> dict[str, str]:
    """Token -> the first of the tokens that stand in the same labelled URLs, all of them; empty without long URLs. A set has the same
    counts with either, so a rule holds for both."""
    items = labelled(urls)
    if items.where(F.size("tokens") > LONG).isEmpty():
        return {}
    often = _often(items, _needed(items, min_support))
    kept = items.select(F.array_sort(F.array_intersect("tokens", _listed([*often]))).alias("t")).where(F.size("t") > 1)
    pair = kept.select("t", F.explode("t").alias("first")).select("first", F.explode(F.filter("t", lambda x: x > F.col("first"))).alias("second"))
    pairs = pair.groupBy("first", "second").count().collect()
    out: dict[str, str] = {}
    for r in pairs:
        if r["count"] == often[r.first] == often[r.second]:
            out[r.second] = min(r.first, out.get(r.second, r.first))
    return out


def named(tokens: Column, same: dict[str, str]) -> Column:
    """Tokens with those that always stand together under one name."""
    if not same:
        return tokens
    names = F.create_map(*(F.lit(x) for pair in same.items() for x in pair))
    return F.array_distinct(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(names, t), t)))


def mine(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """antecedent (tokens), confidence, support of the rules that end in a bad label, from all tokens. urls: tokens, bad (boolean)."""
    items, tokens = labelled(urls), F.col("tokens")
    if not items.where(F.size("tokens") > LONG).isEmpty():
        often = _often(items, _needed(items, min_support))
        tokens = F.when(F.size("tokens") > LONG, F.array_intersect("tokens", _listed([*often]))).otherwise(tokens)
    items = items.select(F.concat(tokens, F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    schema = "antecedent array<string>, confidence double, support double"
    if items.isEmpty():
        return urls.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.array_contains("consequent", BAD)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    # a rule says nothing new if a rule that it contains has its confidence: found through the inverted index, like a URL's rules
    small = index(rules, rules.select(F.col("antecedent").alias("tokens"))).select("token", F.col("antecedent").alias("small"), F.col("confidence").alias("c"))
    redundant = (
        rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(small, "token")
        .where((F.size("small") < F.size("antecedent")) & (F.size(F.array_except("small", "antecedent")) == 0) & (F.col("c") >= F.col("confidence")))
        .select("antecedent").distinct()
    )
    return rules.join(redundant, "antecedent", "left_anti")


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """token -> rules: each rule stands under the token that fewest URLs have."""
    df = urls.select(F.explode("tokens").alias("token")).groupBy("token").count()
    each = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(df, "token")
    return each.groupBy("antecedent").agg(F.min(F.struct("count", "token")).alias("m"), F.max("confidence").alias("confidence")).select(
        F.col("m.token").alias("token"), "antecedent", "confidence"
    )


def match(urls: DataFrame, rules_index: DataFrame, id_col: str) -> DataFrame:
    """id, confidence of the best rule that each URL meets."""
    if rules_index.limit(MAX_RULES_BROADCAST + 1).count() <= MAX_RULES_BROADCAST:
        rules_index = F.broadcast(rules_index)
    return (
        urls.select(id_col, "tokens", F.explode("tokens").alias("token"))
        .join(rules_index, "token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy(id_col)
        .agg(F.max("confidence").alias("confidence"))
    )


def stated(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest stated rule that fits, else null."""
    fits = [
        F.when((F.concat(F.lit("."), host).endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    best = F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))
    return F.struct(best.rule.alias("rule"), best.verdict.alias("verdict"))


def op4(pages: DataFrame, labels: DataFrame) -> DataFrame:
    read = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    read = read.withColumn("tokens", tokens(F.col("host"), F.col("path"))).withColumn("s", stated(F.col("host"), F.col("path")))
    said = labels.groupBy("doc_id").agg(F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)).alias("bad"))
    bad = lambda pages: pages.join(said, pages.page_id == said.doc_id, "left").select("page_id", "tokens", "bad")
    read = read.withColumn("tokens", named(F.col("tokens"), together(bad(read))))
    known = bad(read)
    rules_index = index(mine(known), read)
    # token sets, not pages, are matched: urls repeat, and so do page ids
    hits = match(read.select("tokens", F.col("tokens").alias("met")).distinct(), rules_index, "met")
    # one token set can be that of a third of all pages: its rows meet their hit in SALT places
    hits = hits.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    read = read.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)))
    return read.join(hits, (read.tokens == hits.met) & (read.salt == hits.place), "left").select(
        "page_id", "host", "path", F.col("s.rule").alias("rule"),
        F.coalesce("s.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.col("confidence"),
    )


#: Host and path, tokens, every token set of the labelled pages with its counts, the rules among them, and each page's sets.
ORACLE = rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
t AS (SELECT *, list_sort(list_distinct(list_concat(
  list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '\d+', '0', 'g'))))) AS tok FROM u),
l AS (SELECT doc_id, bool_or(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0) AS bad FROM labels GROUP BY doc_id),
x AS (SELECT rid, page_id, list_filter(tok, lambda v, i: (m >> (i - 1)::INTEGER) & 1 = 1) AS x FROM (SELECT rid, page_id, tok, unnest(range(1, 1::BIGINT << len(tok)::INTEGER)) AS m FROM t)),
n AS (SELECT count(*) AS n FROM t JOIN l ON l.doc_id = page_id WHERE len(tok) > 0),
c AS (SELECT x, count(*) AS f, count(*) FILTER (WHERE bad) AS b FROM x JOIN l ON l.doc_id = page_id GROUP BY x),
r AS (SELECT x, b / f AS confidence FROM c, n WHERE b >= greatest(1, ceil({MIN_SUPPORT} * n.n)) AND b / f >= {MIN_CONFIDENCE}),
h AS (SELECT rid, max(confidence) AS confidence FROM x JOIN r USING (x) GROUP BY rid),
s AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM t JOIN (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}) w(h, p, v)
  ON ends_with('.' || host, '.' || h) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, s.rule, coalesce(s.v, CASE WHEN confidence IS NULL THEN 'allow' ELSE 'block' END) AS verdict, confidence FROM t LEFT JOIN h USING (rid) LEFT JOIN s USING (rid)
"""
