"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Rules are configuration: at most MAX_RULES of them, kept as a literal map from host to rules.
A url looks up each suffix of its host, so the work does not grow with the number of rules.

The listed URLs, in whatever spelling, are made canonical and fill a filter of blocks of eight 64-bit words; a key
sets one bit in each word of one block, so that an aggregation by block with bit_or builds it. It has BITS_PER_KEY
bits for each different listed URL. Up to MAX_BLOCKS blocks (64 bytes each) it is broadcast; a larger one is joined by
block number like any table, and Spark chooses how. Only pages that pass it are shuffled to the exact join.

Nulls and edges: a null url, or one without "://", has an empty host and path, which no rule
fits and which is never listed. Repeated pages are judged one by one; a null page id is kept.
Listed nulls, and listed URLs without a host, are left out; repeats count once. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silthouse.llm import common

BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 17
MAX_RULES = 10_000
#: Verdict and rule (host, then path) of the production query.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: The production query's list: sites, endings, languages, and page numbers of each.
SITES, ENDINGS, LANGUAGES, NUMBERS = ("free-bets", "m.casino-win", "spam-farm", "cheap-pills"), ("com", "net", "org"), ("en", "de", "fr", "es"), 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return _part(url, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host and path as one key: without "www.", a default port and slashes at the end."""
    return F.concat(F.regexp_replace(host, r"^www\.|:(80|443)$", ""), F.regexp_replace(path, "/+$", ""))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (n, rule, verdict) of the longest rule that fits, else null; of equally long ones the last in order."""
    assert len(rules) <= MAX_RULES
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    by: dict[str, list[Column]] = {}
    for verdict, text in rules:
        at = text.find("/") if "/" in text else len(text)
        by.setdefault(text[:at], []).append(F.struct(F.lit(len(text)).alias("n"), F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(text[at:]).alias("path")))
    table = F.create_map(*(x for h, own in by.items() for x in (F.lit(h), F.array(*own))))
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fit = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull())), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fit, lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return F.when(host != "", best)


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and in each of its words the bit."""
    bits = F.xxhash64(F.lit("bits"), key)
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), [F.shiftrightunsigned(bits, 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in range(8)]


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """block, w0 .. w7: the blocks that have keys."""
    block, bits = _place(F.col(key), blocks)
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), b)).alias(f"w{j}") for j, b in enumerate(bits)]
    return listed.filter(F.col(key).isNotNull()).groupBy(block.alias("block")).agg(*words)


def listed_among(pages: DataFrame, listed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The pages whose key may be in `listed`, each with `_listed` by the exact join; the pages that aren't there for sure."""
    listed = common.written(listed.select(F.col(key).alias("_key")).filter("_key is not null").distinct(), "listed")
    blocks = max(1, -(-listed.count() * BITS_PER_KEY // 512))
    block, bits = _place(F.col(key), blocks)
    filled = bloom(listed, "_key", blocks).withColumnRenamed("block", "_block")
    filled = F.broadcast(filled) if blocks <= MAX_BLOCKS else filled
    probed = pages.withColumn("_block", block).join(filled, "_block", "left")
    passes = F.col("w0").isNotNull()
    for j, b in enumerate(bits):
        passes &= F.call_function("shiftright", F.col(f"w{j}"), b).bitwiseAND(F.lit(1)) == 1
    passes = F.coalesce(passes, F.lit(False))
    drop = ["_block", *(f"w{j}" for j in range(8))]
    hits = probed.filter(passes).drop(*drop).join(listed.withColumn("_listed", F.lit(True)), F.col(key) == F.col("_key"), "left").drop("_key")
    return hits.withColumn("_listed", F.coalesce("_listed", F.lit(False))), probed.filter(~passes).drop(*drop)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict. `listed` has canonical URLs in its column `canonical`."""
    own = pages.select(F.col(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    own = own.withColumn("_rule", rule(F.col("host"), F.col("path"), rules)).withColumn("canonical", canonical(F.col("host"), F.col("path")))
    hits, rest = listed_among(own, listed, "canonical")
    both = hits.unionByName(rest.withColumn("_listed", F.lit(False)))
    plain = F.when(F.col("_listed") & (F.col("host") != ""), "block").otherwise("allow")
    return both.select(key, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", plain).alias("verdict"))


def canonical_list(urls: DataFrame, url: str = "url") -> DataFrame:
    """`canonical` of each listed URL that has a host."""
    own = urls.select(host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    return own.filter("host <> ''").select(canonical(F.col("host"), F.col("path")).alias("canonical"))


def production_list(spark: SparkSession) -> DataFrame:
    """The production query's list as its keepers would spell it: capitals, ports, slashes, queries, repeats, nulls and URLs that are no page."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    n = len(SITES) * len(ENDINGS) * len(LANGUAGES) * NUMBERS
    k = F.col("id") % n
    site, ending = pick(SITES, k), pick(ENDINGS, F.floor(k / len(SITES)))
    language, number = pick(LANGUAGES, F.floor(k / (len(SITES) * len(ENDINGS)))), F.floor(k / (n // NUMBERS)).cast("string")
    formal = F.concat(F.lit("HTTP://WWW."), F.upper(site), F.lit(".example."), ending, F.lit(":80/"), language, F.lit("/"), number, F.lit("/"))
    plain = F.concat(F.lit("https://"), site, F.lit(".example."), ending, F.lit("/"), language, F.lit("/"), number, F.lit("?from=list"))
    # a tenth is there twice, in the other spelling
    return spark.range(n + n // 10).select(F.when(F.col("id") % 97 == 0, F.lit(None)).when(F.col("id") < n, formal).otherwise(plain).alias("url"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages"), canonical_list(production_list(spark)))


SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
c AS (SELECT *, regexp_replace(host, '^www\.|:(80|443)$', '', 'g') || regexp_replace(path, '/+$', '') AS canonical FROM p),
ids AS (SELECT id, id % 480000 AS k FROM range(528000) t(id) WHERE id % 97 <> 0),
listed AS (
  SELECT DISTINCT ['free-bets', 'm.casino-win', 'spam-farm', 'cheap-pills'][1 + k % 4] || '.example.' || ['com', 'net', 'org'][1 + k // 4 % 3] || '/' || ['en', 'de', 'fr', 'es'][1 + k // 12 % 4] || '/' || k // 48 AS canonical
  FROM ids),
rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (
  SELECT c.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
  GROUP BY c.page_id)
SELECT c.page_id, c.host, c.path, fit.rule,
       coalesce(fit.verdict, CASE WHEN listed.canonical IS NOT NULL AND c.host <> '' THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fit USING (page_id) LEFT JOIN listed USING (canonical)
"""
