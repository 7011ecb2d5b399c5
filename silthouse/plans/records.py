"""Queries over records: JSON entries, derived labels, spines, queues and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from silthouse.operators import records as R
from silthouse.operators import spatial as P
from silthouse.plans.registry import query
from silthouse.plans.texts import _METRES, _POINTS, _points
from silthouse.session import load


@query("json_expansion", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def json_expansion(spark, sf):
    return R.json_entries(load(spark, sf, "events"), ["event_id"], "props")


@query("json_file_counts", "SELECT event_type, count(DISTINCT (user_id, json_extract_string(props, '$.k'))) AS files FROM events GROUP BY 1")
def json_file_counts(spark, sf):
    entries = R.json_entries(load(spark, sf, "events"), ["event_type", "user_id"], "props")
    return entries.select("event_type", "user_id", "value").distinct().groupBy("event_type").agg(F.count(F.lit(1)).alias("files"))


@query(
    "size_rollup",
    "SELECT conv_id, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT DISTINCT conv_id, role, length(text) AS n FROM conversations) GROUP BY 1",
)
def size_rollup(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "role", F.length("text").alias("n")).distinct().groupBy("conv_id").agg(F.sum("n").alias("bytes"))


@query("column_mapping", "SELECT * FROM (VALUES ('title', 'subject', 1.0::DOUBLE), ('start', 'o_orderdate', 0.7), ('location', 'place', 1.0)) AS t(field, \"column\", confidence)")
def column_mapping(spark, sf):
    names = ["subject", "place", *load(spark, sf, "orders").columns]
    return spark.createDataFrame([(k, c, x) for k, (c, x) in R.column_mapping(names).items()], "field string, column string, confidence double")


@query(
    "record_transform",
    "SELECT c_name AS title, c_custkey AS start, '{\"segment\":\"' || c_mktsegment || '\"}' AS other_fields FROM customer WHERE c_custkey % 2 = 0",
)
def record_transform(spark, sf):
    rows = load(spark, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" ").alias("name"), F.col("c_custkey").alias("day"), F.col("c_mktsegment").alias("segment"), F.lit("").alias("blank"))
    return R.transformed(rows, {"title": "name", "start": "day"})


@query(
    "derived_labels",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'survey' END AS form, CASE o_orderkey % 4 WHEN 0 THEN 'monthly' WHEN 1 THEN 'annual' END AS frequency, CAST(year(o_orderdate) AS INTEGER) AS vintage FROM orders""",
)
def derived_labels(spark, sf):
    kind = F.when(F.col("o_orderkey") % 4 == 0, "Tables, monthly").when(F.col("o_orderkey") % 4 == 1, "A survey, yearly").otherwise("Report")
    title = F.concat_ws(" ", kind, F.lit("1991 to"), F.year("o_orderdate").cast("string"))
    return load(spark, sf, "orders").select("o_orderkey", R.labelled(title, R.FORMS).alias("form"), R.labelled(title, R.FREQUENCIES).alias("frequency"), R.vintage(title).alias("vintage"))


@query(
    "series_editions",
    """SELECT o_orderpriority, count(DISTINCT year(o_orderdate)) AS editions, CAST(max(year(o_orderdate)) AS INTEGER) AS latest FROM orders GROUP BY 1""",
)
def series_editions(spark, sf):
    titles = load(spark, sf, "orders").select("o_orderpriority", F.concat(F.lit("Report "), F.col("o_orderpriority"), F.lit(", "), F.year("o_orderdate").cast("string")).alias("title"))
    per = titles.distinct().groupBy(R.series_key(F.col("title")), "o_orderpriority").agg(F.count(F.lit(1)).alias("editions"), F.max(R.vintage(F.col("title"))).alias("latest"))
    return per.select("o_orderpriority", "editions", "latest")


@query("size_bands", "SELECT CASE WHEN n < 1000 THEN 'small' WHEN n < 100000 THEN 'medium' ELSE 'large' END AS band, count(*) AS sets FROM (SELECT lang, source, sum(n_chars) AS n FROM documents GROUP BY ALL) GROUP BY 1")
def size_bands(spark, sf):
    return load(spark, sf, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("n")).groupBy(R.size_band(F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("sets"))


@query(
    "calendar_window",
    """SELECT DISTINCT d AS day, CAST(date_trunc('month', d) - CAST(dayofweek(date_trunc('month', d)) AS INTEGER) * INTERVAL 1 DAY AS DATE) AS first, CAST(last_day(d) + (6 - CAST(dayofweek(last_day(d)) AS INTEGER)) * INTERVAL 1 DAY AS DATE) AS last FROM (SELECT CAST(ts AS DATE) AS d FROM events)""",
)
def calendar_window(spark, sf):
    days = load(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    return days.select("day", R.calendar_window(F.col("day"), "month").alias("w")).select("day", "w.first", "w.last")


@query(
    "crosswalk_fallback",
    """SELECT c_custkey, CAST(n.n_regionkey AS INTEGER) AS target, CASE WHEN c_nationkey < 10 THEN 'code' WHEN c_nationkey < 20 THEN 'name' ELSE 'none' END AS match_kind
       FROM customer LEFT JOIN nation n ON n.n_nationkey = c_nationkey AND c_nationkey < 20""",
)
def crosswalk_fallback(spark, sf):
    nation = load(spark, sf, "nation")
    rows = load(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_nationkey").alias("code"), F.col("n_name").alias("town"))
    codes = nation.filter("n_nationkey < 10").select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("target"))
    names = nation.filter("n_nationkey < 20").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("target"))
    return R.crosswalk(rows, codes, names, "code", "town").select("c_custkey", "target", "match_kind")


@query("pair_resolution", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_partkey) AS target FROM lineitem GROUP BY ALL")
def pair_resolution(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_partkey")
    resolver = rows.groupBy("l_returnflag", "l_linestatus").agg(F.min("l_partkey").alias("target"))
    return R.resolved_pairs(rows, ["l_returnflag", "l_linestatus"], resolver).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))


@query(
    "colliding_edges",
    """WITH e AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey - 1 ELSE o_custkey END AS a, o_orderpriority AS b FROM orders) SELECT id FROM e WHERE id <> (SELECT min(id) FROM e x WHERE x.a = e.a AND x.b = e.b)""",
)
def colliding_edges(spark, sf):
    edges = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("src"), F.col("o_orderpriority").alias("dst"))
    even = load(spark, sf, "orders").filter("o_custkey % 2 = 0").select("o_custkey").distinct()
    mapping = even.select(F.col("o_custkey").cast("string").alias("id"), (F.col("o_custkey") - 1).cast("string").alias("canonical"))
    return R.colliding(edges, mapping, []).select("id")


@query("claim_coverage", "SELECT p_partkey, min(l_suppkey) AS held_by FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49 GROUP BY 1")
def claim_coverage(spark, sf):
    holders = load(spark, sf, "lineitem").filter("l_quantity > 49").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("parts"))
    return R.claims(load(spark, sf, "part").select("p_partkey"), holders, "p_partkey", "l_suppkey", "parts")


@query(
    "geocode_acceptance",
    f"""WITH a AS (SELECT vec_id, label, lon, lat FROM {_POINTS} WHERE vec_id % 2 = 0), b AS (SELECT label, lon, lat FROM {_POINTS} WHERE vec_id % 2 = 1 AND label < 5)
        SELECT vec_id, CASE WHEN NOT EXISTS (SELECT 1 FROM b WHERE b.label = a.label) OR EXISTS (SELECT 1 FROM b WHERE b.label = a.label AND {_METRES} <= 3000) THEN 'ok' ELSE 'wrong_locality' END AS verdict FROM a""",
)
def geocode_acceptance(spark, sf):
    points = _points(spark, sf)
    places = points.filter("vec_id % 2 = 1 and label < 5").select("label", "lon", "lat")
    return R.accepted(points.filter("vec_id % 2 = 0"), "vec_id", places, "label", 3000.0, P.within)


@query("work_queue_order", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 10")
def work_queue_order(spark, sf):
    tasks = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("source"))
    capped = load(spark, sf, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("source"))
    return R.claim_order(tasks, capped, "source").limit(10).select(F.col("id").alias("o_orderkey"))


@query(
    "one_per_family",
    """SELECT family, title, n FROM (SELECT trim(regexp_replace(p_brand, '[0-9]+', '', 'g')) AS family, p_brand AS title, count(*) AS n, row_number() OVER (PARTITION BY trim(regexp_replace(p_brand, '[0-9]+', '', 'g')) ORDER BY count(*) DESC, p_brand DESC) AS k FROM part GROUP BY 1, 2) WHERE k = 1 ORDER BY n DESC, family LIMIT 6""",
)
def one_per_family(spark, sf):
    return R.one_of_family(load(spark, sf, "part").groupBy(F.col("p_brand").alias("title")).agg(F.count(F.lit(1)).alias("n")), "title", "n", 6)


@query(
    "source_load",
    """SELECT coalesce(a.k, b.k, c.k) AS nation, coalesce(x, 0) AS customers, coalesce(y, 0) AS indebted, coalesce(z, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS x FROM customer GROUP BY 1) a
       FULL JOIN (SELECT c_nationkey AS k, count(*) AS y FROM customer WHERE c_acctbal < 0 GROUP BY 1) b ON a.k = b.k FULL JOIN (SELECT s_nationkey AS k, count(*) AS z FROM supplier GROUP BY 1) c ON coalesce(a.k, b.k) = c.k""",
)
def source_load(spark, sf):
    customers = load(spark, sf, "customer").withColumn("nation", F.col("c_nationkey"))
    return R.source_load({"customers": customers, "indebted": customers.filter("c_acctbal < 0"), "suppliers": load(spark, sf, "supplier").withColumn("nation", F.col("s_nationkey"))}, "nation")


@query(
    "parcel_spine",
    """WITH n AS (SELECT l_orderkey, l_linenumber, max(l_shipdate) AS d FROM lineitem GROUP BY ALL) SELECT n.l_orderkey || '-' || l_linenumber AS key, m.c > 1 AS ambiguous FROM n JOIN (SELECT l_orderkey, count(*) AS c FROM n GROUP BY 1) m USING (l_orderkey)""",
)
def parcel_spine(spark, sf):
    newest = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("d")).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return R.spine(newest, "key", "l_orderkey").select("key", "ambiguous")


@query(
    "newest_task",
    "SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed FROM orders GROUP BY 1",
)
def newest_task(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))


@query("version_coverage", "SELECT c_custkey, count(o_orderkey) AS versions, count(o_orderkey) = 0 AS gap FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def version_coverage(spark, sf):
    per = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("versions"))
    return load(spark, sf, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("versions", F.lit(0)).alias("versions"), F.col("versions").isNull().alias("gap"))


@query("click_through", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS searches, count(*) FILTER (WHERE event_type = 'click') AS picked, count(*) FILTER (WHERE event_type = 'click' AND value < 10) AS picked_first FROM events GROUP BY 1")
def click_through(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("searches"), F.count_if(F.col("event_type") == "click").alias("picked"), F.count_if((F.col("event_type") == "click") & (F.col("value") < 10)).alias("picked_first"))


@query(
    "name_mentions",
    "SELECT DISTINCT doc_id AS id, w AS name FROM documents, (VALUES ('the and'), ('license'), ('of the')) AS t(w) WHERE contains(' ' || lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' ' || w || ' ')",
)
def name_mentions(spark, sf):
    names = spark.createDataFrame([("the and",), ("license",), ("of the",)], "name string")
    return R.mentions(load(spark, sf, "documents"), "doc_id", "text", names, "name")


@query(
    "url_lookup",
    """WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS k FROM pages) SELECT k AS key, count(*) AS pages, min(page_id) AS first FROM p GROUP BY 1""",
)
def url_lookup(spark, sf):
    from silthouse.functions.text import path_key

    return load(spark, sf, "pages").groupBy(path_key(F.col("url")).alias("key")).agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first"))
