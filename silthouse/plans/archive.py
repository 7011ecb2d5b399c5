"""Queries over a row archive: newest states, filters, pages, facets, merges and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silthouse.functions.identity import content_hash
from silthouse.operators import archive as A
from silthouse.operators import merge as M
from silthouse.plans.registry import query
from silthouse.session import load

NEWEST_SQL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


def _newest_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return A.newest_by(rows, ["user_id"], ["ts", "event_id"])


@query("latest_value_counts", f"SELECT event_type AS value, count(*) AS items FROM ({NEWEST_SQL}) GROUP BY 1")
def latest_value_counts(spark, sf):
    return A.value_counts(_newest_events(spark, sf), "event_type")


@query("latest_per_item", f"SELECT user_id, event_id, event_type FROM ({NEWEST_SQL})")
def latest_per_item(spark, sf):
    return _newest_events(spark, sf).select("user_id", "event_id", "event_type")


@query("latest_item_keys", f"SELECT DISTINCT user_id FROM ({NEWEST_SQL}) WHERE NOT coalesce(trim(event_type), '') IN ('purchase')")
def latest_item_keys(spark, sf):
    return A.item_keys(_newest_events(spark, sf), "user_id", excluded=["purchase"], status="event_type")


@query(
    "item_history",
    """SELECT event_id, event_type, coalesce(event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1, true) AS changed
       FROM events WHERE user_id = 7 WINDOW w AS (ORDER BY ts, event_id)""",
)
def item_history(spark, sf):
    return A.item_history(load(spark, sf, "events"), "user_id", 7, ["ts", "event_id"], "event_type").select("event_id", "event_type", "changed")


@query("key_frontier", "SELECT split_part(k, '-', 1) AS prefix, max(k) AS frontier FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS k FROM orders) GROUP BY 1")
def key_frontier(spark, sf):
    return A.key_frontier(load(spark, sf, "orders"), F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("recent_series", "SELECT split_part(k, '-', 1) AS prefix, max(k) AS frontier FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS k FROM orders) GROUP BY 1 ORDER BY 1 DESC LIMIT 3")
def recent_series(spark, sf):
    return A.recent_series(key_frontier(spark, sf), 3)


@query(
    "archive_search_ilike",
    """SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%re%' OR p_brand ILIKE '%re%' OR p_type ILIKE '%re%' OR CAST(p_partkey AS VARCHAR) ILIKE '%re%'
       ORDER BY p_name DESC NULLS LAST, p_partkey LIMIT 100""",
)
def archive_search_ilike(spark, sf):
    rows = load(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return A.search(rows, q="re", sort="p_name desc, p_partkey").select("p_partkey", "p_name", "p_type")


@query(
    "datastore_filters",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND CAST(c_nationkey AS VARCHAR) = '7' ORDER BY c_custkey LIMIT 100",
)
def datastore_filters(spark, sf):
    filters = A.from_query_string({"q": "", "limit": "100", "c_nationkey": "7"}) | {"c_mktsegment": ["BUILDING", "MACHINERY"], "unknown": "x"}
    return A.search(load(spark, sf, "customer"), ["c_custkey", "c_name", "c_mktsegment", "c_nationkey", "nope"], filters, sort="c_custkey").drop("c_nationkey")


@query("multi_sort_page", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer ORDER BY c_mktsegment ASC NULLS LAST, c_nationkey DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 40")
def multi_sort_page(spark, sf):
    rows = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return A.page(rows, A.sort_orders(rows, "c_mktsegment, c_nationkey desc, nothing, c_custkey"), 20, 40)


@query("distinct_projection", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_projection(spark, sf):
    return A.project(load(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], distinct=True)


@query("column_filters", "SELECT p_partkey FROM part WHERE p_name ILIKE '%e%' AND p_type ILIKE '%st%'")
def column_filters(spark, sf):
    rows = load(spark, sf, "part")
    return rows.filter(A.columns_like(rows, {"p_name": "e", "p_type": "st", "p_brand": "", "other": "x"})).select("p_partkey")


@query("capped_count", "SELECT least(count(*), 1000) AS n, count(*) > 1000 AS capped FROM orders")
def capped_count(spark, sf):
    n, capped = A.capped_count(load(spark, sf, "orders"), 1000)
    return spark.createDataFrame([(n, capped)], "n long, capped boolean")


@query("truncation_probe", "SELECT count(*) AS n, (SELECT count(*) FROM customer) > 50 AS truncated FROM (SELECT * FROM customer LIMIT 50)")
def truncation_probe(spark, sf):
    rows, more = A.truncated(load(spark, sf, "customer"), 50)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.lit(more).alias("truncated"))


@query("facet_counts", "SELECT 'o_orderstatus' AS axis, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def facet_counts(spark, sf):
    return A.facets(load(spark, sf, "orders"), {"o_orderstatus": None, "o_orderpriority": None})


@query(
    "facet_self_exclusion",
    """SELECT 'o_orderstatus' AS axis, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 2
       UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'O' GROUP BY 2""",
)
def facet_self_exclusion(spark, sf):
    return A.facets(load(spark, sf, "orders"), {"o_orderstatus": F.col("o_orderstatus") == "O", "o_orderpriority": F.col("o_orderpriority") == "1-URGENT"})


@query("and_tags", "SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3")
def and_tags(spark, sf):
    return A.carrying_all(load(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


@query("identifier_filter", "SELECT doc_id FROM documents WHERE CAST(doc_id AS VARCHAR) = 'src3' OR source = 'src3' OR list_contains(string_split(lang, ','), 'src3')")
def identifier_filter(spark, sf):
    return load(spark, sf, "documents").filter(A.identified([F.col("doc_id").cast("string"), F.col("source")], [F.split("lang", ",")], "src3")).select("doc_id")


@query("corrupt_rows", "SELECT count(*) FILTER (WHERE contains(text, chr(65533))) AS corrupt, count(*) AS n FROM documents")
def corrupt_rows(spark, sf):
    rows = load(spark, sf, "documents").select("text")
    return rows.agg(F.count_if(A.corrupt(rows)).alias("corrupt"), F.count(F.lit(1)).alias("n"))


@query(
    "years_overlap",
    "SELECT o_custkey FROM (SELECT o_custkey, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders GROUP BY 1) WHERE b >= 1997 AND a <= 1996",
)
def years_overlap(spark, sf):
    spans = load(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    return spans.filter(A.years_overlap(F.col("a"), F.col("b"), 1997, 1996)).select("o_custkey")


@query(
    "relaxed_search",
    """WITH f AS (SELECT o_orderpriority = 'none such' AS a, o_orderstatus = 'F' AS b FROM orders), c AS (SELECT count(*) FILTER (a AND b) AS ab, count(*) FILTER (b) AS b, count(*) AS n FROM f)
       SELECT CASE WHEN ab > 0 THEN ab WHEN b > 0 THEN b ELSE n END AS n, CASE WHEN ab > 0 THEN '' WHEN b > 0 THEN 'a' ELSE 'a,b' END AS dropped FROM c""",
)
def relaxed_search(spark, sf):
    filters = [("a", F.col("o_orderpriority") == "none such"), ("b", F.col("o_orderstatus") == "F")]
    rows, dropped = A.relaxed(load(spark, sf, "orders"), filters, ["a", "b"])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.lit(",".join(dropped)).alias("dropped"))


@query(
    "top_with_other",
    """WITH c AS (SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS k FROM c)
       SELECT CASE WHEN k <= 4 THEN label ELSE 'other' END AS label, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""",
)
def top_with_other(spark, sf):
    counts = load(spark, sf, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return A.top_with_other(counts, "label", ["n"], "n", 5)


@query("bulk_preview", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20")
def bulk_preview(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "lang", F.lit("POINT(0 0)").alias("wkt")).orderBy("doc_id")
    return A.preview(rows)


# merges -------------------------------------------------------------------------------------


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders up to 1998 as the archive; orders from 1997 on as what comes in."""
    rows = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return rows.filter("day < '1998'"), rows.filter("day >= '1997'")


@query("insert_if_absent", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1998'")
def insert_if_absent(spark, sf):
    old, new = _halves(spark, sf)
    return M.insert_if_absent(old, new.unionByName(new), ["o_orderkey"]).select("o_orderkey", "day")


@query("insert_if_absent_keyless", "SELECT DISTINCT lang, source, n_chars FROM documents WHERE doc_id >= 100 AND (lang, source, n_chars) NOT IN (SELECT (lang, source, n_chars) FROM documents WHERE doc_id < 100)")
def insert_if_absent_keyless(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return M.insert_if_absent(rows.filter("doc_id < 100").drop("doc_id"), rows.filter("doc_id >= 100").drop("doc_id"))


@query("content_diff_append", "SELECT doc_id FROM documents WHERE doc_id >= 500 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id < 500)")
def content_diff_append(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "text")
    return M.content_diff(rows.filter("doc_id < 500"), rows.filter("doc_id >= 500"), ["text"]).select("doc_id")


@query(
    "stamp_refresh",
    """SELECT event_type, user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS stamp FROM events GROUP BY ALL""",
)
def stamp_refresh(spark, sf):
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = load(spark, sf, "events").select("event_id", "event_type", "user_id", at.alias("first_seen"), at.alias("stamp"))
    return M.refresh_stamp(rows.filter("event_id % 2 = 0").drop("event_id"), rows.filter("event_id % 2 = 1").drop("event_id"), "stamp")


@query(
    "upsert_latest",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') < '1997'
       UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1997'""",
)
def upsert_latest(spark, sf):
    old, new = _halves(spark, sf)
    fresh = new.withColumn("o_orderstatus", F.lit("X"))
    twice = fresh.withColumn("n", F.lit(1)).unionByName(new.withColumn("n", F.lit(2)))
    return M.upsert(old, twice, ["o_orderkey"], [F.col("n")]).select("o_orderkey", "o_orderstatus")


@query("weighted_upsert", "SELECT p_brand AS variant, max(p_size) AS weight FROM part GROUP BY 1")
def weighted_upsert(spark, sf):
    rows = load(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("variant"), F.col("p_size").alias("weight"))
    return M.weighted_upsert(rows.filter("p_partkey % 2 = 0"), rows.filter("p_partkey % 2 = 1"), ["variant"]).select("variant", "weight")


@query("accumulating_upsert", "SELECT lang AS name, count(*) AS occurrences, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents GROUP BY 1")
def accumulating_upsert(spark, sf):
    rows = load(spark, sf, "documents").groupBy(F.col("lang").alias("name"), (F.col("doc_id") < 300).alias("early")).agg(F.count(F.lit(1)).alias("occurrences"), F.collect_set("source").alias("sources"))
    out = M.accumulating_upsert(rows.filter("early").drop("early"), rows.filter("not early").drop("early"), "name", "occurrences", "sources")
    return out.withColumn("sources", F.array_join("sources", ","))


@query("content_hash_dedup", "SELECT min(doc_id) AS doc_id, md5(concat_ws(chr(31), lang, text)) AS hash FROM documents GROUP BY 2")
def content_hash_dedup(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", content_hash(["lang", "text"]).alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))


@query(
    "collapse_duplicates",
    """SELECT l_returnflag, l_linestatus, l_linenumber, strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen, strftime(max(l_shipdate), '%Y-%m-%d') AS stamp FROM lineitem GROUP BY ALL""",
)
def collapse_duplicates(spark, sf):
    at = F.date_format("l_shipdate", "yyyy-MM-dd")
    rows = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", at.alias("first_seen"), at.alias("stamp"))
    return M.collapse_history(rows, ["l_returnflag", "l_linestatus", "l_linenumber"], "first_seen", "stamp", loose=True)


@query(
    "version_diff",
    """SELECT o_orderkey, CASE WHEN day < '1997' THEN 'removed' WHEN day >= '1998' THEN 'added' ELSE 'modified' END AS change
       FROM (SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders) WHERE day < '1997' OR day >= '1998' OR o_orderstatus = 'F'""",
)
def version_diff(spark, sf):
    old, new = _halves(spark, sf)
    changed = new.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", "G").otherwise(F.col("o_orderstatus")))
    return M.version_diff(old, changed, ["o_orderkey"], ["o_custkey", "o_orderstatus", "day"])


@query("version_replay", "SELECT user_id, event_type, min(day) AS first_seen FROM (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY ALL")
def version_replay(spark, sf):
    rows = load(spark, sf, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return M.replay(rows, ["user_id", "event_type"], "day")


@query(
    "version_consolidate",
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS n FROM events) WHERE n = 1",
)
def version_consolidate(spark, sf):
    return M.consolidate(load(spark, sf, "events").select("user_id", "event_id", F.col("ts").alias("first_seen")), ["user_id"])


@query(
    "one_snapshot_per_date",
    """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, max(CASE WHEN event_type = 'click' THEN 1000000000 + event_id ELSE event_id END) AS k FROM events GROUP BY 1)
       SELECT day, k % 1000000000 AS event_id, k >= 1000000000 AS live, row_number() OVER (ORDER BY day) AS version FROM d""",
)
def one_snapshot_per_date(spark, sf):
    rows = load(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", (F.col("event_type") == "click").alias("live"))
    return M.one_per_date(rows, "day", "live").withColumn("version", F.col("version").cast("long"))


@query("find_or_create", "SELECT DISTINCT name, CASE WHEN name IN ('en', 'de') THEN name ELSE sha256(name) END AS id FROM (SELECT lang AS name FROM documents)")
def find_or_create(spark, sf):
    members = spark.createDataFrame([("en", "en"), ("de", "de")], "id string, name string")
    return M.find_or_create(members, load(spark, sf, "documents").select(F.col("lang").alias("name")))


@query(
    "metadata_diff",
    """SELECT a.c_custkey, 'status' AS path, 'changed' AS change, a.c_mktsegment AS before, 'BUILDING' AS after FROM customer a WHERE a.c_mktsegment <> 'BUILDING'
       UNION ALL SELECT c_custkey, 'name', 'removed', c_name, NULL FROM customer UNION ALL SELECT c_custkey, 'title', 'added', NULL, c_name FROM customer""",
)
def metadata_diff(spark, sf):
    old = F.create_map(F.lit("status"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"), F.lit("seen"), F.lit("1"))
    new = F.create_map(F.lit("status"), F.lit("BUILDING"), F.lit("title"), F.col("c_name"), F.lit("seen"), F.lit("2"))
    return load(spark, sf, "customer").select("c_custkey", F.explode(M.metadata_diff(old, new, ("seen",))).alias("d")).select("c_custkey", "d.path", "d.change", "d.before", "d.after")


@query("shrink_guard", "SELECT count(*) AS last, count(*) FILTER (WHERE o_orderstatus = 'F') AS rows, count(*) FILTER (WHERE o_orderstatus = 'F') >= 0.5 * count(*) AS accepted FROM orders")
def shrink_guard(spark, sf):
    n, m = load(spark, sf, "orders").agg(F.count(F.lit(1)), F.count_if(F.col("o_orderstatus") == "F")).first()
    return spark.createDataFrame([(n, m, M.shrink_guard(n, m))], "last long, rows long, accepted boolean")


@query(
    "version_change_summary",
    """SELECT CAST(count(*) FILTER (WHERE d >= '1998') AS BIGINT) AS added, CAST(count(*) FILTER (WHERE d < '1997') AS BIGINT) AS removed FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)""",
)
def version_change_summary(spark, sf):
    from silthouse.sources.writers import version_record

    old, new = _halves(spark, sf)
    record = version_record(None, M.version_diff(old, new, ["o_orderkey"], ["o_custkey", "o_orderstatus", "day"]), "orders", 2)
    return record.select(F.get_json_object("change_summary", "$.added").cast("long").alias("added"), F.get_json_object("change_summary", "$.removed").cast("long").alias("removed"))
