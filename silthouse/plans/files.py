"""Queries that write files, read them back, and page, stack and guard what they hold."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silthouse.operators import console as Q
from silthouse.operators import graph as G
from silthouse.operators import spatial as P
from silthouse.plans.entities import _EDGES, _edges
from silthouse.plans.registry import query
from silthouse.session import TABLES, load
from silthouse.sources import readers as R
from silthouse.sources import writers as W
from silthouse.storage import shared_dir
from silthouse.streaming import ingest as I

_C = F.col


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _only_file(spark: SparkSession, folder: str) -> str:
    """The one part of a folder that was written as one file."""
    return spark.read.format("binaryFile").load(f"{folder}/part-*").select("path").first()[0]


# sources ------------------------------------------------------------------------------------


@query("csv_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, source FROM documents")
def csv_round_trip(spark, sf):
    """Whole texts with quotes, separators and line breaks, as a spreadsheet file and back."""
    rows, folder = load(spark, sf, "documents"), _folder(spark, "csv")
    W.csv_file(rows.select("doc_id", "text", "source"), folder, rows.count())
    return R.csv(spark, _only_file(spark, folder))


@query("csv_with_separators", "SELECT CAST(p_partkey AS VARCHAR) AS part, p_name || '; ' || p_brand AS label, CAST(p_size AS VARCHAR) AS col_3, p_type AS part_1 FROM part")
def csv_with_separators(spark, sf):
    """Semicolons, a blank header and a repeated one, in an older encoding."""
    folder = _folder(spark, "semicolons")
    line = F.concat_ws(";", _C("p_partkey").cast("string"), F.concat(F.lit('"'), _C("p_name"), F.lit("; "), _C("p_brand"), F.lit('"')), _C("p_size").cast("string"), "p_type")
    body = load(spark, sf, "part").select(line.alias("line"))
    head = spark.createDataFrame([("part;label;;part",)], "line string")
    head.unionByName(body).coalesce(1).write.text(folder)
    return R.csv(spark, _only_file(spark, folder))


@query(
    "calendar_events",
    """SELECT CAST(o_orderkey AS VARCHAR) AS uid, 'Order, ' || o_orderpriority AS title, o_orderdate AS start, o_orderdate + INTERVAL 90 MINUTE AS "end", 'CONFIRMED' AS status, 'a@example.com; b@example.com' AS participants FROM orders""",
)
def calendar_events(spark, sf):
    """Folded lines, escaped commas and guests of calendar files."""
    folder = _folder(spark, "calendar")
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    lines = ["BEGIN:VEVENT", F.concat(F.lit("UID:"), _C("o_orderkey").cast("string")), F.concat(F.lit("SUMMARY;LANGUAGE=en:Ord\n er\\, "), _C("o_orderpriority")), F.concat(F.lit("DTSTART:"), stamp("o_orderdate")), F.concat(F.lit("DTEND:"), stamp(_C("o_orderdate") + F.expr("INTERVAL 90 MINUTES"))), "STATUS:CONFIRMED", "ATTENDEE;CN=A:mailto:a@example.com", "ATTENDEE:mailto:b@example.com", "END:VEVENT"]
    load(spark, sf, "orders").select(F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines)).alias("line")).write.text(folder)
    return R.calendar(spark, folder).select("uid", "title", "start", "end", "status", "participants")


@query("saved_pages", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def saved_pages(spark, sf):
    """One document for each page of an API's answers; the types come from its metadata."""
    folder = _folder(spark, "pages")
    metadata = '<EntityType Name="Nation"><Property Name="id" Type="Edm.Int32"/><Property Name="name" Type="Edm.String"/></EntityType>'
    record = F.struct(_C("n_nationkey").alias("id"), _C("n_name").alias("name"))
    pages = load(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(record).alias("records"))
    pages.select("n_regionkey", F.to_json(F.struct(F.struct("records").alias("result"))).alias("value")).write.partitionBy("n_regionkey").text(folder)
    return R.json_pages(spark, f"{folder}/*/*", R.edm_schema(metadata, "Nation"))


@query("formats_found", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'pdf' END AS format FROM pages")
def formats_found(spark, sf):
    k = _C("page_id") % 4
    declared = F.when(k == 0, " CSV ").when(k == 1, "spreadsheet")
    name = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.when(k == 0, "/a.json").when(k == 1, "/a.XLSX?v=2").when(k == 2, "/a.b.pdf#3").otherwise("/index.html"))
    return load(spark, sf, "pages").select("page_id", R.format_of(declared, name).alias("format"))


@query("stacked_sources", "SELECT 'buyers' AS source, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'sellers', s_suppkey, s_name, NULL FROM supplier")
def stacked_sources(spark, sf):
    buyers = load(spark, sf, "customer").select(_C("c_custkey").alias("id"), _C("c_name").alias("name"), _C("c_mktsegment").alias("segment"))
    return R.stacked({"buyers": buyers, "sellers": load(spark, sf, "supplier").select(_C("s_suppkey").alias("id"), _C("s_name").alias("name"))})


@query("tables_with_columns", f"""SELECT table_name AS "table" FROM information_schema.columns WHERE table_name IN {TABLES} AND column_name IN ('doc_id', 'text') GROUP BY 1 HAVING count(DISTINCT column_name) = 2""")
def tables_with_columns(spark, sf):
    columns = spark.createDataFrame([(t, c) for t in TABLES for c in load(spark, sf, t).columns], "table string, column string")
    return R.tables_with(columns, {"DOC_ID", "text"})


@query("keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark, sf):
    return R.keyset_page(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 700)


@query("random_share", "SELECT true AS of_the_table, true AS about_as_many")
def random_share(spark, sf):
    """A sample of a third: its rows are the table's and their number is within a tenth of it."""
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    n = rows.count()
    part = R.sample(rows, n, n // 3)
    own = part.join(rows.distinct(), rows.columns, "left_anti").agg((F.count(F.lit(1)) == 0).alias("of_the_table"))
    return own.join(part.agg((F.abs(F.count(F.lit(1)) - n / 3) < n / 30).alias("about_as_many")))


# sinks --------------------------------------------------------------------------------------


@query("downloaded_parts", "SELECT p_partkey, p_name, p_brand FROM part")
def downloaded_parts(spark, sf):
    """A folder of JSON lines for each brand."""
    folder = _folder(spark, "downloads")
    W.downloads(load(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), folder, "p_brand")
    return spark.read.schema("p_partkey long, p_name string, p_brand string").json(folder)


@query("rebuilt_table", "SELECT c_custkey, c_mktsegment, 2 AS v FROM customer WHERE c_nationkey < 12 UNION ALL SELECT c_custkey, c_mktsegment, 1 FROM customer")
def rebuilt_table(spark, sf):
    """Both versions of a table that was rebuilt whole; the newest is what its readers see."""
    folder, rows = _folder(spark, "rebuilt"), load(spark, sf, "customer")
    W.rebuild(rows.select("c_custkey", "c_mktsegment"), folder)
    W.rebuild(rows.filter("c_nationkey < 12").select("c_custkey", "c_mktsegment"), folder)
    newest = W.current(spark, folder).withColumn("v", F.lit(2))
    return newest.unionByName(W.every_version(spark, folder).filter("v = 1").select("c_custkey", "c_mktsegment", _C("v").cast("int").alias("v")))


@query("feature_collections", "SELECT 25 AS features, true AS exceeded_transfer_limit")
def feature_collections(spark, sf):
    """As many features as an answer may have, of more."""
    rows = load(spark, sf, "customer").select("c_name", (_C("c_custkey") % 90).cast("double").alias("lon"), (_C("c_custkey") % 45).cast("double").alias("lat"))
    one = W.feature_collection(rows, P.geojson(rows), 25)
    kinds = F.from_json("collection", "type string, features array<struct<type string>>")
    return one.select(F.size(F.filter(kinds["features"], lambda f: f["type"] == "Feature")).alias("features"), "exceeded_transfer_limit")


# increments ---------------------------------------------------------------------------------


@query(
    "first_seen_stamps",
    """WITH o AS (SELECT user_id, event_type, max(ts) AS old FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
       SELECT user_id, event_type, coalesce(old, TIMESTAMP '2030-01-01') AS first_seen FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 5 = 0) LEFT JOIN o USING (user_id, event_type)""",
)
def first_seen_stamps(spark, sf):
    events, key = load(spark, sf, "events"), ["user_id", "event_type"]
    old = events.filter("event_id % 3 = 0").groupBy(*key).agg(F.max("ts").alias("first_seen"))
    return I.first_seen_stamped(events.filter("event_id % 5 = 0").select(*key).distinct(), old, key, F.lit("2030-01-01").cast("timestamp"))


@query(
    "runs_due",
    """SELECT user_id, max(ts) AS last, CAST(max(event_id % 7 + 1) AS INTEGER) AS hours, floor(epoch(TIMESTAMP '2024-01-28')) - floor(epoch(max(ts))) >= max(event_id % 7 + 1) * 3600 AS due FROM events GROUP BY user_id""",
)
def runs_due(spark, sf):
    return I.due(load(spark, sf, "events"), "user_id", "ts", F.lit("2024-01-28").cast("timestamp"), (_C("event_id") % 7 + 1).cast("int"))


@query("changed_listings", "SELECT true AS same_files, false AS same_after_a_write")
def changed_listings(spark, sf):
    """A listing tells whether a folder has changed, without its rows."""
    folder, rows = _folder(spark, "listed"), load(spark, sf, "region")
    rows.write.parquet(folder)
    before = spark.createDataFrame(R.listing(spark, folder).collect(), R.listing(spark, folder).schema)
    same = I.same_listing(before, R.listing(spark, folder))
    rows.write.mode("append").parquet(folder)
    return spark.createDataFrame([(same, I.same_listing(before, R.listing(spark, folder)))], "same_files boolean, same_after_a_write boolean")


# graphs and the console ---------------------------------------------------------------------


@query(
    "path_touching",
    f"""WITH e AS (SELECT src, dst FROM {_EDGES}), a AS (SELECT src, dst FROM e WHERE src = 'c7'),
       b AS (SELECT DISTINCT e.src, e.dst FROM e JOIN a ON e.dst = a.dst OR e.src = a.dst), w AS (SELECT src, dst, 1 AS step FROM a UNION ALL SELECT src, dst, 2 FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
       SELECT src, dst, step FROM w WHERE dst = (SELECT min(dst) FROM a)""",
)
def path_touching(spark, sf):
    """The edges of a walk of two steps from a customer that touch the first of the customer's parts."""
    edges = _edges(spark, sf)
    part = edges.filter("src = 'c7'").agg(F.min("dst")).first()[0]
    # an edge's end is reached from its other end, whichever way it points
    both = edges.unionByName(edges.select(_C("dst").alias("src"), _C("src").alias("dst")))
    walked = G.walk(both, "c7", 2, ["src", "dst"]).filter("src LIKE 'c%'").groupBy("src", "dst").agg(F.min("step").alias("step"))
    return G.path_touching(walked, part)


@query("nodes_around", f"SELECT src AS id FROM {_EDGES} WHERE dst = 'p77' UNION SELECT dst FROM {_EDGES} WHERE dst = 'p77'")
def nodes_around(spark, sf):
    return G.nodes_of(G.neighbourhood(_edges(spark, sf), "p77"))


_QUESTION = """WITH big AS (SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey HAVING count(*) > 3)
SELECT n_name, n, total FROM nation JOIN big ON n_nationkey = c_nationkey WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name <> 'AFRICA')"""


@query("guarded_question", _QUESTION)
def guarded_question(spark: SparkSession, sf: str) -> DataFrame:
    """A question with a named query and a subquery, over the tables that it may read."""
    tables = {"customer", "nation", "region"}
    for t in tables:
        load(spark, sf, t).createOrReplaceTempView(t)
    return Q.guarded(spark, _QUESTION, tables)


_ACROSS = """SELECT n_name, count(*) AS customers, CAST(sum(o.n) AS BIGINT) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {sales}orders GROUP BY 1) o ON o_custkey = c_custkey GROUP BY 1"""


@query("two_schemas", _ACROSS.format(sales=""))
def two_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """Bare names along a path of two schemas, and one name with its schema."""
    own = f"silthouse_{zlib.crc32(sf.encode()):08x}"
    for schema, tables in ((f"{own}_people", ("customer", "nation")), (f"{own}_sales", ("orders", "nation"))):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema} LOCATION '{shared_dir(spark)}/{schema}'")
        for t in tables:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {schema}.{t} USING parquet LOCATION '{sf}/{t}.parquet'")
    return Q.across(spark, _ACROSS.format(sales=f"{own}_sales."), f"{own}_people, {own}_sales")
