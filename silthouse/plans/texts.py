"""Queries that search and mark texts, places and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silthouse.operators import cover as V
from silthouse.operators import search as S
from silthouse.operators import spatial as P
from silthouse.operators.console import register
from silthouse.plans.registry import query
from silthouse.session import load
from silthouse.storage import shared_dir
from silthouse.streaming import ingest as I


@query(
    "operator_search",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'the and') AND contains(lower(text), 'tion') AND NOT contains(lower(text), 'license')",
)
def operator_search(spark, sf):
    return load(spark, sf, "documents").filter(S.matches(F.col("text"), S.parse_terms('"the and" (tion) -license'))).select("doc_id")


@query(
    "boolean_search",
    """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)
       SELECT doc_id FROM d WHERE (len(list_filter(w, lambda x: starts_with(x, 'sch'))) > 0 OR len(list_filter(w, lambda x: starts_with(x, 'that'))) > 0) AND NOT list_contains(w, 'der')""",
)
def boolean_search(spark, sf):
    return load(spark, sf, "documents").filter(S.boolean(F.col("text"), ["and", ["or", "sch", "that"], ["not", "'der'"]])).select("doc_id")


@query(
    "ranked_text_search",
    """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
       h AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: starts_with(x, 'hand'))) AS a, len(list_filter(w, lambda x: starts_with(x, 'licens'))) AS b FROM d),
       t AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM h)
       SELECT doc_id, a + b AS hits, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 3) AS score
       FROM h, t WHERE a > 0 OR b > 0""",
)
def ranked_text_search(spark, sf):
    return S.ranked(load(spark, sf, "documents"), "doc_id", "text", ["hand", "licens"])


@query(
    "snippets",
    """SELECT doc_id, CASE WHEN greatest(1, least(p - 30, length(text) - 59)) > 1 THEN '…' ELSE '' END || regexp_replace(substr(text, greatest(1, least(p - 30, length(text) - 59)), 60), '(?i)(license)', '**\\1**', 'g')
         || CASE WHEN greatest(1, least(p - 30, length(text) - 59)) + 59 < length(text) THEN '…' ELSE '' END AS snippet
       FROM (SELECT doc_id, text, CAST(instr(lower(text), 'license') AS INTEGER) AS p FROM documents WHERE contains(lower(text), 'license'))""",
)
def snippets(spark, sf):
    rows = load(spark, sf, "documents").filter(F.contains(F.lower("text"), F.lit("license")))
    return rows.select("doc_id", S.snippet(F.col("text"), ["license"], 60).alias("snippet"))


@query(
    "suggest_order",
    "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') ORDER BY starts_with(lower(p_name), 're') DESC, length(p_name), p_name, p_partkey LIMIT 20",
)
def suggest_order(spark, sf):
    names = load(spark, sf, "part").groupBy("p_name").agg(F.collect_set("p_partkey").alias("keys"))
    best = S.suggested(names, "p_name", "re", n=20).select("p_name", F.explode("keys").alias("p_partkey"))
    return best.orderBy(F.startswith(F.lower("p_name"), F.lit("re")).desc(), F.length("p_name"), "p_name", "p_partkey").limit(20).select("p_partkey", "p_name")


@query(
    "federated_search",
    """SELECT * FROM (SELECT 'part' AS source, CAST(p_partkey AS VARCHAR) AS id, p_name AS title FROM part WHERE contains(lower(p_name || ' ' || p_type), 'red') ORDER BY 2 LIMIT 5)
       UNION ALL SELECT * FROM (SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'red') ORDER BY 2 LIMIT 5)""",
)
def federated_search(spark, sf):
    part, customer = load(spark, sf, "part"), load(spark, sf, "customer")
    sources = {
        "part": (part, {"id": F.col("p_partkey"), "title": F.col("p_name"), "body": F.col("p_type")}),
        "customer": (customer, {"id": F.col("c_custkey"), "title": F.col("c_name"), "body": F.col("c_mktsegment")}),
    }
    return S.federated(sources, "RED", 5).select("source", "id", "title")


@query("facet_distincts", "SELECT DISTINCT unnest(string_split(p_type, ' ')) AS element FROM part")
def facet_distincts(spark, sf):
    return load(spark, sf, "part").select("p_type").distinct().select(F.explode(F.split("p_type", " ")).alias("element")).distinct()


# places -------------------------------------------------------------------------------------

_POINTS = "(SELECT vec_id, 35.0::DOUBLE + embedding[1]::DOUBLE / 4 AS lon, 31.5::DOUBLE + embedding[2]::DOUBLE / 4 AS lat, label FROM embeddings)"
_METRES = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic places: two numbers of each vector around one point."""
    e = F.col("embedding")
    return load(spark, sf, "embeddings").select("vec_id", (35.0 + e[0].cast("double") / 4).alias("lon"), (31.5 + e[1].cast("double") / 4).alias("lat"), "label")


@query("within_distance", f"SELECT a.vec_id AS a, b.vec_id AS b, CAST(round({_METRES}) AS BIGINT) AS metres FROM {_POINTS} a JOIN {_POINTS} b ON a.label = 1 AND b.label = 2 WHERE {_METRES} <= 3000")
def within_distance(spark, sf):
    a, b = _points(spark, sf).filter("label = 1"), _points(spark, sf).filter("label = 2")
    found = P.within(a.select(F.col("vec_id").alias("a"), "lon", "lat"), b.select(F.col("vec_id").alias("b"), "lon", "lat"), 3000.0)
    return found.select("a", "b", F.round("distance_m").cast("long").alias("metres"))


@query("ring_join", f"SELECT a.vec_id AS a, count(*) AS n FROM {_POINTS} a JOIN {_POINTS} b ON a.label = 1 AND b.label = 2 WHERE {_METRES} <= 9000 AND {_METRES} > 3000 GROUP BY 1")
def ring_join(spark, sf):
    a, b = _points(spark, sf).filter("label = 1"), _points(spark, sf).filter("label = 2")
    found = P.within(a.select(F.col("vec_id").alias("a"), "lon", "lat"), b.select(F.col("vec_id").alias("b"), "lon", "lat"), 9000.0, inner=3000.0)
    return found.groupBy("a").agg(F.count(F.lit(1)).alias("n"))


@query("nearest", f"SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_METRES}, b.vec_id) AS rank FROM {_POINTS} a JOIN {_POINTS} b ON true QUALIFY rank <= 3")
def nearest(spark, sf):
    """The three nearest places of every place, itself among them."""
    places = _points(spark, sf)
    return P.nearest(places.select(F.col("vec_id").alias("a"), "lon", "lat"), "a", places.select(F.col("vec_id").alias("b"), "lon", "lat"), "b", 3).select("a", "b", "rank")


@query("point_in_polygon", f"SELECT vec_id, CAST(floor(lon / 0.05) AS BIGINT) AS x, CAST(floor(lat / 0.05) AS BIGINT) AS y FROM {_POINTS} WHERE lon >= 35 AND lon < 35.1 AND lat >= 31.5 AND lat < 31.6")
def point_in_polygon(spark, sf):
    corner = lambda k: round(k * 0.05, 2)
    squares = [(x, y, f"POLYGON(({corner(x)} {corner(y)}, {corner(x + 1)} {corner(y)}, {corner(x + 1)} {corner(y + 1)}, {corner(x)} {corner(y + 1)}, {corner(x)} {corner(y)}))") for x in (700, 701) for y in (630, 631)]
    polygons = spark.createDataFrame(squares, "x long, y long, wkt string")
    return V.point_in_polygon(_points(spark, sf), polygons).select("vec_id", "x", "y")


def _shapes(points: DataFrame) -> DataFrame:
    """A ragged polygon for each label: every other of its places in turn around a point among them."""
    turn = F.atan2(F.col("lat") - 31.5, F.col("lon") - 35.0)
    corners = points.filter("vec_id % 2 = 0").groupBy("label").agg(F.sort_array(F.collect_list(F.struct(turn.alias("turn"), "vec_id", "lon", "lat"))).alias("c"))
    ring = F.transform("c", lambda p: F.concat(p["lon"].cast("string"), F.lit(" "), p["lat"].cast("string")))
    return corners.select("label", F.concat(F.lit("POLYGON(("), F.array_join(ring, ", "), F.lit("))")).alias("wkt"))


_RINGS = f"""p AS (SELECT * FROM {_POINTS}),
       v AS (SELECT label, lon, lat, row_number() OVER w AS k, count(*) OVER (PARTITION BY label) AS n FROM p WHERE vec_id % 2 = 0 WINDOW w AS (PARTITION BY label ORDER BY atan2(lat - 31.5, lon - 35.0), vec_id)),
       e AS (SELECT a.label, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM v a JOIN v b ON a.label = b.label AND b.k = a.k % a.n + 1),
       i AS (SELECT vec_id, e.label FROM p JOIN e ON (y1 > lat) <> (y2 > lat) WHERE lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query("points_in_shapes", f"WITH {_RINGS} SELECT vec_id, label AS shape FROM i")
def points_in_shapes(spark, sf):
    """All places within ragged shapes of many corners, whose corners are places, too."""
    points = _points(spark, sf)
    return V.point_in_polygon(points.drop("label"), _shapes(points).withColumnRenamed("label", "shape")).select("vec_id", "shape")


@query("points_per_shape", f"WITH {_RINGS} SELECT l.label, count(i.label) AS points FROM (SELECT DISTINCT label FROM p WHERE vec_id % 2 = 0) l LEFT JOIN i USING (label) GROUP BY 1")
def points_per_shape(spark, sf):
    points = _points(spark, sf)
    return V.points_per_polygon(points.select("lon", "lat"), _shapes(points), "label")


@query("bbox_filter", f"SELECT vec_id FROM {_POINTS} WHERE lon BETWEEN 34.95 AND 35.05 AND lat BETWEEN 31.45 AND 31.55")
def bbox_filter(spark, sf):
    from silthouse.operators.archive import in_bbox

    return _points(spark, sf).filter(in_bbox(F.col("lon"), F.col("lat"), 34.95, 31.45, 35.05, 31.55)).select("vec_id")


@query("self_orienting_points", f"SELECT vec_id, round(lon, 6) AS lon, round(lat, 6) AS lat, CASE WHEN vec_id % 2 = 0 THEN 'degrees' ELSE 'swapped' END AS kind FROM {_POINTS}")
def self_orienting_points(spark, sf):
    rows = _points(spark, sf)
    even = F.col("vec_id") % 2 == 0
    p = P.oriented(F.when(even, F.col("lon")).otherwise(F.col("lat")), F.when(even, F.col("lat")).otherwise(F.col("lon")))
    return rows.select("vec_id", p.alias("p")).select("vec_id", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"), "p.kind")


# increments ---------------------------------------------------------------------------------


@query("rolling_budget", "SELECT event_id, CAST(sum(CAST(value * 100 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM events")
def rolling_budget(spark, sf):
    rows = load(spark, sf, "events").select("event_id", "user_id", "ts", F.expr("CAST(round(value * 100) AS BIGINT)").alias("cents"))
    return I.rolling_sum(rows, ["user_id"], "ts", "cents").select("event_id", "used")


@query(
    "generation_window_dedup",
    """WITH g AS (SELECT DISTINCT user_id, event_type, CAST(date_diff('day', DATE '2024-01-01', ts::DATE) AS BIGINT) AS gen FROM events), l AS (SELECT *, lag(gen) OVER (PARTITION BY user_id, event_type ORDER BY gen) AS last FROM g)
       SELECT user_id, event_type, gen FROM l WHERE last IS NULL OR gen - last >= 5""",
)
def generation_window_dedup(spark, sf):
    rows = load(spark, sf, "events").select("user_id", "event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("gen"))
    return I.generation_window(rows, ["user_id", "event_type"], "gen", 5)


@query("tumbling_windows", "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    rows = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return I.event_windows(rows, "ts", "6 hours", keys=["event_type"]).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query(
    "session_windows",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
       SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def session_windows(spark, sf):
    rows = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return I.sessions(rows, "ts", "12 hours", ["user_id"]).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("resumable_ingest", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def resumable_ingest(spark, sf):
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    events = load(spark, sf, "events").select("event_id", "event_type")
    events.unionByName(events).repartition(3).write.parquet(f"{root}/in")
    for _ in range(2):  # the second run finds nothing new
        I.ingest(I.file_stream(spark, f"{root}/in", events.schema, 1), f"{root}/out", f"{root}/checkpoint", ["event_id"]).awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("incremental_overlap", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 48 HOURS")
def incremental_overlap(spark, sf):
    rows = load(spark, sf, "events")
    return I.since(rows, "ts", F.lit("2024-01-20").cast(rows.schema["ts"].dataType)).select("event_id")


@query("hit_rate_breaker", "SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS hits, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS rate FROM events")
def hit_rate_breaker(spark, sf):
    return I.hit_rate(load(spark, sf, "events"), F.col("event_type") == "click").withColumn("rate", F.round("rate", 6))


@query("pending_queue", "SELECT conv_id, max(turn) AS turn, conv_id % 2 = 0 AS refresh FROM conversations GROUP BY 1 HAVING conv_id % 2 = 1 OR max(turn) > 1")
def pending_queue(spark, sf):
    latest = load(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    loaded = latest.filter("conv_id % 2 = 0").select("conv_id", F.lit(1).cast("long").alias("turn"), F.lit(0).alias("attempts"))
    return I.pending(latest, loaded, "conv_id", "turn", "attempts")


@query("console_functions", "SELECT n_nationkey, lower(regexp_replace(n_name, '[^0-9A-Za-z]+', '', 'g')) AS key, concat_ws('-', n_nationkey, 0, n_regionkey) AS parcel FROM nation")
def console_functions(spark, sf):
    register(spark)
    load(spark, sf, "nation").createOrReplaceTempView("sh_nation")
    return spark.sql("SELECT n_nationkey, sh_norm(n_name) AS key, sh_parcel_key(n_nationkey, NULL, n_regionkey) AS parcel FROM sh_nation")
