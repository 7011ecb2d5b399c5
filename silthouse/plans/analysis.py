"""Queries that profile, group, rank and ask structured questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from silthouse.functions import text as T
from silthouse.operators import profile as P
from silthouse.operators import semantic as S
from silthouse.operators.resolve import rank_in
from silthouse.plans.registry import query
from silthouse.session import TABLES, load

_MONEY = "decimal(18,2)"


_PROFILED = {"l_orderkey": True, "l_partkey": True, "l_suppkey": True, "l_linenumber": True, "l_quantity": True, "l_extendedprice": True, "l_discount": True, "l_tax": True, "l_returnflag": False, "l_linestatus": False, "l_shipdate": False}


def _profiled(c: str, number: bool) -> str:
    value = c if number else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS filled, CAST({int(number)} AS DOUBLE) AS numeric_share, CAST(min({value}) AS DOUBLE) AS min, CAST(max({value}) AS DOUBLE) AS max, round(avg({value}), 4) AS avg FROM lineitem"""


@query("column_profile", " UNION ALL ".join(_profiled(c, n) for c, n in _PROFILED.items()))
def column_profile(spark, sf):
    return P.profile(load(spark, sf, "lineitem")).select("column", "rows", "filled", "numeric_share", "min", "max", F.round("avg", 4).alias("avg"))


@query("distinct_estimates", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values, true AS near FROM orders""" for c in ("o_custkey", "o_orderdate", "o_orderpriority")))
def distinct_estimates(spark, sf):
    """Estimates of a profile next to exact counts: near where they differ by a tenth at most."""
    names, rows = ("o_custkey", "o_orderdate", "o_orderpriority"), load(spark, sf, "orders")
    exact = rows.agg(*(F.countDistinct(c).alias(c) for c in names)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct_values")) for c in names))).alias("x")).select("x.*")
    return P.profile(rows, list(names)).join(exact, "column").select("column", "distinct_values", (F.abs(F.col("distinct_estimate") - F.col("distinct_values")) <= F.col("distinct_values") / 10).alias("near"))


@query("top_values", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def top_values(spark, sf):
    return P.top_values(load(spark, sf, "part"), "p_type")


@query(
    "keywords",
    """SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS word FROM documents)
       WHERE length(word) >= 3 AND word NOT IN ('the','and','of','to','in','is','it','for','that','was','with','this','are','be','by','or','at','as','on','an','de','la','der','die','und')
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""",
)
def keywords(spark, sf):
    return P.keywords(load(spark, sf, "documents"), "text")


def _kind_of(table: str, c: str) -> str:
    """SQL for what all filled values of a column are."""
    text = f"trim(CAST({c} AS VARCHAR))"
    return f"""SELECT '{c}' AS "column", CASE WHEN bool_and(regexp_matches({text}, '^[+-]?[0-9]+$')) THEN 'integer' WHEN bool_and(TRY_CAST({text} AS DOUBLE) IS NOT NULL) THEN 'numeric'
       WHEN bool_and(TRY_CAST({text} AS TIMESTAMP) IS NOT NULL AND regexp_matches({text}, '^[0-9]{{4}}-')) THEN 'date' ELSE 'text' END AS kind FROM {table} WHERE {text} <> ''"""


_TYPED = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")}


@query("type_inference", " UNION ALL ".join(_kind_of(t, c) for t, columns in _TYPED.items() for c in columns))
def type_inference(spark, sf):
    """Of every column of two tables, all of it as text."""
    found = {}
    for t, columns in _TYPED.items():
        found |= P.infer_types(load(spark, sf, t).select(*(F.col(c).cast("string").alias(c) for c in columns)))
    return spark.createDataFrame(list(found.items()), "column string, kind string")


_PATTERNS = {"d/M/yyyy": "%d/%m/%Y", "M/d/yyyy": "%m/%d/%Y", "yyyy-MM-dd": "%Y-%m-%d", "d.M.yyyy": "%d.%m.%Y", "d/M/yyyy HH:mm": "%d/%m/%Y %H:%M"}
_SHARES = " UNION ALL ".join(f"SELECT '{p}' AS pattern, avg(CAST(try_strptime(strftime(o_orderdate, '%-d/%-m/%Y'), '{f}') IS NOT NULL AS INTEGER)) AS share FROM orders" for p, f in _PATTERNS.items())


@query("date_format_detection", f"SELECT pattern, share FROM ({_SHARES}) WHERE share >= 0.8")
def date_format_detection(spark, sf):
    rows = load(spark, sf, "orders").select(F.date_format("o_orderdate", "d/M/yyyy").alias("day"))
    return spark.createDataFrame(P.date_formats(rows, "day"), "pattern string, share double")


_KEYS = ("o_orderkey", "o_custkey", "o_orderstatus")


@query("candidate_key", " UNION ALL ".join(f"""SELECT '{c}' AS "column" FROM orders HAVING count(DISTINCT {c}) >= 0.99 * count(*) AND count({c}) >= 0.99 * count(*)""" for c in _KEYS))
def candidate_key(spark, sf):
    rows = load(spark, sf, "orders")
    exact = rows.agg(*(F.countDistinct(c).alias(c) for c in _KEYS), F.count(F.lit(1)).alias("n"))
    flat = exact.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("d")) for c in _KEYS))).alias("p"))
    own = flat.select("p.column", (F.col("p.d") / F.col("n")).alias("distinct_ratio"), F.lit(1.0).alias("fill_rate"))
    return own.filter(P.candidate_key(own)).select("column")


_FLAGGED = {"has_date": "date|(^|_)(dt|yr)($|_)|year", "has_locality": "(^|[^a-z])(city|town|locality)", "has_geometry": "geometry|_wkt$|(^|[^a-z])(lat|lon|lng)($|[^a-z])", "has_parcel": "(^|[^a-z])(gush|parcel|helka)"}


@query("field_flags", " UNION ALL ".join(f"""SELECT table_name AS "table", '{k}' AS flag, bool_or(regexp_matches(lower(column_name), '{p}')) AS found FROM information_schema.columns WHERE table_name IN {TABLES} GROUP BY 1""" for k, p in _FLAGGED.items()))
def field_flags(spark, sf):
    """What the names of each table's columns say of it."""
    flags = {t: P.name_flags(load(spark, sf, t).columns) for t in TABLES}
    return spark.createDataFrame([(t, k, f[k]) for t, f in flags.items() for k in _FLAGGED], "table string, flag string, found boolean")


@query("entity_guess", "SELECT * FROM (VALUES ('n_name', 'locality'), ('o_orderdate', 'date'), ('o_orderkey', 'id'), ('o_totalprice', 'amount')) AS t(\"column\", guess)")
def entity_guess(spark, sf):
    names = [r.value for r in P.top_values(load(spark, sf, "nation"), "n_name", 10).collect()]
    places = {r.n_name.lower() for r in load(spark, sf, "nation").select("n_name").collect()}
    rows = [("n_name", P.entity_guess("text", "n_name", names, places)), ("o_orderdate", P.entity_guess("date", "o_orderdate", [], places)), ("o_orderkey", P.entity_guess("integer", "o_orderkey", ["1"], places)), ("o_totalprice", P.entity_guess("numeric", "o_totalprice", ["1"], places))]
    return spark.createDataFrame(rows, "column string, guess string")


# structured questions -----------------------------------------------------------------------

MODEL = {
    "orders": S.Entity(
        "orders", "orders",
        (S.Dimension("status", "o_orderstatus"), S.Dimension("priority", "o_orderpriority"), S.Dimension("price", "o_totalprice", "number"), S.Dimension("date", "o_orderdate", "date"), S.Dimension("id", "o_orderkey", groupable=False)),
        (S.Enrich("customer", "customer", "o_custkey", "c_custkey", ("c_mktsegment", "c_nationkey")),),
    ),
}


def _ask(spark, sf, **question):
    return S.compiled(MODEL, {t: load(spark, sf, t) for t in ("orders", "customer")}, S.Question("orders", **question))


@query("semantic_groupby_month", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price FROM orders GROUP BY 1")
def semantic_groupby_month(spark, sf):
    return _ask(spark, sf, measures=["count", "sum:price"], dimensions=["date"]).withColumn("sum_price", F.round("sum_price", 2))


@query(
    "semantic_filters",
    """SELECT o_orderstatus AS status, count(*) AS count, max(o_totalprice) AS max_price FROM orders
       WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate::DATE >= DATE '1996-03-01' AND o_orderstatus <> 'P' AND o_orderpriority ILIKE '%h%' GROUP BY 1""",
)
def semantic_filters(spark, sf):
    filters = [("price", "between", [1000, 200000]), ("priority", "in", ["1-URGENT", "2-HIGH"]), ("date", ">=", "1996-03-01"), ("status", "!=", "P"), ("priority", "contains", "h"), ("status", "not_null")]
    return _ask(spark, sf, measures=["count", "max:price"], dimensions=["status"], filters=filters)


@query("semantic_enrich", "SELECT c_mktsegment AS customer_c_mktsegment, o_orderstatus AS status, count(*) AS count FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def semantic_enrich(spark, sf):
    return _ask(spark, sf, dimensions=["status"], enrich=["customer.c_mktsegment"])


@query("global_aggregate", "SELECT count(*) AS count, CAST(avg(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2))::DOUBLE AS avg_price FROM orders")
def global_aggregate(spark, sf):
    return _ask(spark, sf, measures=["count", "avg:price"]).withColumn("avg_price", F.round("avg_price", 2))


@query(
    "fan_trap_cross",
    """SELECT coalesce(a.k, b.k) AS nation, a.customers, b.suppliers, n.n_name AS name FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) a
       FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.k = b.k LEFT JOIN nation n ON n.n_nationkey = coalesce(a.k, b.k)""",
)
def fan_trap_cross(spark, sf):
    a = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    b = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    names = load(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    return S.cross(a, b, "nation").join(names, "nation", "left")


@query("join_coverage", "SELECT count(DISTINCT o_custkey) AS values, count(DISTINCT CASE WHEN c_custkey IS NOT NULL THEN o_custkey END) AS healed FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 12) ON o_custkey = c_custkey")
def join_coverage(spark, sf):
    known = load(spark, sf, "customer").filter("c_nationkey < 12").select("c_custkey")
    return load(spark, sf, "orders").select("o_custkey").distinct().join(known, F.col("o_custkey") == F.col("c_custkey"), "left").agg(F.count("o_custkey").alias("values"), F.count("c_custkey").alias("healed"))


@query(
    "join_chain",
    """SELECT n_name, r_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def join_chain(spark, sf):
    # grouped by customer before the joins: a row for each customer meets the dimensions, not one for each order
    per = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    named = per.join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("orders"))
    own = named.join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return own.groupBy("n_name", "r_name").agg(F.sum("orders").alias("orders"))


@query("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_join(spark, sf):
    return load(spark, sf, "customer").join(load(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("double_semi_join", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def double_semi_join(spark, sf):
    own = load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    return own.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("r")).filter("a and r").select("l_orderkey")


@query("anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_join(spark, sf):
    return load(spark, sf, "part").join(load(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query(
    "correlated_counts",
    """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS done FROM customer""",
)
def correlated_counts(spark, sf):
    per = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return load(spark, sf, "customer").select("c_custkey").join(per, "c_custkey", "left").fillna(0, ["orders", "done"])


@query("using_join_of_aggregates", "SELECT y, orders, lines FROM (SELECT year(o_orderdate) AS y, count(*) AS orders FROM orders GROUP BY 1) JOIN (SELECT year(l_shipdate) AS y, count(*) AS lines FROM lineitem GROUP BY 1) USING (y)")
def using_join_of_aggregates(spark, sf):
    a = load(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("orders"))
    return a.join(load(spark, sf, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("lines")), "y")


# aggregates ---------------------------------------------------------------------------------


@query(
    "filter_aggregates",
    """SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS large, min(l_quantity) FILTER (WHERE l_discount > 0.05) AS least, bool_or(l_tax > 0.07) AS taxed, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1""",
)
def filter_aggregates(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("large"), F.min(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))).alias("least"), F.bool_or(F.col("l_tax") > 0.07).alias("taxed"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("having_filters", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND count(DISTINCT o_orderstatus) = 3")
def having_filters(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderstatus").alias("s")).filter("n > 12 and s = 3").drop("s")


@query("median_by_group", "SELECT event_type, quantile_disc(value, 0.5) AS median FROM events GROUP BY 1")
def median_by_group(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median"))


@query("coverage_percent", "SELECT lang, round(100.0 * count(*) FILTER (WHERE n_chars > 1000) / nullif(count(*), 0), 1) AS share FROM documents GROUP BY 1")
def coverage_percent(spark, sf):
    return load(spark, sf, "documents").groupBy("lang").agg(F.round(100.0 * F.count_if(F.col("n_chars") > 1000) / F.nullif(F.count(F.lit(1)), F.lit(0)), 1).alias("share"))


@query("string_aggregation", "SELECT lang, string_agg(concat(source, '=', c), ' ' ORDER BY source) AS parts FROM (SELECT lang, source, count(*) AS c FROM documents GROUP BY ALL) GROUP BY 1")
def string_aggregation(spark, sf):
    per = load(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "c"))), lambda x: F.concat_ws("=", x["source"], x["c"])), " ").alias("parts"))


@query("per_day_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def per_day_counts(spark, sf):
    return load(spark, sf, "events").filter("ts >= '2024-01-05' and ts < '2024-01-20'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("corpus_counters", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT count(DISTINCT o_custkey) FROM orders) AS buyers")
def corpus_counters(spark, sf):
    a = load(spark, sf, "orders").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("buyers"))
    return a.join(load(spark, sf, "customer").agg(F.count(F.lit(1)).alias("customers")))


@query("rollup_doorways", "SELECT l_suppkey AS zip, min(l_partkey) AS least, count(*) AS n, count(DISTINCT l_partkey) AS parts, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1")
def rollup_doorways(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("zip")).agg(F.min("l_partkey").alias("least"), F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))


@query("left_join_counts", "SELECT n_name, count(s_suppkey) AS suppliers, count(DISTINCT CASE WHEN s_acctbal < 0 THEN s_suppkey END) AS indebted FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def left_join_counts(spark, sf):
    per = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"), F.count_if(F.col("s_acctbal") < 0).alias("indebted"))
    return load(spark, sf, "nation").join(per, "n_nationkey", "left").select("n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("indebted", F.lit(0)).alias("indebted"))


@query("json_props_facet", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY 1")
def json_props_facet(spark, sf):
    return load(spark, sf, "events").groupBy((F.get_json_object("props", "$.k").cast("long") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("derived_case_facet", "SELECT CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 5000 THEN 'medium' ELSE 'large' END AS band, count(*) AS n FROM documents GROUP BY 1")
def derived_case_facet(spark, sf):
    band = F.when(F.col("n_chars") < 500, "small").when(F.col("n_chars") < 5000, "medium").otherwise("large")
    return load(spark, sf, "documents").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "feedback_report",
    "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS likes, count(*) FILTER (WHERE event_type = 'view') AS dislikes, count(*) AS total FROM events GROUP BY 1",
)
def feedback_report(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("likes"), F.count_if(F.col("event_type") == "view").alias("dislikes"), F.count(F.lit(1)).alias("total"))


# windows ------------------------------------------------------------------------------------


@query("latest_edition_rank", "SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_edition_rank(spark, sf):
    rows = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rows.withColumn("r", rank_in(["o_custkey"], F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc())).filter("r = 1").select("o_custkey", "o_orderkey")


@query("format_preference", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, turn) AS n FROM conversations) WHERE n = 1")
def format_preference(spark, sf):
    tier = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    rows = load(spark, sf, "conversations").select("conv_id", "turn", "role", tier.alias("tier"))
    return rows.groupBy("conv_id").agg(F.min(F.struct("tier", "turn", "role")).alias("b")).select("conv_id", "b.turn", "b.role")


@query("latest_version_per_dataset", "SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role FROM conversations GROUP BY 1")
def latest_version_per_dataset(spark, sf):
    return load(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("duplicate_rows_removed", "SELECT min(doc_id) AS doc_id, source, lang, n_chars FROM documents GROUP BY 2, 3, 4")
def duplicate_rows_removed(spark, sf):
    return load(spark, sf, "documents").groupBy("source", "lang", "n_chars").agg(F.min("doc_id").alias("doc_id"))


@query(
    "best_n_per_group",
    """SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY n) AS top FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 5 GROUP BY 1""",
)
def best_n_per_group(spark, sf):
    own = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey"))
    rows = load(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(own).alias("n")).filter("n <= 5")
    return rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("top"))


@query(
    "rename_and_dedup",
    """SELECT o_custkey, status, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, status ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS n
       FROM (SELECT *, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'closed' ELSE o_orderstatus END AS status FROM orders)) WHERE n = 1""",
)
def rename_and_dedup(spark, sf):
    rows = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus").isin("F", "P"), "closed").otherwise(F.col("o_orderstatus")).alias("status"))
    best = rows.groupBy("o_custkey", "status").agg(F.min(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey")).alias("b"))
    return best.select("o_custkey", "status", "b.o_orderkey")


# scalar functions ---------------------------------------------------------------------------


@query("ols_fit", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY 1")
def ols_fit(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("r"))


@query("norm_keys", "SELECT n_nationkey, lower(regexp_replace(n_name, '[^0-9A-Za-z]+', '', 'g')) AS key FROM nation")
def norm_keys(spark, sf):
    return load(spark, sf, "nation").select("n_nationkey", T.norm(F.col("n_name")).alias("key"))


@query("parcel_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n, concat_ws('-', l_orderkey, 0, l_linenumber) AS key FROM lineitem GROUP BY ALL")
def parcel_keys(spark, sf):
    rows = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("key", T.parcel_key(F.concat(F.col("l_orderkey").cast("string"), F.lit(".0")), F.lit(None).cast("string"), F.col("l_linenumber").cast("string")))


@query(
    "url_identity",
    """SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')
         || CASE WHEN contains(url, 'page=') THEN '?' || regexp_extract(url, '(page=[^&#]*)', 1) ELSE '' END AS identity FROM pages""",
)
def url_identity(spark, sf):
    return load(spark, sf, "pages").select("page_id", T.url_identity(F.col("url")).alias("identity"))


@query("month_buckets", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1")
def month_buckets(spark, sf):
    return load(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("cell_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b, strftime(o_orderdate, '%Y-%m-%d') AS c FROM orders")
def cell_dates(spark, sf):
    day = F.to_date("o_orderdate")
    serial = (F.datediff(day, F.lit("1970-01-01").cast("date")) + 25569).cast("string")
    forms = {"a": serial, "b": F.date_format(day, "d.M.yyyy"), "c": F.concat(F.lit("on "), F.date_format(day, "dd/MM/yy"), F.lit(" at noon"))}
    shifted = {k: T.sheet_date(v) for k, v in forms.items()}
    # two-digit years are of this century
    shifted["c"] = F.when(F.year(day) < 2000, F.add_months(shifted["c"], -1200)).otherwise(shifted["c"])
    return load(spark, sf, "orders").select("o_orderkey", *(F.date_format(v, "yyyy-MM-dd").alias(k) for k, v in shifted.items()))
