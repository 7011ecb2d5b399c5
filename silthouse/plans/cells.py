"""Queries that parse, compare and rank single values: names, numbers, times, identities, shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from silthouse.functions import identity as H
from silthouse.functions import text as T
from silthouse.operators import archive as A
from silthouse.operators import profile as P
from silthouse.operators import resolve as R
from silthouse.operators import search as S
from silthouse.operators import spatial as G
from silthouse.plans.registry import query
from silthouse.session import load

_C = F.col


# names --------------------------------------------------------------------------------------


@query("names_without_parens", "SELECT c_custkey, c_name || ' ' || c_nationkey AS name FROM customer")
def names_without_parens(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", T.no_parens(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")  "), _C("c_nationkey").cast("string"))).alias("name"))


@query("street_types", "SELECT c_custkey, CASE WHEN c_nationkey < 10 AND c_custkey % 2 = 0 THEN 'road ' || c_nationkey WHEN c_custkey % 2 = 0 THEN 'N' || c_nationkey ELSE c_mktsegment END AS name FROM customer")
def street_types(spark, sf):
    """A type goes only where three characters are left."""
    short = F.concat(F.lit("road "), F.when(_C("c_nationkey") >= 10, "N").otherwise(""), _C("c_nationkey").cast("string"))
    name = F.when(_C("c_custkey") % 2 == 0, short).otherwise(F.concat(F.lit("high road "), _C("c_mktsegment")))
    return load(spark, sf, "customer").select("c_custkey", T.strip_type(name, ["road", "high road"]).alias("name"))


@query(
    "house_numbers",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN CAST(c_custkey AS INTEGER) END AS house, CASE WHEN c_custkey % 3 = 0 THEN chr(CAST(97 + c_nationkey AS INTEGER)) END AS suffix FROM customer""",
)
def house_numbers(spark, sf):
    k, letter = _C("c_custkey").cast("string"), F.char(97 + _C("c_nationkey"))
    door = F.when(_C("c_custkey") % 3 == 0, F.concat(k, letter, F.lit(" Elm Street"))).when(_C("c_custkey") % 3 == 1, F.concat(F.lit("Elm Street "), k)).otherwise(F.lit("Elm Street"))
    return load(spark, sf, "customer").select("c_custkey", T.house_number(door).alias("house"), T.house_suffix(door).alias("suffix"))


@query(
    "name_tokens",
    """WITH t AS (SELECT p_partkey, list_sort(string_split(p_name, ' ') || [lower(p_type)]) AS w FROM part)
       SELECT p_partkey, array_to_string(w, ' ') AS tokens, substr(list_extract(list_sort(list_transform(w, lambda x: lpad(CAST(99 - length(x) AS VARCHAR), 2, '0') || x)), 1), 3, 2) AS block FROM t""",
)
def name_tokens(spark, sf):
    raw = F.concat(F.lit("Dr "), F.initcap("p_name"), F.lit("-'"), _C("p_type"), F.lit("' Ltd"))
    tokens = T.name_tokens(raw, organisation=True)
    return load(spark, sf, "part").select("p_partkey", F.array_join(tokens, " ").alias("tokens"), T.block_key(tokens).alias("block"))


_PAIRS = """(SELECT p.p_partkey, p.p_name AS a, q.p_name AS b, list_sort(string_split(p.p_name, ' ')) AS x, list_sort(string_split(q.p_name, ' ')) AS y FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1)"""


@query(
    "name_likeness",
    f"""WITH s AS (SELECT p_partkey, a, b, levenshtein(a, b) AS edits, 1 - levenshtein(array_to_string(x, ' '), array_to_string(y, ' ')) / greatest(length(a), length(b)) AS ratio,
          len(list_intersect(x, y)) / len(list_distinct(x || y)) AS shared FROM {_PAIRS})
       SELECT p_partkey, edits, round(ratio, 6) AS ratio, round(shared, 6) AS shared, round(CASE WHEN a = b THEN 1 WHEN shared = 1 THEN 0.97 ELSE least(1, 0.6 * ratio + 0.4 * shared) END, 6) AS score FROM s""",
)
def name_likeness(spark, sf):
    own = load(spark, sf, "part").select("p_partkey", _C("p_name").alias("a"))
    pairs = own.join(own.select((_C("p_partkey") - 1).alias("p_partkey"), _C("a").alias("b")), "p_partkey")
    x, y = T.name_tokens(_C("a")), T.name_tokens(_C("b"))
    return pairs.select(
        "p_partkey", F.levenshtein("a", "b").alias("edits"), F.round(T.token_sort_ratio(x, y), 6).alias("ratio"), F.round(T.jaccard(x, y), 6).alias("shared"), F.round(T.similarity(_C("a"), _C("b"), x, y), 6).alias("score")
    )


@query(
    "spelling_swaps",
    """WITH a AS (SELECT DISTINCT replace(p_name, ' ', '') AS v FROM part),
       one AS (SELECT v, i, left(v, i - 1) || translate(v[i], 'ei', 'ie') || substr(v, i + 1) AS w FROM (SELECT v, unnest(range(1, length(v) + 1)) AS i FROM a) WHERE v[i] IN ('e', 'i')),
       two AS (SELECT v, left(w, j - 1) || translate(w[j], 'ei', 'ie') || substr(w, j + 1) AS w FROM (SELECT v, w, i, unnest(range(i + 1, length(v) + 1)) AS j FROM one) WHERE w[j] IN ('e', 'i')),
       m AS (SELECT v, w FROM one UNION SELECT v, w FROM two)
       SELECT w AS variant, min(v) AS code, 30 AS weight FROM m WHERE w NOT IN (SELECT v FROM a) GROUP BY w HAVING count(DISTINCT v) = 1""",
)
def spelling_swaps(spark, sf):
    names = load(spark, sf, "part").select(T.norm(_C("p_name")).alias("variant")).distinct()
    return R.spelling_swaps(names.withColumn("code", _C("variant")), "e", "i")


@query("best_aliases", "SELECT lower(l_returnflag) AS variant, l_suppkey AS code, max(l_linenumber) AS weight, arg_min(l_linestatus, (-l_linenumber, l_linestatus)) AS kind FROM lineitem GROUP BY ALL")
def best_aliases(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.lower("l_returnflag").alias("variant"), _C("l_suppkey").alias("code"), _C("l_linestatus").alias("kind"), _C("l_linenumber").alias("weight"))
    return R.best_alias(rows, ["variant", "code"])


# numbers, times, flags ----------------------------------------------------------------------


@query("parsed_numbers", "SELECT l_orderkey AS whole, round(l_extendedprice, 2) AS price, CAST(NULL AS BIGINT) AS none FROM lineitem")
def parsed_numbers(spark, sf):
    price = F.concat(F.lit("NIS "), F.format_number("l_extendedprice", 2), F.lit(" net"))
    whole = F.concat(F.lit(" 00"), _C("l_orderkey").cast("string"), F.lit(".0"))
    return load(spark, sf, "lineitem").select(T.as_int(whole).alias("whole"), T.number(price).cast("double").alias("price"), T.as_int(F.concat(whole, F.lit("5"))).alias("none"))


@query(
    "numeric_texts",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS numeric, CASE p_partkey % 4 WHEN 0 THEN -round(p_retailprice, 2) WHEN 1 THEN CAST(p_partkey * 1000 AS DOUBLE) END AS value FROM part",
)
def numeric_texts(spark, sf):
    k = _C("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("-"), F.format_number("p_retailprice", 2))).when(k == 1, F.concat(F.lit(" "), F.format_number(_C("p_partkey") * 1000, 0))).when(k == 2, _C("p_name")).otherwise(F.lit(" "))
    return load(spark, sf, "part").select("p_partkey", P.numeric_text(text).alias("numeric"), P.numeric_value(text).alias("value"))


@query("cell_times", "SELECT event_id, strftime(ts, '%H:%M') AS clock, strftime(ts, '%H:%M') AS fraction, strftime(ts, '%H:00') AS hour, CAST(NULL AS VARCHAR) AS none FROM events")
def cell_times(spark, sf):
    minute = F.hour("ts") * 60 + F.minute("ts")
    forms = {"clock": F.date_format("ts", "H:mm:ss"), "fraction": F.format_string("%.6f", minute / 1440), "hour": F.hour("ts").cast("string"), "none": F.concat(F.lit("at "), F.date_format("ts", "HH:mm"))}
    return load(spark, sf, "events").select("event_id", *(T.sheet_time(c).alias(n) for n, c in forms.items()))


@query("typed_cells", "SELECT o_orderkey AS n, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice, 2) END AS price, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS note FROM orders")
def typed_cells(spark, sf):
    price = F.when(_C("o_orderkey") % 5 > 0, F.format_number("o_totalprice", 2)).otherwise("unknown")
    rows = load(spark, sf, "orders").select(F.format_number("o_orderkey", 0).alias("n"), price.alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("day"), _C("o_orderpriority").alias("note"))
    return P.typed(rows, {"n": "integer", "price": "numeric", "day": "date", "note": "text"})


@query("flagged_events", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 < 2")
def flagged_events(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 3
    flag = F.get_json_object(F.to_json(F.struct(F.when(k == 0, "True").when(k == 1, "1").otherwise("no").alias("flag"))), "$.flag")
    return load(spark, sf, "events").filter(A.truthy(flag)).select("event_id")


# identities ---------------------------------------------------------------------------------


@query(
    "row_identities",
    """SELECT c_custkey, sha256(to_json(struct_pack(c_acctbal := CAST(c_acctbal AS VARCHAR), c_custkey := CAST(c_custkey AS VARCHAR), c_mktsegment := CASE WHEN c_nationkey > 4 THEN c_mktsegment ELSE '' END, c_name := c_name))) AS by_name,
         md5(concat_ws(chr(31), c_custkey, c_name)) AS repaired FROM customer""",
)
def row_identities(spark, sf):
    """The order of columns, the stamp, and null or empty make no difference; nor does a tail of .0 for the repair."""
    rows = load(spark, sf, "customer").select("c_name", "c_custkey", F.when(_C("c_nationkey") > 4, _C("c_mktsegment")).alias("c_mktsegment"), "c_acctbal", F.current_timestamp().alias("seen"))
    repaired = rows.withColumn("c_custkey", F.concat(_C("c_custkey").cast("string"), F.lit(".0")))
    own = rows.select("c_custkey", H.row_hash(rows.columns, "seen").alias("by_name"))
    return own.join(repaired.select(F.regexp_replace("c_custkey", r"\.0$", "").cast("long").alias("c_custkey"), H.repair_hash(["c_custkey", "c_name"]).alias("repaired")), "c_custkey")


@query("table_signatures", "SELECT 'nation' AS name, substr(sha256('25|n_nationkey:int|n_name:string|n_regionkey:int'), 1, 16) AS signature UNION ALL SELECT 'region', substr(sha256((SELECT count(*) FROM region) || '|r_regionkey:int|r_name:string'), 1, 16)")
def table_signatures(spark, sf):
    tables = {t: load(spark, sf, t) for t in ("nation", "region")}
    return spark.createDataFrame([(t, H.table_signature(df, df.count())) for t, df in tables.items()], "name string, signature string")


# words --------------------------------------------------------------------------------------


@query(
    "clitic_tokens",
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
       b AS (SELECT doc_id, list_distinct(w || list_transform(list_filter(w, lambda x: length(x) > 3), lambda x: x[2:])) AS t FROM w)
       SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS words FROM b""",
)
def clitic_tokens(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", T.clitic_tokens(_C("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("words"))


_LATIN, _HEBREW = "abcdefghijklmnopqrstuv", "אבגדהוזחטיכלמנסעפצקרשת"


@query(
    "word_skeletons",
    rf"""WITH w AS (SELECT DISTINCT translate(unnest(regexp_extract_all(lower(text), '[a-v]+')), '{_LATIN}', '{_HEBREW}') AS word FROM documents),
       p AS (SELECT word, regexp_replace(word, '^(?:הת|מת|[מנתה])(.{{3,}})$', '\1') AS s FROM w), e AS (SELECT word, regexp_replace(s, '^(.{{2,}}?)(?:יות|ות|ים|ין|[יוהםן])$', '\1') AS s FROM p)
       SELECT s[1] || replace(replace(s[2:], 'י', ''), 'ו', '') AS skeleton, count(*) AS words, min(word) AS first, max(word) AS last FROM e GROUP BY 1""",
)
def word_skeletons(spark, sf):
    """Words in Hebrew letters, one for each Latin one."""
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-v]+"), F.lit(0)))
    words = load(spark, sf, "documents").select(found.alias("w")).distinct().select(F.translate("w", _LATIN, _HEBREW).alias("word"))
    return words.groupBy(T.skeleton(_C("word")).alias("skeleton")).agg(F.count(F.lit(1)).alias("words"), F.min("word").alias("first"), F.max("word").alias("last"))


@query(
    "result_kinds",
    """WITH r AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey >= 900 THEN 'x' ELSE '' END AS late, o_orderstatus, o_orderdate, strftime(o_orderdate, '%m/%d/%Y') AS american, strftime(o_orderdate, '%d.%m.%Y') AS local, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000),
       v AS (SELECT o_orderkey AS k, unnest([['key', CAST(o_orderkey AS VARCHAR)], ['late', late], ['status', o_orderstatus], ['ordered', CAST(o_orderdate AS VARCHAR)], ['american', american], ['local', local], ['price', CAST(o_totalprice AS VARCHAR)], ['none', NULL]]) AS x FROM r),
       f AS (SELECT x[1] AS "column", x[2] AS value FROM v QUALIFY row_number() OVER (PARTITION BY x[1], x[2] IS NULL ORDER BY k) <= 60)
       SELECT "column", CASE WHEN count(value) = 0 THEN 'text' WHEN bool_and(regexp_matches(value, '^-?[0-9]+([.][0-9]+)?$')) THEN 'number'
         WHEN bool_and(coalesce(try_strptime(value[1:10], '%Y-%m-%d'), try_strptime(value, '%m/%d/%Y'), try_strptime(value, '%m.%d.%Y')) IS NOT NULL) THEN 'date' ELSE 'text' END AS kind FROM f GROUP BY 1""",
)
def result_kinds(spark, sf):
    late = F.concat(_C("o_orderkey").cast("string"), F.when(_C("o_orderkey") >= 900, "x").otherwise(""))
    day = lambda f: F.date_format("o_orderdate", f)
    columns = [_C("o_orderkey").alias("key"), late.alias("late"), _C("o_orderstatus").alias("status"), _C("o_orderdate").alias("ordered"), day("MM/dd/yyyy").alias("american"), day("dd.MM.yyyy").alias("local"), _C("o_totalprice").alias("price"), F.lit(None).cast("string").alias("none")]
    return P.result_kinds(load(spark, sf, "orders").select(*columns).orderBy("key"))


@query("decoded_lists", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS first FROM customer")
def decoded_lists(spark, sf):
    kept = F.when(_C("c_custkey") % 3 == 0, F.to_json(F.array("c_name", "c_mktsegment"))).when(_C("c_custkey") % 3 == 1, F.lit("no list"))
    return load(spark, sf, "customer").withColumn("t", T.decoded_list(kept)).select("c_custkey", F.size("t").alias("n"), F.try_element_at("t", F.lit(1)).alias("first"))


@query(
    "lexical_relevance",
    """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS s, [lower(p_type), 'steel'] AS a, ['small', 'ring', 'economy', 'steel', 'cheap'] AS q FROM part),
       h AS (SELECT p_partkey, len(list_intersect(q, s)) AS hs, len(list_intersect(q, a)) AS ha, len(list_intersect(q, list_distinct(s || a))) AS found FROM w)
       SELECT p_partkey, round((3.0 * hs + least(ha, 3.0 * hs)) * found / 5, 6) AS score FROM h""",
)
def lexical_relevance(spark, sf):
    asked = F.array(*map(F.lit, ("small", "ring", "economy", "steel", "cheap")))
    score = S.relevance(asked, F.split("p_name", " "), F.array(F.lower("p_type"), F.lit("steel")))
    return load(spark, sf, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("relevance_order", "SELECT p_partkey, p_name FROM part ORDER BY p_type = 'ECONOMY' DESC, p_brand = 'Brand#1' ASC, round(p_retailprice / 1000, 3) DESC, p_size DESC, p_partkey DESC LIMIT 25")
def relevance_order(spark, sf):
    rows = S.tiered(load(spark, sf, "part"), _C("p_type") == "ECONOMY", _C("p_brand") == "Brand#1", _C("p_retailprice") / 1000, _C("p_size"), "p_partkey")
    return rows.limit(25).select("p_partkey", "p_name")


@query("query_string_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def query_string_filters(spark, sf):
    rows = load(spark, sf, "orders")
    asked = A.from_query_string({"o_orderstatus": "F", "o_orderpriority": "5-LOW", "limit": "3", "sort": "o_orderkey", "o_custkey": "", "unknown": "x"})
    return rows.filter(A.columns_equal(rows, asked)).select("o_orderkey")


@query("datastore_search", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_nationkey IN (3, 5, 7) AND (c_name ILIKE '%00%' OR c_mktsegment ILIKE '%00%') ORDER BY c_nationkey DESC, c_mktsegment LIMIT 10 OFFSET 2")
def datastore_search(spark, sf):
    return A.search(load(spark, sf, "customer"), ["c_mktsegment", "c_nationkey", "nothing"], {"c_nationkey": [3, 5, 7]}, "00", "c_nationkey desc, c_mktsegment", 10, 2, True)


# shapes -------------------------------------------------------------------------------------


@query("grid_round_trip", "SELECT o_orderkey, 34.2 + o_orderkey % 150 / 100 AS lon, 29.5 + o_orderkey % 370 / 100 AS lat FROM orders")
def grid_round_trip(spark, sf):
    """Degrees to grid metres and back, to a hundredth of a second of arc."""
    rows = load(spark, sf, "orders").select("o_orderkey", (34.2 + _C("o_orderkey") % 150 / 100).alias("lon"), (29.5 + _C("o_orderkey") % 370 / 100).alias("lat"))
    grid = rows.withColumn("g", G.to_grid(_C("lon"), _C("lat")))
    return grid.withColumn("p", G.from_grid(_C("g.x"), _C("g.y"))).select("o_orderkey", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query("shape_kinds", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'degrees' WHEN 1 THEN 'grid' END AS kind FROM supplier")
def shape_kinds(spark, sf):
    k = _C("s_suppkey") % 3
    x = F.when(k == 0, "34.81").when(k == 1, "182345.5").otherwise("-71.05")
    return load(spark, sf, "supplier").select("s_suppkey", G.wkt_kind(F.format_string("POLYGON((%1$s 31.2, %1$s 31.3, 35.0 31.3, %1$s 31.2))", x)).alias("kind"))


def _box(x0, y0, x1, y1):
    return F.concat(F.lit("("), *(p for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1)) for p in (x.cast("string"), F.lit(" "), y.cast("string"), F.lit(", "))), x0.cast("string"), F.lit(" "), y0.cast("string"), F.lit(")"))


@query("interior_points", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey + 0.5 END AS lon, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey * 2 + 2.0 END AS lat FROM supplier")
def interior_points(spark, sf):
    """A square with a square hole: the middle of it is outside."""
    x, y = _C("s_suppkey"), _C("s_suppkey") * 2
    wkt = F.when(x % 4 > 0, F.concat(F.lit("POLYGON("), _box(x, y, x + 4, y + 4), F.lit(", "), _box(x + 1, y + 1, x + 3, y + 3), F.lit(")"))).otherwise(F.lit("no shape"))
    return load(spark, sf, "supplier").withColumn("p", G.interior(wkt)).select("s_suppkey", "p.lon", "p.lat")


@query("simplified_shapes", "SELECT s_suppkey, printf('POLYGON((%d 0, %d 0, %d 4, %d 4, %d 0))', s_suppkey, s_suppkey + 4, s_suppkey + 4, s_suppkey, s_suppkey) AS wkt FROM supplier")
def simplified_shapes(spark, sf):
    """A point in the middle of a side that is off by a thousandth goes."""
    x = _C("s_suppkey").cast("int")
    wkt = F.format_string("POLYGON((%d 0, %d 0.001, %d 0, %d 4, %d 4, %d 0))", x, x + 2, x + 4, x + 4, x, x)
    return load(spark, sf, "supplier").select("s_suppkey", G.simplify(wkt, 0.01).alias("wkt"))


@query(
    "feature_texts",
    """SELECT s_suppkey, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || s_suppkey / 8 || ',' || s_suppkey / 16 || ']},"properties":{"s_name":"' || s_name || '"}}' AS feature FROM supplier""",
)
def feature_texts(spark, sf):
    rows = load(spark, sf, "supplier").select("s_suppkey", "s_name", (_C("s_suppkey") / 8).alias("lon"), (_C("s_suppkey") / 16).alias("lat"))
    return rows.select("s_suppkey", G.geojson(rows.drop("s_suppkey")).alias("feature"))
