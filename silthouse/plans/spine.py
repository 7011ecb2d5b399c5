"""Queries over streets, doors, catalogs and the lists around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from silthouse.operators import catalog as C
from silthouse.operators import graph as G
from silthouse.operators import resolve as R
from silthouse.operators import spatial as P
from silthouse.operators import spine as S
from silthouse.plans.registry import query
from silthouse.session import load


@query(
    "folded_assets",
    """WITH g AS (SELECT l_suppkey AS b, l_linenumber AS p, count(*) AS assets, CAST(max(l_quantity) AS BIGINT) AS most FROM lineitem GROUP BY ALL)
       SELECT s_suppkey || '-0-' || n.p AS parcel_key, s_suppkey || '-' || n.p AS gp_key, assets, most FROM supplier, (SELECT unnest(range(1, 5)) AS p) n JOIN g ON g.p = n.p AND g.b = s_suppkey""",
)
def folded_assets(spark, sf):
    assets = load(spark, sf, "lineitem").select(F.concat(F.col("l_suppkey").cast("string"), F.lit(".0")).alias("block"), F.col("l_linenumber").cast("string").alias("parcel"), "l_quantity")
    pair = load(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("b"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("p"))
    parcels = pair.select(F.concat_ws("-0-", "b", "p").alias("parcel_key"), F.concat_ws("-", "b", "p").alias("gp_key"))
    return S.folded_assets(assets, parcels, "block", "parcel", {"assets": F.count(F.lit(1)), "most": F.max("l_quantity").cast("long")})


def _street_lists(spark, sf):
    a = load(spark, sf, "customer").select(F.col("c_nationkey").alias("town"), F.col("c_mktsegment").alias("name"))
    b = load(spark, sf, "customer").select(F.col("c_nationkey").alias("town"), F.when(F.col("c_custkey") % 3 == 0, F.initcap("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.lit("?")).otherwise("dead end").alias("name"))
    return {"list": a, "post": b}


_UNIVERSE = """(WITH s AS (SELECT c_nationkey AS town, c_mktsegment AS name, 'list' AS source FROM customer
       UNION ALL SELECT c_nationkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment[1] || lower(c_mktsegment[2:]) WHEN 1 THEN '?' ELSE 'dead end' END, 'post' FROM customer),
       g AS (SELECT town, name, source, count(*) AS n, lower(replace(name, ' ', '')) AS v FROM s WHERE name <> '?' GROUP BY ALL),
       w AS (SELECT town, v, name, max(n) AS n, bool_or(source = 'list') AS in_list, bool_or(source = 'post') AS in_post FROM g GROUP BY ALL)
       SELECT town || '|' || v AS street_key, town, arg_min(name, (-n, name)) AS name, max(n) AS n, bool_or(in_list) AS in_list, bool_or(in_post) AS in_post FROM w GROUP BY town, v)"""


@query("street_universe", f"SELECT * FROM {_UNIVERSE}")
def street_universe(spark, sf):
    return S.street_universe(_street_lists(spark, sf))


def _street_aliases(spark, sf):
    own = S.street_universe(_street_lists(spark, sf))
    return R.street_aliases(own, "town", "street_key", "name")


def _asked_streets(spark, sf):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("street "), F.lower("c_mktsegment"))).when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).otherwise("nowhere")
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("town"), name.alias("name"))


_ASKED = "SELECT c_nationkey AS town, CASE c_custkey % 3 WHEN 0 THEN 'street ' || lower(c_mktsegment) WHEN 1 THEN c_mktsegment ELSE 'nowhere' END AS name FROM customer"


@query("street_keys", f"""SELECT DISTINCT town, name, CASE WHEN name <> 'nowhere' THEN town || '|' || lower(replace(name, 'street ', '')) END AS "key" FROM ({_ASKED})""")
def street_keys(spark, sf):
    return S.street_keys(_asked_streets(spark, sf), _street_aliases(spark, sf), ["street"])


@query("unmatched_streets", f"SELECT town, name, count(*) AS rows FROM ({_ASKED}) WHERE name = 'nowhere' GROUP BY ALL")
def unmatched_streets(spark, sf):
    rows = _asked_streets(spark, sf)
    return S.unmatched_streets(rows, S.street_keys(rows, _street_aliases(spark, sf), ["street"]))


def _named_streets(spark, sf):
    """Parts as streets of towns: with a type, with brackets, with both, or plain."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("street "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" (old)"))).when(k == 2, F.concat(F.lit("Road "), "p_name", F.lit(" (new)"))).otherwise(F.initcap("p_name"))
    return load(spark, sf, "part").select(F.col("p_size").alias("town"), name.alias("name"), "p_partkey").groupBy("town", "name").agg(F.min("p_partkey").alias("key"))


_NAMED = """(SELECT p_size AS town, CASE p_partkey % 4 WHEN 0 THEN 'street ' || p_name WHEN 1 THEN p_name || ' (old)' WHEN 2 THEN 'Road ' || p_name || ' (new)'
       ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS name, min(p_partkey) AS key FROM part GROUP BY ALL)"""


def _ladder_sql(rows: str) -> str:
    """The columns of some rows (with a name) with variant, weight and place of each rung; Latin names have no article."""
    return rf"""(WITH b AS (SELECT *, lower(regexp_replace(name, '[^0-9A-Za-z]', '', 'g')) AS base, trim(regexp_replace(name, '\s*\([^)]*\)\s*', ' ', 'g')) AS free FROM {rows}),
       c AS (SELECT *, lower(regexp_replace(free, '[^0-9A-Za-z]', '', 'g')) AS bare, regexp_extract_all(lower(free), '[0-9a-z]+') AS w FROM b)
       SELECT * EXCLUDE (base, free, bare, w), r[1] AS variant, CAST(r[2] AS INT) AS weight, CAST(r[3] AS INT) AS at FROM (SELECT *, unnest([[base, '100', '0'], [bare, '90', '1'], [regexp_replace(base, '^(?:street|road|st|rd)(.{{3,}})$', '\1'), '85', '2'],
         [regexp_replace(bare, '^(?:street|road|st|rd)(.{{3,}})$', '\1'), '85', '3'], [CASE WHEN len(w) > 1 THEN array_to_string(list_sort(w), '') END, '60', '8'], [CASE WHEN len(w) > 1 AND length(w[-1]) >= 4 THEN w[-1] END, '40', '9']]) AS r FROM c) WHERE length(r[1]) > 1)"""


_SETTLED = f"""(SELECT town, variant, arg_max(key, weight) AS key, max(weight) AS weight FROM (SELECT town, variant, weight, min(key) AS key, count(DISTINCT key) AS n FROM {_ladder_sql(_NAMED)} GROUP BY ALL) GROUP BY ALL HAVING arg_max(n, weight) = 1)"""


@query("street_spellings", f"SELECT * FROM {_SETTLED}")
def street_spellings(spark, sf):
    return R.settled_streets(R.street_aliases(_named_streets(spark, sf), "town", "key", "name"))


_WANTED = """(SELECT DISTINCT p_size AS town, CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 1 THEN 'rd. ' || p_name ELSE 'the ' || split_part(p_name, ' ', 2) END AS name FROM part)"""


@query("streets_matched", f"SELECT w.town, w.name, h.key FROM {_WANTED} w LEFT JOIN (SELECT l.town, l.name, arg_min(s.key, l.at) AS key FROM {_ladder_sql(_WANTED)} l JOIN {_SETTLED} s ON s.town = l.town AND s.variant = l.variant GROUP BY ALL) h ON h.town = w.town AND h.name = w.name")
def streets_matched(spark, sf):
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", second, first)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("rd. "), "p_name")).otherwise(F.concat(F.lit("the "), second))
    settled = R.settled_streets(R.street_aliases(_named_streets(spark, sf), "town", "key", "name"))
    return R.matched_streets(load(spark, sf, "part").select(F.col("p_size").alias("town"), name.alias("name")), settled).select("town", "name", "key")


def _doors(spark, sf):
    """Customers as a list of addresses with places, orders as the postal file with zips."""
    k = F.col("c_custkey")
    listed = load(spark, sf, "customer").select(
        F.col("c_nationkey").alias("town"), F.when(k % 7 == 0, "?").otherwise(F.col("c_mktsegment")).alias("street"), F.when(k % 7 != 0, F.concat_ws("|", "c_nationkey", F.lower("c_mktsegment"))).alias("street_key"),
        F.concat((k % 50).cast("string"), F.when(k % 4 == 0, "b").otherwise("")).alias("house"), F.lit(None).cast("string").alias("entrance"), F.lit(None).cast("string").alias("zip5"), F.lit(None).cast("string").alias("zip7"),
        F.when(k % 2 == 0, k / 8).alias("lon"), F.when(k % 2 == 0, k / 16).alias("lat"), F.lit("list").alias("source"),
    )
    number = F.col("o_orderkey") % 50
    post = load(spark, sf, "orders").join(load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey").select(
        F.col("c_nationkey").alias("town"), F.col("c_mktsegment").alias("street"), F.concat_ws("|", "c_nationkey", F.lower("c_mktsegment")).alias("street_key"), number.cast("string").alias("house"), F.lit(None).cast("string").alias("entrance"),
        F.when(number < 30, (F.col("c_nationkey") % 3 + 10000).cast("string")).alias("zip5"), F.when(number < 20, F.concat((F.col("c_nationkey") + 10000).cast("string"), F.lpad(number.cast("string"), 2, "0"))).alias("zip7"),
        F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.lit("post").alias("source"),
    )
    return listed.unionByName(post)


_ROWS = """SELECT c_nationkey AS town, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS street, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey || '|' || lower(c_mktsegment) END AS street_key,
       CAST(c_custkey % 50 AS INTEGER) AS house_num, CASE WHEN c_custkey % 4 = 0 THEN 'b' END AS suffix, NULL AS zip5, NULL AS zip7, CASE WHEN c_custkey % 2 = 0 THEN c_custkey / 8 END AS lon, CASE WHEN c_custkey % 2 = 0 THEN c_custkey / 16 END AS lat, 'list' AS source FROM customer
     UNION ALL SELECT c_nationkey, c_mktsegment, c_nationkey || '|' || lower(c_mktsegment), CAST(o_orderkey % 50 AS INTEGER), NULL, CASE WHEN o_orderkey % 50 < 30 THEN CAST(c_nationkey % 3 + 10000 AS VARCHAR) END,
       CASE WHEN o_orderkey % 50 < 20 THEN CAST(c_nationkey + 10000 AS VARCHAR) || lpad(CAST(o_orderkey % 50 AS VARCHAR), 2, '0') END, NULL, NULL, 'post' FROM orders JOIN customer ON o_custkey = c_custkey"""
_SPINE = f"""(SELECT town || '|' || coalesce(street_key, CASE WHEN lon IS NOT NULL THEN printf('xy:%.6f,%.6f', lat, lon) END, 'raw:?') || '|' || house_num || coalesce(suffix, '') || '|' AS address_key, town, street_key, min(street) AS street, house_num, suffix,
       max(zip5) AS zip5, max(zip7) AS zip7, CASE WHEN max(zip7) IS NOT NULL THEN 'address' END AS zip_level, min(struct_pack(lon := lon, lat := lat)) FILTER (lon IS NOT NULL) AS pt, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM ({_ROWS}) GROUP BY ALL)"""


def _flat(doors):
    return doors.withColumn("sources", F.array_join("sources", ","))


@query("address_spine", f"SELECT address_key, town, street_key, street, house_num, suffix, zip5, zip7, zip_level, pt.lon AS lon, pt.lat AS lat, sources FROM {_SPINE}")
def address_spine(spark, sf):
    return _flat(S.address_spine(_doors(spark, sf)))


@query(
    "address_zip_tiers",
    f"""WITH t AS (SELECT * REPLACE (CASE WHEN zip7 IS NULL AND town < 3 THEN coalesce(zip5, '9000' || town) ELSE zip5 END AS zip5, CASE WHEN zip7 IS NULL AND town < 3 THEN '9000' || town || '00' ELSE zip7 END AS zip7,
          CASE WHEN zip7 IS NULL AND town < 3 THEN 'locality' ELSE zip_level END AS zip_level) FROM {_SPINE}),
        s AS (SELECT town, street_key, min(zip5) AS z FROM t WHERE street_key IS NOT NULL GROUP BY ALL HAVING count(DISTINCT zip5) = 1)
       SELECT address_key, coalesce(zip5, z) AS zip5, zip7, CASE WHEN zip5 IS NULL AND z IS NOT NULL THEN 'street' ELSE zip_level END AS zip_level FROM t LEFT JOIN s USING (town, street_key)""",
)
def address_zip_tiers(spark, sf):
    towns = load(spark, sf, "nation").filter("n_nationkey < 3").select(F.col("n_nationkey").alias("town"), F.concat(F.lit("9000"), F.col("n_nationkey").cast("string")).alias("zip5"), F.concat(F.lit("9000"), F.col("n_nationkey").cast("string"), F.lit("00")).alias("zip7"))
    return S.with_zip_tiers(S.address_spine(_doors(spark, sf)), towns).select("address_key", "zip5", "zip7", "zip_level")


@query("doors_of_a_zip", f"SELECT address_key, house_num FROM {_SPINE} WHERE zip7 = '1000305'")
def doors_of_a_zip(spark, sf):
    return S.doors_at(S.address_spine(_doors(spark, sf)), zip_code="1000305").select("address_key", "house_num")


def _asked(spark, sf):
    k = F.col("c_custkey")
    status = F.when(k % 5 == 0, "hit").when(k % 5 == 1, "wrong_locality").otherwise("not_found")
    return load(spark, sf, "customer").filter(k % 3 != 0).select(k.cast("string").alias("address_key"), status.alias("status"), (k % 4).cast("int").alias("attempts"), F.date_sub(F.lit("2024-03-01").cast("date"), (k % 60).cast("int")).alias("asked_on"))


_TRIED = "(SELECT CAST(c_custkey AS VARCHAR) AS address_key, CASE c_custkey % 5 WHEN 0 THEN 'hit' WHEN 1 THEN 'wrong_locality' ELSE 'not_found' END AS status, CAST(c_custkey % 4 AS INTEGER) AS attempts, DATE '2024-03-01' - CAST(c_custkey % 60 AS INTEGER) AS asked_on FROM customer WHERE c_custkey % 3 <> 0)"


@query(
    "doors_to_locate",
    f"""SELECT c.address_key, t.status IS NOT NULL AS asked_before FROM (SELECT CAST(c_custkey AS VARCHAR) AS address_key FROM customer WHERE c_custkey % 11 <> 0) c LEFT JOIN {_TRIED} t USING (address_key)
       WHERE t.status IS NULL OR (t.status = 'not_found' AND attempts < 3 AND asked_on < DATE '2024-03-01' - 30)""",
)
def doors_to_locate(spark, sf):
    doors = load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("address_key"), F.when(F.col("c_custkey") % 11 == 0, 1.0).alias("lon"), F.col("c_mktsegment").alias("street"), F.lit(1).alias("house_num"), F.col("c_nationkey").alias("town"))
    return S.to_locate(doors, _asked(spark, sf), "2024-03-01")


@query("misses_released", f"SELECT address_key, status, attempts FROM {_TRIED} WHERE status <> 'not_found' OR attempts < 3")
def misses_released(spark, sf):
    return S.without_misses(_asked(spark, sf), 3).select("address_key", "status", "attempts")


@query(
    "spelling_harvest",
    """SELECT n_nationkey AS code, n_name AS surface, 'customer' AS "table", 'home' AS "column", count(*) AS rows FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
       UNION ALL SELECT n_nationkey, lower(n_name) || '!', 'supplier', 'seat', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""",
)
def spelling_harvest(spark, sf):
    nation = load(spark, sf, "nation")
    homes = load(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit(" "), "n_name").alias("home"))
    seats = load(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lower("n_name"), F.lit("!")).alias("seat"))
    return S.harvested([("customer", "home", homes), ("supplier", "seat", seats)], R.unambiguous(R.place_aliases(nation, "n_nationkey", "n_name"), ["variant"], "code"))


@query(
    "sniffed_modes",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'point' WHEN 1 THEN 'parcel' WHEN 2 THEN 'address' WHEN 3 THEN 'zip' ELSE 'zip' END AS mode, CASE c_custkey % 5 WHEN 0 THEN 31.5 WHEN 1 THEN c_custkey WHEN 3 THEN 1000000 + c_custkey WHEN 4 THEN 10000 + c_custkey % 50000 END::DOUBLE AS a,
       CASE WHEN c_custkey % 5 = 4 THEN 'block' END AS other FROM customer""",
)
def sniffed_modes(spark, sf):
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, "34.75, 31.5").when(k % 5 == 1, F.concat(k.cast("string"), F.lit("/12"))).when(k % 5 == 2, F.col("c_name")).when(k % 5 == 3, (1000000 + k).cast("string")).otherwise((10000 + k % 50000).cast("string"))
    return load(spark, sf, "customer").withColumn("m", S.sniffed(text)).select("c_custkey", "m.mode", "m.a", "m.other")


@query("documents_only", "SELECT page_id FROM pages WHERE page_id % 5 <> 0 AND page_id % 3 <> 0 AND url IS NOT NULL")
def documents_only(spark, sf):
    rows = load(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, "PIC").when(F.col("page_id") % 5 == 1, F.lit(None)).otherwise("DOC").alias("kind"), F.concat("url", F.when(F.col("page_id") % 3 == 0, ".JPG").otherwise(".pdf")).alias("path"))
    return C.documents_only(rows, "kind", "path").select("page_id")


@query(
    "dataset_kinds",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'GEOJSON' WHEN 1 THEN 'PDF' WHEN 2 THEN 'CSV' END AS format, CASE p_partkey % 4 WHEN 0 THEN 'mapping_layer' WHEN 1 THEN 'document_collection' WHEN 2 THEN 'data_table' ELSE 'catalog_only' END AS kind,
       CASE WHEN p_partkey % 4 <> 0 THEN 'not_applicable' WHEN p_size % 2 = 0 THEN 'download_only' WHEN p_partkey % 8 = 0 THEN 'spatial_queries' ELSE 'text_only' END AS status FROM part""",
)
def dataset_kinds(spark, sf):
    k = F.col("p_partkey")
    rows = load(spark, sf, "part").select("p_partkey", C.format_of(F.concat("p_name", F.when(k % 4 == 0, ".geojson").when(k % 4 == 1, ".pdf").when(k % 4 == 2, ".csv").otherwise(""))).alias("format"), (F.col("p_size") % 2 == 1).alias("queryable"), F.when(k % 8 == 0, F.array(F.lit("Geom"))).otherwise(F.array(F.lit("WKT"))).alias("columns"))
    kind = C.content_type(F.lit(False), F.array(F.coalesce("format", F.lit(""))), F.lit(1), F.lit(False))
    rows = rows.withColumn("kind", kind)
    return rows.select("p_partkey", "format", "kind", C.geometry_status(F.col("kind"), F.col("columns"), F.col("queryable")).alias("status"))


@query(
    "archive_states",
    """WITH d AS (SELECT o_orderkey, o_orderkey % 5 AS versions, o_orderkey % 2 = 0 AS r, o_orderkey % 3 = 0 AS stub, CASE o_orderkey % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'remote' WHEN 2 THEN 'mixed' ELSE 'none' END AS store FROM orders)
       SELECT o_orderkey, store, CASE WHEN versions = 0 THEN 'none' WHEN r AND store <> 'none' THEN 'full' WHEN r THEN 'rows' WHEN stub THEN 'sample' WHEN store <> 'none' THEN 'files' ELSE 'none' END AS fidelity,
       concat_ws(',', CASE WHEN versions = 0 THEN 'no_version' END, CASE WHEN versions > 0 AND NOT r AND stub THEN 'sample_only' END, CASE WHEN versions > 0 AND store IN ('remote', 'mixed') THEN 'file_store' END) AS mismatch FROM d""",
)
def archive_states(spark, sf):
    k = F.col("o_orderkey")
    first, second = F.when(k % 4 != 3, F.when(k % 4 == 1, "http://x").otherwise("own://x")), F.when(k % 4 == 2, "http://y")
    rows = load(spark, sf, "orders").select(k, (k % 5).alias("versions"), (k % 2 == 0).alias("r"), (k % 3 == 0).alias("stub"), C.file_store(F.create_map(F.lit("a"), first, F.lit("b"), second), "own://").alias("store"), F.lit("own").alias("planned"))
    return C.archive_state(rows, "versions", "r", "stub", "store", "planned").select("o_orderkey", "store", "fidelity", F.array_join("mismatch", ",").alias("mismatch"))


@query("joinable_datasets", "WITH c AS (SELECT p_brand AS \"key\", count(*) AS rows FROM part GROUP BY 1) SELECT \"key\", 'town' AS via, rows FROM c WHERE rows % 3 <> 0 AND \"key\" <> (SELECT min(\"key\") FROM c) AND EXISTS (SELECT 1 FROM c WHERE \"key\" = 'Brand#1' AND rows % 3 <> 0)")
def joinable_datasets(spark, sf):
    catalog = load(spark, sf, "part").groupBy(F.col("p_brand").alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    return C.joinable(catalog.withColumn("places", F.when(F.col("rows") % 3 != 0, F.array(F.lit("town"))).otherwise(F.array().cast("array<string>"))), "Brand#1")


@query("healed_join", "SELECT c_custkey, s_suppkey, c_nationkey AS code FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def healed_join(spark, sf):
    nation = load(spark, sf, "nation")
    aliases = R.unambiguous(R.place_aliases(nation, "n_nationkey", "n_name"), ["variant"], "code")
    a = load(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lower("n_name"), F.lit(" ")).alias("home"))
    b = load(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("-"), "n_name").alias("seat"))
    return C.healed_join(a, b, "home", "seat", aliases).select("c_custkey", "s_suppkey", "code")


@query(
    "three_tables_two_keys",
    """WITH a AS (SELECT c_nationkey AS town, year(o_orderdate) AS y, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
       b AS (SELECT s_nationkey AS town, year(l_shipdate) AS y, count(*) AS shipped FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
       c AS (SELECT s_nationkey AS town, year(l_shipdate) AS y, CAST(sum(l_quantity) AS BIGINT) AS returned FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY ALL)
       SELECT town, CAST(y AS INTEGER) AS y, orders, shipped, returned FROM a JOIN b USING (town, y) JOIN c USING (town, y)""",
)
def three_tables_two_keys(spark, sf):
    orders = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("town"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("orders"))
    lines = load(spark, sf, "lineitem").join(load(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("town"), F.year("l_shipdate").alias("y"), "l_quantity", "l_returnflag")
    shipped = lines.groupBy("town", "y").agg(F.count(F.lit(1)).alias("shipped"))
    returned = lines.filter("l_returnflag = 'R'").groupBy("town", "y").agg(F.sum("l_quantity").cast("long").alias("returned"))
    return C.side_by_side([orders, shipped, returned], ["town", "y"])


@query("bulk_update", "SELECT c_custkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, c_name) AS c_name, coalesce(s_nationkey, c_nationkey) AS c_nationkey FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def bulk_update(spark, sf):
    new = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("c_name"), F.col("s_nationkey").alias("c_nationkey"))
    return C.bulk_updated(load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), new, "c_custkey", ["c_name", "c_nationkey"])


@query("column_captions", """SELECT DISTINCT lower(p_type) AS name, CASE WHEN p_type = (SELECT min(p_type) FROM part) THEN 'first' ELSE trim(replace(lower(p_type), '_', ' ')) END AS caption FROM part""")
def column_captions(spark, sf):
    part = load(spark, sf, "part")
    return C.captioned(part.select(F.lower("p_type").alias("name")).distinct(), part.agg(F.min("p_type").alias("name")).withColumn("caption", F.lit("first")))


@query(
    "geometry_coverage",
    """WITH t AS (SELECT p_brand, bool_or(p_size = 1) AS t, bool_or(p_size = 2) AS g FROM part GROUP BY 1) SELECT count(*) AS tables, count(*) FILTER (t) AS with_text, count(*) FILTER (g) AS with_geometry, count(*) FILTER (t AND NOT g) AS text_only FROM t""",
)
def geometry_coverage(spark, sf):
    return C.geometry_coverage(load(spark, sf, "part").select(F.col("p_brand").alias("table"), F.when(F.col("p_size") == 1, "WKT").when(F.col("p_size") == 2, "geom").otherwise("name").alias("column")))


@query("log_page", """SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error') AND (contains(lower(props), '"k": 7') OR contains(lower(event_type), '"k": 7')) ORDER BY ts DESC, event_id LIMIT 20""")
def log_page(spark, sf):
    return C.log_page(load(spark, sf, "events"), '"K": 7', ["props", "event_type"], "ts", "event_id", {"event_type": ["click", "error"]}, 20).select("event_id", "event_type")


@query("review_list", "SELECT o_orderkey, count(l_orderkey) AS edges, c_name AS o_custkey_name FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45 LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY ALL")
def review_list(spark, sf):
    edges = load(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = load(spark, sf, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    return C.review_list(rows, "o_orderkey", edges, {"o_custkey": (load(spark, sf, "customer"), "c_custkey", "c_name")}).drop("o_custkey")


@query("attempt_claim", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 'pending' WHEN o_orderkey % 5 >= 3 THEN 'deferred' ELSE 'running' END AS status, o_orderkey % 5 + CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 < 3 THEN 1 ELSE 0 END AS attempts FROM orders")
def attempt_claim(spark, sf):
    queue = load(spark, sf, "orders").select("o_orderkey", F.lit("pending").alias("status"), (F.col("o_orderkey") % 5).alias("attempts"))
    return C.attempted(queue, queue.filter("o_orderkey % 2 = 0"), "o_orderkey")


@query("sampled_again", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def sampled_again(spark, sf):
    return C.to_sample(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "open", closed=("F",), status="o_orderstatus")


@query("stale_profiles", "SELECT p_brand AS \"table\", count(*) AS signature FROM part GROUP BY 1 HAVING count(*) % 2 = 1")
def stale_profiles(spark, sf):
    now = load(spark, sf, "part").groupBy(F.col("p_brand").alias("table")).agg(F.count(F.lit(1)).alias("signature"))
    return C.stale_profiles(now, now.withColumn("signature", F.col("signature") - F.col("signature") % 2))


# graphs and places --------------------------------------------------------------------------

_EDGES = "(SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, l_orderkey AS document FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _edges(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"))
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return orders.join(lines, "o_orderkey").select("src", "dst", F.col("o_orderkey").alias("document"))


@query("hydrated_edges", f"SELECT DISTINCT src, dst, 'customer' AS src_kind, c_name AS src_name, CASE WHEN p_size < 40 THEN 'part' END AS dst_kind, CASE WHEN p_size < 40 THEN p_name END AS dst_name FROM {_EDGES} JOIN customer ON src = 'c' || c_custkey JOIN part ON dst = 'p' || p_partkey")
def hydrated_edges(spark, sf):
    people = load(spark, sf, "customer").withColumn("id", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    parts = load(spark, sf, "part").filter("p_size < 40").withColumn("id", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    return G.hydrated(_edges(spark, sf).select("src", "dst").distinct(), {"customer": (people, "id", "c_name"), "part": (parts, "id", "p_name")})


@query("registered_neighbours", f"SELECT DISTINCT src, dst, src AS anchor FROM {_EDGES} JOIN (SELECT 'c' || c_custkey AS id FROM customer WHERE contains(lower(c_name), '#00000001') ORDER BY 1 LIMIT 5) ON src = id")
def registered_neighbours(spark, sf):
    entities = load(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").cast("string").alias("number"), F.col("c_name").alias("name"))
    return G.around(_edges(spark, sf).select("src", "dst").distinct(), G.registered(entities, name="#00000001"))


@query("document_subgraph", f"SELECT DISTINCT src, dst FROM {_EDGES} WHERE document = 7")
def document_subgraph(spark, sf):
    return G.document_subgraph(_edges(spark, sf), 7)[1]


@query("entity_documents", f"SELECT DISTINCT document FROM {_EDGES} WHERE dst = 'p77'")
def entity_documents(spark, sf):
    return G.entity_documents(_edges(spark, sf), "p77")


@query("point_texts", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN printf('POINT(%.6f %.6f)', c_custkey / 8.0::DOUBLE, c_custkey / 16.0::DOUBLE) END AS wkt FROM customer")
def point_texts(spark, sf):
    k = F.col("c_custkey")
    return load(spark, sf, "customer").select(k, P.point_wkt(F.when(k % 3 != 0, k / 8), k / 16).alias("wkt"))


_BITS = " + ".join(f"((x >> {b}) & 1) * {1 << 2 * b + 1} + ((y >> {b}) & 1) * {1 << 2 * b}" for b in range(15))


@query("place_order", f"SELECT c_custkey, {_BITS} AS z FROM (SELECT c_custkey, CAST(floor((c_custkey % 360) / 360.0::DOUBLE * 32768) AS BIGINT) AS x, CAST(floor((c_custkey % 180) / 180.0::DOUBLE * 32768) AS BIGINT) AS y FROM customer)")
def place_order(spark, sf):
    k = F.col("c_custkey")
    return load(spark, sf, "customer").select(k, P.z_order((k % 360 - 180).cast("double"), (k % 180 - 90).cast("double")).alias("z"))
