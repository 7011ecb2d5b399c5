"""Queries that resolve names and walk graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silthouse.functions import text as T
from silthouse.operators import graph as G
from silthouse.operators import resolve as R
from silthouse.plans.registry import query
from silthouse.session import load


@query(
    "batch_resolve",
    """SELECT o.c_custkey, n.n_nationkey AS code, CASE WHEN n.n_nationkey IS NULL THEN 'unmatched' ELSE 'nation' END AS matched
       FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'nowhere' ELSE (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) END AS name FROM customer) o
       LEFT JOIN nation n ON n.n_name = o.name""",
)
def batch_resolve(spark, sf):
    nation = load(spark, sf, "nation")
    aliases = R.unambiguous(R.place_aliases(nation, "n_nationkey", "n_name"), ["variant"], "code")
    names = load(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "nowhere").otherwise(F.concat(F.lit(" "), F.lower("n_name"), F.lit("-"))).alias("name"))
    return R.resolved(names, "name", ("nation", aliases)).select("c_custkey", "code", "matched")


@query(
    "alias_tie_rule",
    """WITH a AS (SELECT p_brand AS variant, p_partkey AS code, p_size AS weight FROM part), m AS (SELECT variant, max(weight) AS weight FROM a GROUP BY 1)
       SELECT variant, weight, min(code) AS code FROM a JOIN m USING (variant, weight) GROUP BY ALL HAVING count(DISTINCT code) = 1""",
)
def alias_tie_rule(spark, sf):
    return R.unambiguous(load(spark, sf, "part").select(F.col("p_brand").alias("variant"), F.col("p_partkey").alias("code"), F.col("p_size").alias("weight")), ["variant"], "code")


@query("genuine_column", """SELECT 'name' AS "column", count(DISTINCT n_name) AS values, count(DISTINCT n_name) AS resolved, true AS genuine FROM nation UNION ALL SELECT 'seg', count(DISTINCT c_mktsegment), 0, false FROM customer""")
def genuine_column(spark, sf):
    nation = load(spark, sf, "nation")
    counts = nation.select(F.lit("name").alias("column"), F.col("n_name").alias("value")).unionByName(load(spark, sf, "customer").select(F.lit("seg").alias("column"), F.col("c_mktsegment").alias("value")))
    return R.genuine_column(counts, R.place_aliases(nation, "n_nationkey", "n_name"))


#: Likeness of all pairs of names in a block, then the names that pairs lead to.
_CLUSTERS = """WITH RECURSIVE t AS (SELECT p_name, list_sort(string_split(p_name, ' ')) AS w, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY p_name),
       k AS (SELECT *, array_to_string(w, ' ') AS s, substr(list_extract(list_sort(list_transform(w, lambda x: lpad(CAST(99 - length(x) AS VARCHAR), 2, '0') || x)), 1), 3, 2) AS block FROM t),
       e AS (SELECT x.p_name AS a, y.p_name AS b FROM k x JOIN k y ON x.block = y.block AND x.p_name <> y.p_name
             WHERE CASE WHEN list_sort(list_distinct(x.w)) = list_sort(list_distinct(y.w)) THEN 0.97
                   ELSE 0.6 * (1 - levenshtein(x.s, y.s) / greatest(length(x.s), length(y.s))) + 0.4 * len(list_intersect(list_distinct(x.w), list_distinct(y.w))) / len(list_distinct(x.w || y.w)) END >= 0.85),
       r AS (SELECT p_name AS a, p_name AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
       c AS (SELECT r.a, min(t.id) AS cluster, CAST(sum(t.n) AS BIGINT) AS size FROM r JOIN t ON t.p_name = r.b GROUP BY 1)
       SELECT p_partkey AS id, cluster, size FROM part JOIN c ON a = p_name WHERE size > 1"""


@query("duplicate_clusters", _CLUSTERS)
def duplicate_clusters(spark, sf):
    return R.duplicate_clusters(R.blocked_pairs(load(spark, sf, "part"), "p_partkey", "p_name"))


def _spelled(df: DataFrame) -> DataFrame:
    """Longer part names, a third each as they are, with a letter left out, and with two words changed about."""
    name = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"))
    at = 4 + F.col("p_partkey") % (F.length(name) - 4)
    gone = F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.length(name)))
    moved = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2)))
    return df.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, name).when(F.col("p_partkey") % 3 == 1, gone).otherwise(moved).alias("name"))


_SPELLED = """(SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN n WHEN 1 THEN substr(n, 1, 3 + p_partkey % (length(n) - 4)) || substr(n, 5 + p_partkey % (length(n) - 4))
       ELSE split_part(p_name, ' ', 1) || ' ' || lower(p_type) || ' ' || split_part(p_name, ' ', 2) END AS name
       FROM (SELECT *, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS n FROM part))"""


def _common_sql(a: str, b: str) -> str:
    """Characters of the longest common subsequence of two texts of up to 60 letters, as bits of a number."""
    full = f"((CAST(1 AS BIGINT) << CAST(length({a}) AS INT)) - 1)"
    mask = f"CAST(coalesce(list_sum(list_transform(range(length({a})), lambda k: CASE WHEN substr({a}, CAST(k AS INT) + 1, 1) = c THEN CAST(1 AS BIGINT) << CAST(k AS INT) ELSE CAST(0 AS BIGINT) END)), 0) AS BIGINT)"
    rows = f"list_prepend({full}, list_transform(string_split({b}, ''), lambda c: {mask}))"
    return f"(length({a}) - bit_count(list_reduce({rows}, lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})))"


def _scores_sql(pairs: str) -> str:
    """a, b, score of different pairs (a, b): the best of the three ratios, over all stretches for the partial one."""
    words = lambda c: f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"
    return f"""(SELECT a, b, max(weight * 2 * {_common_sql("x", "y")} / (length(x) + length(y))) AS score FROM (
       SELECT a, b, 1.0::DOUBLE AS weight, a AS x, b AS y FROM {pairs} UNION ALL SELECT a, b, 0.95::DOUBLE, {words("a")}, {words("b")} FROM {pairs}
       UNION ALL SELECT a, b, 0.9::DOUBLE, x, substr(y, CAST(greatest(k, 0) + 1 AS INT), CAST(k + length(x) - greatest(k, 0) AS INT)) FROM (
         SELECT a, b, x, y, unnest(range(1 - length(x), length(y))) AS k FROM (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS y FROM {pairs}))) GROUP BY a, b)"""


def _registry_sql(asked: str, known: str) -> str:
    """Rows of two_pass_registry: asked (id, name) against known (number, name), all pairs of different names of a block scored."""
    return f"""WITH q AS (SELECT * FROM {asked}), r AS (SELECT name, min(number) AS number FROM {known} GROUP BY 1),
       p AS (SELECT DISTINCT q.name AS a, r.name AS b FROM q JOIN r ON q.name[1:3] = r.name[1:3] WHERE q.name NOT IN (SELECT name FROM r)),
       s AS (SELECT a, b, round(score, 6) AS score FROM {_scores_sql("p")} WHERE score >= 0.85),
       f AS (SELECT a, max(score) AS score, arg_min(number, (-score, number)) AS number FROM s JOIN r ON r.name = s.b GROUP BY a)
       SELECT q.id, coalesce(r.number, f.number) AS number, CASE WHEN r.number IS NULL THEN f.score ELSE 1.0 END AS score, CASE WHEN r.number IS NULL THEN 'fuzzy' ELSE 'exact' END AS how
       FROM q LEFT JOIN r ON r.name = q.name LEFT JOIN f ON f.a = q.name WHERE r.number IS NOT NULL OR f.number IS NOT NULL"""


@query("duplicate_pairs_exact", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT n_nationkey, n_regionkey AS k FROM nation) a JOIN (SELECT n_nationkey, n_regionkey AS k FROM nation) b USING (k) WHERE a.n_nationkey < b.n_nationkey AND a.n_nationkey = (SELECT min(n_nationkey) FROM nation c WHERE c.n_regionkey = k)")
def duplicate_pairs_exact(spark, sf):
    names = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return R.blocked_pairs(names, "n_nationkey", "r_name").select("a", "b")


@query("registry_two_pass", _registry_sql("(SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 2 = 0)", "(SELECT p_partkey AS number, p_name AS name FROM part WHERE p_partkey % 2 = 1)"))
def registry_two_pass(spark, sf):
    part = load(spark, sf, "part").select("p_partkey", "p_name")
    return R.two_pass_registry(part.filter("p_partkey % 2 = 0"), part.filter("p_partkey % 2 = 1"), "p_partkey", "p_name", "p_partkey")


@query("registry_fuzzy", _registry_sql(f"(SELECT p_partkey AS id, name FROM {_SPELLED})", "(SELECT p_partkey AS number, p_name || ' ' || lower(p_type) AS name FROM part)"))
def registry_fuzzy(spark, sf):
    part = load(spark, sf, "part")
    full = part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"), F.col("p_partkey").alias("number"))
    return R.two_pass_registry(_spelled(part), full, "p_partkey", "name", "number")


@query(
    "same_date_match",
    """WITH e AS (SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day, user_id FROM events)
       SELECT a.event_id AS a, min(b.event_id) AS b, 1.0::DOUBLE AS score FROM e a JOIN e b ON a.day = b.day AND a.user_id = b.user_id AND a.event_type <> b.event_type GROUP BY 1""",
)
def same_date_match(spark, sf):
    rows = load(spark, sf, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat(F.lit("meeting of user "), F.col("user_id").cast("string")).alias("title"))
    return R.same_day_matches(rows, "event_id", "event_type", "day", "title", least=0.9)


@query(
    "interval_membership",
    """SELECT event_id FROM events JOIN (SELECT user_id AS u, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'purchase' GROUP BY 1) ON user_id = u AND ts BETWEEN a AND b WHERE event_type = 'click'""",
)
def interval_membership(spark, sf):
    events = load(spark, sf, "events")
    spans = events.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("person")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    own = events.filter("event_type = 'click'").select("event_id", F.col("user_id").alias("who"), "ts")
    both = own.join(spans, (F.col("who") == F.col("person")) & F.col("ts").between(F.col("a"), F.col("b")))
    return both.select("event_id")


@query(
    "inherit_unique_value",
    """WITH v AS (SELECT l_partkey, l_linenumber, CASE WHEN l_quantity > 40 THEN l_returnflag END AS flag FROM lineitem), u AS (SELECT l_partkey, min(flag) AS f FROM v WHERE flag IS NOT NULL GROUP BY 1 HAVING count(DISTINCT flag) = 1)
       SELECT coalesce(flag, f) AS flag, count(*) AS n FROM v LEFT JOIN u USING (l_partkey) GROUP BY 1""",
)
def inherit_unique_value(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_partkey", F.when(F.col("l_quantity") > 40, F.col("l_returnflag")).alias("flag"))
    return R.inherit_unique(rows, ["l_partkey"], "flag").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("ambiguous_keys", "SELECT p_name AS p_name, count(DISTINCT p_type) AS targets FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def ambiguous_keys(spark, sf):
    return R.ambiguous(load(spark, sf, "part"), "p_name", "p_type")


# graphs -------------------------------------------------------------------------------------

_EDGES = "(SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"))
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return orders.join(lines, "o_orderkey").select("src", "dst").distinct()


@query(
    "graph_walk",
    """WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 7 + 3) % 25 AS BIGINT) AS dst FROM nation UNION SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey * 3 + 1) % 25 AS BIGINT) FROM nation),
       w AS (SELECT src, dst, 1 AS step FROM e WHERE src = 4 OR dst = 4
             UNION SELECT e.src, e.dst, w.step + 1 FROM w JOIN e ON e.src = w.dst OR e.dst = w.src WHERE w.step < 3)
       SELECT src, dst, CAST(min(step) AS INTEGER) AS step FROM w GROUP BY ALL""",
)
def graph_walk(spark, sf):
    nation = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    edges = nation.select("src", ((F.col("src") * 7 + 3) % 25).alias("dst")).union(nation.select("src", ((F.col("src") * 3 + 1) % 25).alias("dst"))).distinct()
    return G.walk(edges, 4, 3, ["src", "dst"])


@query("neighbourhood", f"SELECT src, dst FROM {_EDGES} WHERE src = 'p77' OR dst = 'p77'")
def neighbourhood(spark, sf):
    return G.neighbourhood(_edges(spark, sf), "p77")


@query("top_connected", f"SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {_EDGES} UNION ALL SELECT dst FROM {_EDGES}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_connected(spark, sf):
    return G.top_connected(_edges(spark, sf), 10)


@query("orphan_audit", f"SELECT 'dst' AS side, dst AS id, count(*) AS edges FROM {_EDGES} WHERE dst NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 40) GROUP BY 2")
def orphan_audit(spark, sf):
    known = load(spark, sf, "part").filter("p_size < 40").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")).unionByName(load(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")))
    return G.orphans(_edges(spark, sf), known)


@query("hidden_pruned", f"SELECT src, dst FROM {_EDGES} WHERE src NOT IN ('c7', 'c10') AND dst <> 'p77'")
def hidden_pruned(spark, sf):
    return G.pruned(_edges(spark, sf), spark.createDataFrame([("c7",), ("c10",), ("p77",)], "id string"))


@query("merge_entities", f"SELECT DISTINCT CASE WHEN src IN ('c2', 'c3') THEN 'c1' ELSE src END AS src, CASE WHEN dst = 'p2' THEN 'c1' ELSE dst END AS dst FROM {_EDGES} WHERE NOT (src IN ('c1', 'c2', 'c3') AND dst = 'p2')")
def merge_entities(spark, sf):
    return G.merged(_edges(spark, sf), spark.createDataFrame([("c2", "c1"), ("c3", "c1"), ("p2", "c1")], "id string, canonical string"), [])


@query("degree_showcase", f"SELECT src, count(*) AS degree FROM {_EDGES} GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 12")
def degree_showcase(spark, sf):
    return _edges(spark, sf).groupBy("src").agg(F.count(F.lit(1)).alias("degree")).filter("degree >= 5").orderBy(F.desc("degree"), "src").limit(12)


@query(
    "connected_components",
    """WITH RECURSIVE e AS (SELECT CAST(s_suppkey AS BIGINT) AS a, CAST(s_suppkey // 3 * 3 AS BIGINT) AS b FROM supplier UNION SELECT CAST(s_suppkey // 3 * 3 AS BIGINT), CAST(s_suppkey AS BIGINT) FROM supplier),
       r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a)
       SELECT id, min(c) AS cluster FROM r GROUP BY 1 HAVING count(*) > 1""",
)
def connected_components(spark, sf):
    pairs = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"), (F.floor(F.col("s_suppkey") / 3) * 3).cast("long").alias("b"))
    return G.clusters(pairs).select("id", "cluster")


_DAY_GROUPS = "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, min(event_id) AS cluster, count(*) AS size FROM events GROUP BY ALL HAVING count(DISTINCT event_type) > 1"


def _day_matches(spark, sf):
    rows = load(spark, sf, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat(F.lit("meeting of user "), F.col("user_id").cast("string")).alias("title"))
    return R.same_day_matches(rows, "event_id", "event_type", "day", "title", least=0.9)


@query("event_match_groups", f"SELECT e.event_id AS id, g.cluster, g.size FROM events e JOIN ({_DAY_GROUPS}) g ON e.user_id = g.user_id AND strftime(e.ts, '%Y-%m-%d') = g.day")
def event_match_groups(spark, sf):
    return R.event_groups(_day_matches(spark, sf))


@query(
    "cross_reference_status",
    f"SELECT e.event_id, CASE WHEN g.day IS NULL THEN 'unconfirmed' ELSE 'confirmed' END AS status FROM events e LEFT JOIN ({_DAY_GROUPS}) g ON e.user_id = g.user_id AND strftime(e.ts, '%Y-%m-%d') = g.day",
)
def cross_reference_status(spark, sf):
    events = load(spark, sf, "events").select("event_id")
    return R.cross_referenced(events, R.event_groups(_day_matches(spark, sf)), "event_id")


@query(
    "doorway_keys",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'street:' || c_nationkey WHEN 1 THEN 'zip:' || c_mktsegment WHEN 2 THEN 'xy:35.1235,31.5' ELSE 'raw:' || lower(regexp_replace(c_name, '[^0-9A-Za-z]', '', 'g')) END AS key FROM customer""",
)
def doorway_keys(spark, sf):
    k = F.col("c_custkey") % 4
    key = R.doorway_key(F.when(k == 0, F.col("c_nationkey")), F.when(k == 1, F.col("c_mktsegment")), F.when(k == 2, F.lit(35.12345678)), F.lit(31.5), F.col("c_name"))
    return load(spark, sf, "customer").select("c_custkey", key.alias("key"))


@query("registry_scores", f"""WITH p AS (SELECT lower(n_name) AS a, lower(r_name) AS b FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT a, b, round(score, 6) AS score FROM {_scores_sql("p")}""")
def registry_scores(spark, sf):
    from silthouse.functions.fuzzy import registry_score

    names = load(spark, sf, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.lower("n_name").alias("a"))
    return names.join(load(spark, sf, "region").select("r_regionkey", F.lower("r_name").alias("b")), "r_regionkey").select("a", "b", F.round(registry_score("a", "b"), 6).alias("score"))
