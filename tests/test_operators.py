"""Operators whose results SQL doesn't show: guards, compilers, components, files and streams."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silthouse.functions import text as T
from silthouse.operators import archive as A
from silthouse.operators import console as C
from silthouse.operators import graph as G
from silthouse.operators import merge as M
from silthouse.operators import profile as P
from silthouse.operators import records as RC
from silthouse.operators import resolve as RS
from silthouse.operators import search as S
from silthouse.operators import semantic as Q
from silthouse.operators import spatial as X
from silthouse.plans import registry
from silthouse.plans.analysis import MODEL
from silthouse.sources import readers as R
from silthouse.sources import writers as W
from silthouse.streaming import ingest as N


@pytest.fixture(scope="module")
def nation(spark, sf):
    rows = spark.read.parquet(f"{sf}/nation.parquet")
    rows.createOrReplaceTempView("nation")
    return rows


def test_console_runs_queries_only(spark, nation):
    rows, more = C.run(spark, "select n_name from nation order by 1;", {"nation"}, 10)
    assert len(rows) == 10 and more
    assert C.run(spark, "with x as (select 1 as a) select * from x", {"nation"})[0][0].a == 1
    for bad in ("drop table nation", "select 1; select 2", "insert into nation values (1)", "create table t (a int)", "set a = b", "explain select 1", "select * from other", "update nation set n_name = ''", "select reflect('java.lang.System', 'getenv', 'HOME')"):
        with pytest.raises(C.Refused):
            C.run(spark, bad, {"nation"})
    for bad in (
        "create database d", "execute immediate 'drop view nation'", "begin drop view nation; end", "cache table nation", "show tables", "describe nation", "with x as (select * from other) select * from x",
        "with x as (select 1 a) select * from nation where n_nationkey in (select k from other)", "select (select max(k) from other)", "select * from nation where exists (select 1 from other)", "select * from parquet.`/etc/x`",
        "with nation2 as (select * from nation2) select * from nation2", "select * from nation union select * from other", "select * from nation n join lateral (select * from other) o", "select upper(reflect('a', 'b'))", "values (1), ((select k from other))",
    ):
        with pytest.raises(C.Refused):
            C.run(spark, bad, {"nation"})
    for good in ("with x as (select * from nation), y as (select n_name from x) select count(*) from y where n_name in (select n_name from x)", "select n_regionkey, count(*) c from nation group by 1 having count(*) > 1 order by 2 limit 3 offset 1", "select * from nation n left join (values (1, 'a')) v(k, t) on n_nationkey = k", "select explode(array(1, 2))", "select n_name, row_number() over (partition by n_regionkey order by n_name) from nation"):
        C.run(spark, good, {"nation"})
    with pytest.raises(C.Refused, match="Did you mean n_name"):
        C.run(spark, "select n_nam from nation", {"nation"})
    assert len(C.register(spark)) == 4


def test_questions_are_checked():
    ask = lambda **q: Q.validate(MODEL, Q.Question("orders", **q))
    for bad in (dict(filters=[("status", ">", "F")]), dict(measures=["sum:status"]), dict(dimensions=["id"]), dict(dimensions=["x"]), dict(filters=[("price", "between", [1])]), dict(filters=[("status", "in", list(range(201)))]), dict(enrich=["customer.nope"]), dict(filters=[("price", "~", 1)])):
        with pytest.raises(Q.SemanticError):
            ask(**bad)
    assert "by status where price > 5" in Q.explain(Q.Question("orders", dimensions=["status"], filters=[("price", ">", 5)]))


def test_merges(spark):
    rows = spark.createDataFrame([(1, None), (2, "done"), (3, "open")], "k int, status string")
    assert {r.k for r in A.item_keys(rows, "k", excluded=["done"]).collect()} == {1, 3}
    new = rows.unionByName(rows)
    assert M.content_diff(rows, new, ["k", "status"]).count() == 0
    assert M.insert_if_absent(rows, new).count() == 0
    assert not M.shrink_guard(100, 49) and M.shrink_guard(100, 50) and M.shrink_guard(100, 1, override=True)
    assert M.short_load(94, 100) and not M.short_load(95, 100)
    stamped = spark.createDataFrame([("x", "2024-01-01", "a")], "v string, first_seen string, stamp string")
    out = M.refresh_stamp(stamped, stamped.withColumn("first_seen", F.lit("2025-01-01")).withColumn("stamp", F.lit("b")), "stamp").collect()
    assert [tuple(r) for r in out] == [("x", "2024-01-01", "b")]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14))
def test_components(spark, pairs):
    of = {x: x for p in pairs for x in p}
    for _ in of:
        for a, b in pairs:
            of[a] = of[b] = min(of[a], of[b])
    got = {r.u: r.v for r in G.components(spark.createDataFrame(pairs, "u int, v int")).collect()}
    assert got == {x: c for x, c in of.items() if x != c}


def test_components_keep_off_the_driver(spark, monkeypatch):
    """Stars take no round, a chain few, and no round's table is broadcast."""
    rounds, write = [], G.written
    monkeypatch.setattr(G, "written", lambda df, tag, **options: rounds.append(df) or write(df, tag, **options))
    star = spark.createDataFrame([(i, 100 * (i // 100)) for i in range(300) if i % 100], "u int, v int")
    assert {(r.u, r.v) for r in G.components(star).collect()} == {(r.u, r.v) for r in star.collect()}
    assert len(rounds) == 1
    turned = star.select(F.col("v").alias("u"), F.col("u").alias("v")).union(star.filter("u % 2 = 0"))
    assert {(r.u, r.v) for r in G.components(turned).collect()} == {(r.u, r.v) for r in star.collect()}
    rounds.clear()
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u int, v int")
    assert {(r.u, r.v) for r in G.components(chain).collect()} == {(i, 0) for i in range(1, 41)}
    assert 2 < len(rounds) < 8
    for df in rounds:
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def plain(name):
    return re.sub(r"\s+", " ", re.sub("[-–—־/]", " ", re.sub("[\"'`׳״]", "", name.lower()))).strip()


def tokens(name):
    return sorted(t for t in plain(name).split(" ") if len(t) > 1 and t not in T.HONORIFICS)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    """Likeness of two names, written down plainly."""
    x, y = tokens(a), tokens(b)
    if plain(a) == plain(b):
        return 1.0
    if not x or not y:
        return 0.0
    if set(x) == set(y):
        return 0.97
    p, q = " ".join(x), " ".join(y)
    both = set(x) & set(y)
    return min(1.0, 0.6 * (1 - edits(p, q) / max(len(p), len(q))) + 0.4 * len(both) / len(set(x) | set(y)))


def test_duplicate_clusters_match_union_find(spark, sf):
    heads = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    of = {i: i for i in heads if tokens(heads[i])}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    block = lambda n: max(tokens(n), key=len)[:2]
    for a in of:
        for b in of:
            if a < b and block(heads[a]) == block(heads[b]) and alike(heads[a], heads[b]) >= 0.85:
                x, y = sorted((root(a), root(b)))
                of[y] = x
    size = Counter(root(i) for i in of)
    got = {(r.id, r.cluster, r.size) for r in registry.queries()["duplicate_clusters"](spark, sf).collect()}
    assert got == {(i, root(i), size[root(i)]) for i in of if size[root(i)] > 1}


def test_profiles(spark):
    rows = spark.createDataFrame([("1,000", "1.5", "2024-01-02", "x"), ("2", "", "2024-02-03", None)], "a string, b string, c string, d string")
    kinds = P.infer_types(rows)
    assert kinds == {"a": "integer", "b": "numeric", "c": "date", "d": "text"}
    assert [tuple(map(str, r)) for r in P.typed(rows, kinds).select("a", "b", "c").collect()] == [("1000", "1.5", "2024-01-02"), ("2", "None", "2024-02-03")]
    assert P.date_formats(spark.createDataFrame([("1/2/2024",), ("13/2/2024",)], "d string"), "d")[0][0] == "d/M/yyyy"


def test_search_terms():
    terms = S.parse_terms('"big house" (red) -blue OR green')
    assert (terms.wanted, terms.excluded, terms.any) == (["big house", "red", "green"], ["blue"], True)


def plain_distance(a, b):
    (x, y), (u, v) = [(math.radians(p), math.radians(q)) for p, q in (a, b)]
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2)))


def test_distances_everywhere(spark):
    """Across the 180th meridian, at the poles and anywhere else, for small and huge radii; no row is without its nearest."""
    rng = random.Random(4)
    a = [(179.99, 10), (-179.99, 10), (0, 90), (120, 89.99), (-60, -89.95), (120, -90), (10, 75), (10.34, 75)] + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(40)]
    b = [(-179.995, 10.001), (77, 89.98), (10.3, 75.01), (180, 0), (-180, 0)] + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(40)]
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "a int, lon double, lat double")
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "b int, lon double, lat double")
    for metres in (3000.0, 400_000.0, 5_000_000.0, 15_000_000.0):
        got = {(r.a, r.b) for r in X.within(left, right, metres).collect()}
        assert got == {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if plain_distance(p, q) <= metres}
    got = {r.a: r.distance_m for r in X.nearest(left, "a", right, "b").collect()}
    assert len(got) == len(a) and all(abs(got[i] - min(plain_distance(p, q) for q in b)) < 1e-3 for i, p in enumerate(a))
    three = [tuple(r) for r in X.nearest(left, "a", right.union(right.withColumn("b", F.col("b") + 100)), "b", 3).orderBy("a", "rank").select("a", "b").collect()]
    assert three == [(i, j) for i, p in enumerate(a) for _, j in sorted((round(plain_distance(p, q), 6), j + m) for j, q in enumerate(b) for m in (0, 100))[:3]]
    assert X.nearest(left, "a", right.limit(2), "b", 5).count() == 2 * len(a) and X.nearest(left, "a", right.limit(0), "b").collect() == []
    assert all(r.distance_m <= 9000 for r in X.nearest(left, "a", right, "b", 1, 9000.0).collect())


def test_names_of_any_length(spark):
    events = spark.createDataFrame([(1, "the Ministry of Very Long Names met Ann"), (2, "Ministry of Very"), (3, None)], "id int, text string")
    names = spark.createDataFrame([("ministry of very long names",), ("Ann",), ("Bo",)], "name string")
    got = {(r.id, r.name) for r in RC.mentions(events, "id", F.col("text"), names, "name").collect()}
    assert got == {(1, "ministry of very long names"), (1, "Ann")}


def test_titles_of_a_day_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("xyz"), f"d{rng.randrange(4)}", " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(rng.randrange(0, 5)))) for i in range(120)]
    events = spark.createDataFrame(rows, "id int, source string, day string, title string")
    for least in (0.5, 0.65, 1.0):
        want = {}
        for i, s, d, t in rows:
            x = set(t.split()) or {""}
            best = sorted((-round(len(x & y) / len(x | y), 6), j) for j, r, e, u in rows if e == d and r != s for y in [set(u.split()) or {""}] if round(len(x & y) / len(x | y), 6) >= least)
            if best:
                want[i] = (best[0][1], -best[0][0])
        assert {r.a: (r.b, r.score) for r in RS.same_day_matches(events, "id", "source", "day", "title", least).collect()} == want


def test_names_say_what_columns_hold():
    flags = lambda *c: {k for k, v in P.name_flags(list(c)).items() if v}
    assert flags("electricity_use", "translation_id", "lifetime_value", "plateau", "officer") == set()
    assert flags("City") == {"has_locality"} and flags("the_geom") == flags("start_lat") == flags("shape_WKT") == {"has_geometry"}
    assert flags("dt_open") == flags("birth_year") == {"has_date"} and flags("home_office") == {"has_ministry"} and flags("capacity_city") == set()


def test_places(spark):
    assert X.coordinate_columns(["id", "Lat", "LON"]) == ("LON", "Lat")
    assert X.parse_wkt("POLYGON((0 0, 1 0))") and X.parse_wkt("nonsense") is None and X.parse_wkt(None) is None
    ring = [[(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]]
    x, y = X.interior_point(ring)
    assert X.inside(__import__("numpy").array([x, 3.0]), __import__("numpy").array([y, 3.0]), ring).tolist() == [True, False]
    point = spark.range(1).select(X.from_grid(F.lit(219529.584), F.lit(626907.39)).alias("p")).select("p.*").first()
    assert abs(point.lon - 35.2045169) < 1e-6 and abs(point.lat - 31.7343936) < 1e-6
    grid = spark.range(1).select(X.oriented(F.lit(219529.584), F.lit(626907.39)).alias("p")).select("p.kind").first()
    assert grid.kind == "grid"
    feature = spark.createDataFrame([(35.123456789, 31.0, "n")], "lon double, lat double, name string")
    assert '"coordinates":[35.1234568,31.0]' in feature.select(X.geojson(feature).alias("f")).first().f


def test_csv_and_calendar(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("שם;n;N\n\"א;\"\"ב\";1;2\nג;3;\n".encode("windows-1255"))
    rows = R.csv(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["שם", "n", "N_1"] and rows.first()[0] == 'א;"ב'
    assert R.encoding_of("א".encode()[:1] + b"") in R.ENCODINGS and R.encoding_of(b"\xef\xbb\xbfa") == "utf-8-sig" and R.encoding_of("אב".encode()[:3]) == "utf-8"
    assert R.header_row([["", "1"], ["a", "b"], ["2", "c"]]) == 1 and R.header_row([["1"], ["2"]]) is None
    (tmp_path / "c.ics").write_text("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Long\r\n  title\\, yes\r\nDTSTART:20240102T030405Z\r\nDTEND;VALUE=DATE:20240103\r\nATTENDEE;CN=A:mailto:a@x\r\nATTENDEE:mailto:b@x\r\nORGANIZER:mailto:o@x\r\nUID:7\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    event = R.calendar(spark, str(tmp_path / "c.ics")).first()
    assert (event.title, str(event.start), str(event.end), event.participants, event.organizer, event.uid, event.location) == ("Long title, yes", "2024-01-02 03:04:05", "2024-01-03 00:00:00", "a@x; b@x", "o@x", "7", None)
    kinds = spark.createDataFrame([("CSV", "x"), (None, "http://h/a.XLSX?d=1"), ("", "b")], "d string, n string").select(R.format_of(F.col("d"), F.col("n")).alias("f"))
    assert [r.f for r in kinds.collect()] == ["csv", "xlsx", None]
    assert R.edm_schema('<EntityType Name="A"><Property Name="Id" Type="Edm.Int32"/><Property Name="At" Type="Edm.DateTimeOffset"/></EntityType>', "A") == "`Id` int, `At` timestamp"
    (tmp_path / "p.json").write_text('{"result": {"records": [{"a": 1, "b": "x"}, {"a": 2}]}}')
    assert [tuple(r) for r in R.json_pages(spark, str(tmp_path / "p.json"), "`a` int, `b` string").collect()] == [(1, "x"), (2, None)]


def test_versions_and_files(spark, nation, tmp_path):
    root = str(tmp_path / "t")
    assert W.versions(spark, root) == [] and W.rebuild(nation.limit(3), root) == 1 and W.rebuild(nation, root) == 2
    assert W.current(spark, root).count() == 25 and W.current(spark, root, 1).count() == 3 and W.every_version(spark, root).count() == 28
    assert not W.csv_file(nation.select("n_name"), str(tmp_path / "c")) and W.csv_file(nation, str(tmp_path / "c2"), 24)
    assert next((tmp_path / "c").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    W.downloads(nation, str(tmp_path / "d"), "n_regionkey")
    assert len(list((tmp_path / "d").glob("n_regionkey=*"))) == 5
    one = W.feature_collection(nation, F.to_json(F.struct("n_name")), 3).first()
    assert one.exceeded_transfer_limit and one.collection.count("n_name") == 3
    before = R.listing(spark, root)
    assert N.same_listing(before, before)
    assert {r.table for r in R.tables_with(R.catalog(spark), {"N_NAME", "n_regionkey"}).collect()} >= {"nation"}


def test_entry_and_registry(spark, sf):
    import __spark_entry__ as E

    assert E.entry(spark).columns == ["value", "items"]
    known = E.queries()
    assert set(E.oracle_sql()) <= set(known) and len(known) > 100
