"""Edge cases of streets, doors, catalogs and the console's table functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from silthouse.operators import catalog as C
from silthouse.operators import console, cover, graph, spatial, spine
from silthouse.sources import writers

DOOR = "town int, street string, street_key string, house string, entrance string, zip5 string, zip7 string, lon double, lat double, source string"


def test_doors_of_unknown_streets_stay_apart(spark):
    rows = spark.createDataFrame(
        [
            (1, "?", None, "1", None, None, "1000001", None, None, "post"),
            (1, "?", None, "1", None, None, "1000002", None, None, "post"),
            (1, "?", None, "1", None, None, None, 34.5, 31.5, "list"),
            (1, "?", None, "1", None, None, None, None, None, "list"),
            (1, "Elm", "1|elm", "12b", None, None, None, 34.0, 31.0, "list"),
            (1, "Elm", "1|elm", "12 b", None, "10000", "1000003", None, None, "post"),
            (1, "Elm", "1|elm", None, "A", None, None, None, None, "post"),
            (None, "Elm", None, "3", None, None, None, None, None, "post"),
            (1, None, None, "3", None, None, None, None, None, "post"),
        ],
        DOOR,
    )
    got = {r.address_key: r for r in spine.address_spine(rows).collect()}
    assert sorted(got) == sorted(["1|zip:1000001|1|", "1|zip:1000002|1|", "1|xy:31.500000,34.500000|1|", "1|raw:?|1|", "1|1|elm|12b|", "1|1|elm|?|A", "1|raw:|3|"])
    both = got["1|1|elm|12b|"]
    assert (both.lon, both.zip7, both.zip_level, both.sources) == (34.0, "1000003", "address", ["list", "post"])
    assert got["1|raw:?|1|"].street is None
    assert spine.address_spine(rows.limit(0)).count() == 0


def test_zip_tiers(spark):
    rows = [(1, "Elm", "k", str(h), None, z5, z7, None, None, "post") for h, z5, z7 in [(1, "10000", "1000001"), (2, None, None), (3, None, "1000003")]]
    rows += [(2, "Oak", "o", "1", None, "20000", None, None, None, "post"), (2, "Oak", "o", "2", None, "20001", None, None, None, "post"), (2, "Oak", "o", "3", None, None, None, None, None, "post"), (3, "Ash", "a", "1", None, None, None, None, None, "post")]
    doors = spine.address_spine(spark.createDataFrame(rows, DOOR))
    towns = spark.createDataFrame([(3, "30000", "3000000"), (9, "90000", None)], "town int, zip5 string, zip7 string")
    got = {(r.town, r.house_num): (r.zip5, r.zip7, r.zip_level) for r in spine.with_zip_tiers(doors, towns).collect()}
    assert got[1, 2] == ("10000", None, "street")  # the street's only area code, never another door's seven digits
    assert got[1, 3] == (None, "1000003", "address")
    assert got[2, 3] == (None, None, None)  # two area codes on one street
    assert got[3, 1] == ("30000", "3000000", "locality")


def test_street_tiers_and_ties(spark):
    aliases = spark.createDataFrame([(1, "elm", "a", 40), (1, "elm", "b", 90), (1, "streetelm", "c", 10), (1, "oak", "y", 50), (1, "oak", "x", 50)], "town int, variant string, key string, weight int")
    pairs = spark.createDataFrame([(1, "street Elm"), (1, "ELM"), (1, "street oak"), (2, "elm"), (1, None)], "town int, name string")
    got = {(r.town, r.name): r.key for r in spine.street_keys(pairs, aliases, ["street"]).collect()}
    assert got[1, "street Elm"] == "c" and got[1, "ELM"] == "b" and got[1, "street oak"] == "x" and got[2, "elm"] is None


def test_queue_and_released_misses(spark):
    day = datetime.date
    asked = spark.createDataFrame([("a", "hit", 1, day(2024, 1, 1)), ("b", "not_found", 3, day(2024, 1, 1)), ("c", "not_found", 1, day(2024, 1, 1)), ("d", "not_found", 1, day(2024, 2, 28))], "address_key string, status string, attempts int, asked_on date")
    doors = spark.createDataFrame([(k, "s", 1, 1, None) for k in "abcdz"] + [("n", None, 1, 1, None), ("p", "s", 1, 1, 3.0)], "address_key string, street string, house_num int, town int, lon double")
    assert [tuple(r) for r in spine.to_locate(doors, asked, "2024-03-01").collect()] == [("z", False), ("c", True)]
    assert {r.address_key for r in spine.to_locate(doors, spine.without_misses(asked), "2024-03-01").collect()} == {"b", "c", "d", "z"}
    assert {r.address_key for r in spine.without_misses(asked, 3).collect()} == {"a", "c", "d"}


@pytest.mark.parametrize(
    "text, want",
    [("31.5, 34.75", ("point", 31.5, 34.75, None)), ("34.75 31.5", ("point", 31.5, 34.75, None)), ("גוש 6623 חלקה 12", ("parcel", 6623.0, 12.0, None)), ("6623/12", ("parcel", 6623.0, 12.0, None)), ("6423405", ("zip", 6423405.0, None, None)), ("64234", ("zip", 64234.0, None, "block")), ("663", ("block", 663.0, None, None)), ("Elm 3", ("address", None, None, None)), ("  ", ("empty", None, None, None)), (None, ("empty", None, None, None))],
)
def test_sniffed(spark, text, want):
    row = spark.createDataFrame([(text,)], "q string").select(spine.sniffed(F.col("q")).alias("m")).first().m
    assert tuple(row) == want


def test_catalog_helpers(spark, tmp_path):
    assert C.column_sets(["a", "b", "row_hash"], ["b", "a"]) == {"same": True, "missing": [], "added": []}
    assert C.column_sets(["a", "b"], ["b", "c"]) == {"same": False, "missing": ["a"], "added": ["c"]}
    model = {"trees": ["town", "kind"], "bins": ["town"]}
    assert C.fingerprint(" How many  TREES", model) == C.fingerprint("how many trees", dict(reversed(model.items()))) != C.fingerprint("how many bins", model)
    kept = {}
    tables = {"a": spark.range(3), "b": spark.range(5)}
    assert C.profiled(tables, {"a": "1", "b": "2"}, {"a": "1"}, lambda df: df.count(), kept.__setitem__) == ["b"] and kept == {"b": 5}
    latest = spark.createDataFrame([("x", "g", "open"), ("y", "h", "closed"), ("z", "h", None)], "item string, group string, status string")
    pick = lambda mode, value=None, **k: {r.item for r in C.to_sample(latest, mode, value, **k).collect()}
    assert pick("all") == {"x", "y", "z"} and pick("open") == {"x", "z"} and pick("group", "h") == {"y", "z"} and pick("item", "x") == {"x"} and pick("new", known=latest.filter("item = 'x'")) == {"y", "z"}
    with pytest.raises(ValueError):
        pick("some")
    formats = spark.createDataFrame([("a.GeoJSON",), ("b",), ("c.averylongone",), ("d.tar.gz",), (None,)], "n string").select(C.format_of(F.col("n"))).collect()
    assert [r[0] for r in formats] == ["GEOJSON", None, None, "GZ", None]


def test_dual_write_twice_is_once(spark, tmp_path):
    rows, files = str(tmp_path / "rows"), str(tmp_path / "files")
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string")
    assert writers.dual_write(a, rows, files, 1) == 2
    assert writers.dual_write(b, rows, files, 2) == 1
    assert writers.dual_write(b, rows, files, 2) == 1
    assert spark.read.parquet(rows).count() == 3 and spark.read.option("header", True).csv(f"{files}/v=2").count() == 2


def test_table_functions_of_the_console(spark):
    spark.createDataFrame([("a", 34.0, 31.0), ("b", 34.001, 31.0), ("c", 35.0, 31.0)], "id string, lon double, lat double").createOrReplaceTempView("places")
    spark.createDataFrame([("6623-0-12", 6623, 12), ("6623-0-13", 6623, 13)], "parcel_key string, block long, parcel long").createOrReplaceTempView("parcels")
    assert len(console.register_tables(spark)) == 2
    near = console.guarded(spark, "SELECT id FROM sh_places_near(34.0, 31.0, 200) ORDER BY distance_m", set()).collect()
    assert [r.id for r in near] == ["a", "b"]
    assert console.guarded(spark, "SELECT p.parcel_key FROM sh_parcels(6623, 12) AS p", set()).first()[0] == "6623-0-12"
    for sql in ("SELECT * FROM read_anything('x')", "SELECT id FROM sh_places_near(34.0, 31.0, (SELECT max(lon) FROM places))"):
        with pytest.raises(console.Refused):
            console.guarded(spark, sql, set())


def test_geohash_and_polygon_counts(spark):
    rows = spark.createDataFrame([(10.40744, 57.64911), (-180.0, -90.0), (180.0, 90.0), (None, 1.0)], "lon double, lat double")
    assert [r[0] for r in rows.select(spatial.geohash(F.col("lon"), F.col("lat"))).collect()] == ["u4pruy", "000000", "zzzzzz", None]
    points = spark.createDataFrame([(0.5, 0.5), (0.6, 0.5), (5.0, 5.0)], "lon double, lat double")
    shapes = spark.createDataFrame([(1, "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))"), (2, "POLYGON((2 2, 3 2, 3 3, 2 3, 2 2))")], "id int, wkt string")
    assert {tuple(r) for r in cover.points_per_polygon(points, shapes, "id").collect()} == {(1, 2), (2, 0)}


def test_lookup_with_neighbours(spark):
    entities = spark.createDataFrame([("c1", "51", "Acme"), ("p1", None, "Dana Acmeson"), ("p2", None, "Noa")], "id string, number string, name string")
    edges = spark.createDataFrame([("c1", "p2"), ("p1", "c1"), ("p1", "p2"), ("c1", "c1")], "src string, dst string")
    by_number = graph.around(edges, graph.registered(entities, number="51"))
    assert {tuple(r) for r in by_number.collect()} == {("c1", "p2", "c1"), ("p1", "c1", "c1"), ("c1", "c1", "c1")}
    assert [r.id for r in graph.registered(entities, name="acme").collect()] == ["c1", "p1"]
    assert graph.around(edges, entities.limit(0)).count() == 0


def test_csv_encoding_by_all_bytes(spark, tmp_path):
    from silthouse.sources import readers

    line = "plain,words\n" * 1000
    (tmp_path / "late.csv").write_bytes(b"a,b\n" + line.encode() * 400 + "שלום,x\n".encode("windows-1255"))
    rows = readers.csv(spark, str(tmp_path / "late.csv"))
    assert rows.count() == 400_001 and rows.filter("a = 'שלום'").count() == 1
    (tmp_path / "quoted.csv").write_bytes('﻿a,b\n"one\ntwo","say ""x"""\n3,שלום\n'.encode())
    rows = readers.csv(spark, str(tmp_path / "quoted.csv"))
    assert rows.columns == ["a", "b"] and [tuple(r) for r in rows.collect()] == [("one\ntwo", 'say "x"'), ("3", "שלום")]
    assert readers.csv_facts(spark, str(tmp_path / "quoted.csv")) == ("utf-8", True) and readers.csv_facts(spark, str(tmp_path / "late.csv")) == ("windows-1255", False)
    (tmp_path / "empty.csv").write_bytes(b"")
    assert readers.csv_facts(spark, str(tmp_path / "empty.csv")) == ("utf-8", False)


def test_place_tiers_and_two_swaps(spark):
    from silthouse.operators import resolve

    places = spark.createDataFrame([(1, "בנימין (מועצה)", "Binyamin", "Binjamin"), (2, "", None, None), (3, None, "Only", None)], "c int, n string, e string, t string")
    got = {r.variant: (r.code, r.kind, r.weight) for r in resolve.place_aliases(places, "c", "n", "e", "t").collect()}
    assert got["בנימין"] == (1, "no_paren", 90) and got["בבנימין"] == (1, "prefix", 50) and got["מאבנימין"] == (1, "admin_prefix", 55) and got["binjamin"] == (1, "translit", 70)
    assert got["only"] == (3, "english", 70) and all(c != 2 for c, _, _ in got.values())
    names = spark.createDataFrame([("תתא", 1), ("טבת", 2), ("תבט", 3), ("", 4)], "variant string, code int")
    swaps = {r.variant: r.code for r in resolve.spelling_swaps(names).collect()}
    assert swaps == {"טתא": 1, "תטא": 1, "טטא": 1}  # the others are ambiguous or real


def test_prefix_hits(spark):
    from silthouse.functions.text import prefix_hits

    rows = spark.createDataFrame([(["trees", "in", "town"], "Treehouses, towns and inns"), (["שמאויות"], "שמאות 2024"), ([], "x"), (["town"], None)], "q array<string>, t string")
    got = [r[0] for r in rows.select(prefix_hits(F.col("q"), F.col("t"))).collect()]
    assert got == [["towns", "treehouses"], ["שמאות"], [], None]
