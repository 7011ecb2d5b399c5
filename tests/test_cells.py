"""Edges of words, profiles, shapes and stamps that the registered queries don't meet."""

import datetime
import re

from pyspark.sql import functions as F

from silthouse.operators import profile as P
from silthouse.operators import search as S
from silthouse.operators import spatial as X
from silthouse.streaming import ingest as N

TEXTS = ["", None, "Hand-made hands, HANDLE; the unhand", "שלום עולם שלומי", "don't x2 x", "été étés Étage", "a.b 12 123 hand1"]


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_words_are_found_as_in_lists_of_them(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    for w in ("hand", "HAND", "x", "12", "שלום", "ét", "don't", "", "a.b", "zz"):
        for whole in (False, True):
            got = dict(df.select("id", S.has_word(F.col("text"), w, whole)).collect())
            for i, t in enumerate(TEXTS):
                want = None if t is None else any(x == w.lower() if whole and w else x.startswith(w.lower()) for x in words(t))
                assert got[i] == want, (w, whole, t)
    ranks = {r.id: r.hits for r in S.ranked(df, "id", "text", ["hand", "x", "b.c"]).collect()}
    assert ranks == {2: 3, 4: 2, 6: 1}
    found = df.filter(S.boolean(F.col("text"), ["and", ["or", "hand", "'x'"], ["not", "unh"]])).select("id").collect()
    assert sorted(r.id for r in found) == [4, 6]


def test_profiles_go_by_type(spark):
    rows = [(1, 1.5, "1,000", datetime.date(2024, 1, 1), True, [1]), (None, float("nan"), " ", None, None, None), (3, float("inf"), "x", None, False, []), (3, 2.5, None, None, None, None)]
    df = spark.createDataFrame(rows, "`a.b` int, f double, t string, d date, k boolean, l array<int>")
    got = {r["column"]: r for r in P.profile(df).collect()}
    assert (got["a.b"].filled, got["a.b"].numeric_share, got["a.b"].min, got["a.b"].max) == (3, 1.0, 1.0, 3.0)
    assert (got["f"].filled, got["f"].numeric_share, got["f"].max, got["f"].avg) == (4, 0.5, 2.5, 2.0)
    assert (got["t"].filled, got["t"].numeric_share, got["t"].max) == (2, 0.5, 1000.0)
    assert (got["d"].filled, got["d"].numeric_share, got["d"].max, got["k"].distinct_estimate, got["l"].filled) == (1, 0.0, None, 2, 2)
    none = P.profile(df.limit(0)).collect()
    assert {r.rows for r in none} == {0} and {r.numeric_share for r in none} == {None}


def test_grid_and_shapes(spark):
    rows = spark.createDataFrame([(35.204516944444, 31.734393611111), (34.8, 32.1), (35.9, 29.5), (None, 31.0)], "lon double, lat double")
    grid = rows.withColumn("g", X.to_grid(F.col("lon"), F.col("lat"))).withColumn("p", X.from_grid(F.col("g.x"), F.col("g.y"))).collect()
    assert abs(grid[0].g.x - 219529.584) < 1e-3 and abs(grid[0].g.y - 626907.390) < 1e-3 and grid[3].g.x is None
    assert all(abs(r.p.lon - r.lon) < 1e-7 and abs(r.p.lat - r.lat) < 1e-7 for r in grid[:3])
    shapes = ["POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", None, "", "CIRCLE(1)", "POLYGON((0 0, 0 0))"]
    points = [r.p for r in spark.createDataFrame([(s,) for s in shapes], "wkt string").select(X.interior(F.col("wkt")).alias("p")).collect()]
    assert tuple(points[0]) == (2.0, 2.0) and points[1:4] == [None] * 3 and tuple(points[4]) == (0.0, 0.0)


def test_runs_are_due_with_and_without_a_zone(spark):
    runs = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 00:00:00"), ("b", "2024-01-02 20:00:00")], "mode string, at string")
    for kind in ("timestamp", "timestamp_ntz"):
        out = N.due(runs.withColumn("at", F.col("at").cast(kind)), "mode", "at", F.lit("2024-01-03").cast("timestamp"), F.lit(24)).collect()
        assert {r["mode"]: r.due for r in out} == {"a": True, "b": False}
