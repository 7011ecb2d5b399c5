"""Skeletons of words, kinds of a result's columns, queries along a search path."""

import pytest
from pyspark.sql import functions as F

from silthouse.functions.text import prefix_hits, skeleton
from silthouse.operators import console, profile


def test_skeletons(spark):
    cases = {"גירושין": "גרש", "התגרשו": "גרש", "שמאויות": "שמא", "שמאות": "שמא", "שנים": "שנ", "": "", "ים": "ים", "תור": "תר", "התו": "הת", "יוים": "י", "word": "word"}
    got = spark.createDataFrame([(c,) for c in [*cases, None]], "w string").select("w", skeleton(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == {**cases, None: None}


def test_forms_of_a_root_are_hits(spark):
    rows = spark.createDataFrame([(["גירושין"], "מספר זוגות שהתגרשו או התגרשו"), (["גירושין"], "מגרש משחקים"), (["שניצל", "שנים"], "לוח שנות"), (["שנים"], None)], "q array<string>, t string")
    assert [r[0] for r in rows.select(prefix_hits(F.col("q"), F.col("t"))).collect()] == [["התגרשו", "תגרשו"], ["מגרש"], [], None]  # both readings of a word that may begin with an article


def test_result_kinds(spark):
    rows = [(1, "1", " -2.50 ", "2024-01", "02/29/2024", "30.02.2024", 1.5, True), (2, "", None, "2024-02-03 04:05", "", "", float("nan"), None), (3, "x", "3", "2024-02-03T1", None, "01.02.2024", None, False)]
    df = spark.createDataFrame(rows, "`a.b` long, b string, c string, d string, e string, f string, g double, h boolean").orderBy("`a.b`")
    kinds = lambda *a: {r["column"]: r.kind for r in profile.result_kinds(*a).collect()}
    assert kinds(df) == {"a.b": "number", "b": "text", "c": "number", "d": "date", "e": "date", "f": "text", "g": "text", "h": "text"}
    assert kinds(df, 1)["b"] == "number" and kinds(df, 60, 2)["b"] == "number"  # what comes later isn't looked at
    assert set(kinds(df.limit(0)).values()) == {"text"}


def test_search_path(spark, tmp_path):
    for schema, n in (("path_a", 1), ("path_b", 2)):
        spark.sql(f"CREATE DATABASE {schema} LOCATION '{tmp_path}/{schema}'")
        spark.range(n).write.saveAsTable(f"{schema}.both", path=f"{tmp_path}/{schema}-both")
    spark.range(3).write.saveAsTable("path_b.own", path=f"{tmp_path}/own")
    spark.range(9).createOrReplaceTempView("session_view")
    count = lambda sql, path: console.across(spark, sql, path).first()[0]
    assert count("SELECT count(*) FROM both", "path_a, path_b") == 1 and count("SELECT count(*) FROM both", "path_b,path_a") == 2
    assert count("SELECT count(*) FROM Own JOIN path_b.both USING (id)", "path_a, path_b") == 2
    assert count("WITH own AS (SELECT 1) SELECT count(*) FROM own", "path_a") == 1
    for sql, path in [("SELECT * FROM own", "path_a"), ("SELECT * FROM path_b.own", "path_a"), ("SELECT * FROM session_view", "path_a"), ("SELECT * FROM spark_catalog.path_a.both", "path_a"), ("DROP TABLE path_a.both", "path_a"), ("SELECT * FROM `path_a.both`", "path_b"), ("SELECT 1", "path_a; x"), ("SELECT 1", " , "), ("SELECT * FROM parquet.`/tmp/x`", "path_a")]:
        with pytest.raises(console.Refused):
            console.across(spark, sql, path)
