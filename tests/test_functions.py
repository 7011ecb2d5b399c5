"""Golden cases of parsing, likeness, identities and normal forms."""

import datetime

import pytest
from pyspark.sql import functions as F

from silthouse.functions import identity as I
from silthouse.functions import text as T


def of(spark, f, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_numbers_in_text(spark):
    assert of(spark, T.as_int, "3287.0", "00043", "", "א", None) == [3287, 43, None, None, None]
    assert [x and float(x) for x in of(spark, T.number, "1,234.5 ₪", "1-2", "none", "-7")] == [1234.5, None, None, -7.0]


def test_house_numbers(spark):
    assert of(spark, T.house_number, "00043", "12א", "5-7", "דוד אבידן 10", None) == [43, 12, 5, 10, None]
    assert of(spark, T.house_suffix, "00043", "12א", "5-7", "דוד אבידן 10") == [None, "א", None, None]


def test_parcel_keys(spark):
    rows = spark.createDataFrame([("6390", "", "308"), ("6390", "2", "308"), ("", "1", "2")], "a string, b string, c string")
    assert [r.k for r in rows.select(T.parcel_key(F.col("a"), F.col("b"), F.col("c")).alias("k")).collect()] == ["6390-0-308", "6390-2-308", None]
    assert of(spark, lambda c: T.parcel_parts(c)["parcel"], "6390-0-308", "x") == [308, None]


def test_normal_forms(spark):
    assert of(spark, T.norm, "תל אביב-יפו", "New  York (NY)", None) == ["תלאביביפו", "newyorkny", None]
    assert of(spark, T.no_parens, "Haifa (district) north") == ["Haifa north"]
    assert of(spark, T.plain_name, "  O'Neil-Smith ") == ["oneil smith"]
    assert of(spark, lambda c: T.strip_type(c, ["street", "st", "street of"]), "street of lights", "st ab") == ["lights", "st ab"]
    assert of(spark, T.clitic_tokens, "Hello ab")[0] == ["hello", "ello", "ab"]


def similar(spark, a, b, organisation=False):
    row = spark.createDataFrame([(a, b)], "a string, b string")
    x, y = T.name_tokens(F.col("a"), organisation), T.name_tokens(F.col("b"), organisation)
    return row.select(T.similarity(F.col("a"), F.col("b"), x, y, organisation)).first()[0]


def test_similarity(spark):
    assert similar(spark, "Cohen David", "David  Cohen") == 0.97
    assert similar(spark, "Anna Levi", "Zoe Brown") < 0.85
    assert similar(spark, "Acme Trading Company of Ghent", "Acme", True) < 0.85  # one token inside another name tells little
    assert similar(spark, "Acme Trading Ghent", "Acme Trading", True) == 0.88
    assert round(similar(spark, "Acme Trading Ghent Port", "Acme Trading Ghent", True), 6) == 0.8875
    assert similar(spark, "a1 b1 c1 d1 e1", "a1 b1", True) < 0.85
    assert similar(spark, "same", "SAME") == 1.0
    assert of(spark, lambda c: T.block_key(T.name_tokens(c)), "bob alexander", "") == ["al", None]


def test_cells(spark):
    day = datetime.date
    assert of(spark, T.sheet_date, "25569", "2024-03-01T10:00", "3.4.2021", "3.4.21", "on 03/04/2021 at", "99999", "31.2.2020", "") == [day(1970, 1, 1), day(2024, 3, 1), day(2021, 4, 3), day(2021, 4, 3), day(2021, 4, 3), None, None, None]
    assert of(spark, T.sheet_time, "0.5", "9:30", "09:30:15", "7", "25", "x") == ["12:00", "09:30", "09:30", "07:00", None, None]


def test_urls(spark):
    assert of(spark, T.url_identity, "https://WWW.Example.com/a/b/?utm_source=x&b=2&a=1#top", "http://h/#/route") == ["example.com/a/b?a=1&b=2", "h#/route"]
    assert of(spark, T.path_key, "https://www.example.com/a/?b=2") == ["example.com/a"]


def test_hashes_take_null_for_empty(spark):
    rows = spark.createDataFrame([("x", None, "180"), ("x", "", "180.0")], "a string, b string, c string")
    a, b = rows.select(I.content_hash(["a", "b"]).alias("h"), I.row_hash(["b", "a"]).alias("r"), I.row_hash(["a", "b"]).alias("s"), I.repair_hash(["a", "b", "c"]).alias("t"), I.row_hash(["a", "c"], stamp="c").alias("u")).collect()
    assert a == b and a.r == a.s
    assert rows.select(I.content_hash(["a", "c"])).distinct().count() == 2


@pytest.mark.parametrize("names,want", [(["a", "A", "", "a"], ["a", "A_1", "col_3", "a_2"]), (["é" * 40], ["é" * 31])])
def test_headers(names, want):
    assert I.clean_headers(names) == want


def test_registry_scores(spark, sf):
    from itertools import combinations

    from silthouse.functions import fuzzy as Z
    from silthouse.plans import registry

    def longest(a, b):
        subs = {""}
        for c in a:
            subs |= {s + c for s in subs}
        return max((len(s) for s in subs if _is_sub(s, b)), default=0)

    for a, b in combinations(["", "abc", "acb", "bca x", "cabba", "xabc"], 2):
        assert Z.common_length(a, b) == longest(a, b)
    assert Z.ratio("", "") == 1.0 and Z.partial_ratio("abc", "xxabcxx") == 1.0 and Z.partial_ratio("", "a") == 0.0
    assert Z.score("acme ltd", "ltd acme") == 0.95 and Z.score("acme", "the acme company") == 0.9
    got = registry.queries()["registry_scores"](spark, sf).collect()
    assert len(got) == 25 and all(r.score == round(Z.score(r.a, r.b), 6) for r in got)


def _is_sub(s, b):
    rest = iter(b)
    return all(c in rest for c in s)


def test_simplified_lines(spark):
    from silthouse.operators import spatial as X

    assert X.simplified([(0, 0), (1, 0.001), (2, 0), (3, 5), (4, 0)], 0.01) == [(0, 0), (2, 0), (3, 5), (4, 0)]
    rows = spark.createDataFrame([("POLYGON((0 0, 1 0, 2 0, 2 2, 0 2, 0 0))",), ("x",), (None,)], "w string")
    assert [r.s for r in rows.select(X.simplify(F.col("w"), 0.01).alias("s")).collect()] == ["POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", None, None]
