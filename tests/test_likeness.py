"""Similarity joins against all pairs, with names that meet only by single letters or by one rare word."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from silthouse.functions import fuzzy as Z
from silthouse.functions.text import company_name
from silthouse.operators import likeness as L
from silthouse.operators import resolve as R


def spoilt(rng, name):
    """A name after some random edits."""
    out = list(name)
    for _ in range(rng.randrange(4)):
        k = rng.randrange(3, len(out)) if len(out) > 3 else len(out)
        out[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", " ", "ab"])
    words = "".join(out).split()
    if rng.random() < 0.3:
        tail = words[1:]
        rng.shuffle(tail)
        words = words[:1] + tail
    return " ".join(words + ["abba"] * (rng.random() < 0.2))


@pytest.mark.parametrize("least", [0.7, 0.85, 0.9, 0.96])
def test_registry_pairs_are_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    base = ["".join(rng.choices("ab c", k=rng.randrange(3, 26))) for _ in range(30)] + ["aaa", "aaaa", "aaaaaaa", "ab", "abcabcabcabc"]
    left = sorted({" ".join(("aab" * (rng.random() < 0.7) + n).split()) for n in base})
    right = sorted({spoilt(rng, n) for n in left for _ in range(4)})
    got = L.registry_pairs(*(spark.createDataFrame([(n,) for n in [*names, None, "", names[0]]], "plain string") for names in (left, right)), least).collect()
    want = {(a, b): Z.score(a, b) for a in left for b in right if a != b and len(a) > 2 and len(b) > 2 and a[:3] == b[:3] and Z.score(a, b) >= least}
    assert len(got) == len(want) and {(r.a, r.b): r.score for r in got} == want and len(want) > 10


@pytest.mark.parametrize("least,organisation", [(0.7, False), (0.85, False), (0.85, True), (0.95, True)])
def test_blocked_pairs_are_all_pairs(spark, least, organisation):
    rng = random.Random(7)
    words = ["cohen", "levi", "mizrahi", "peretz", "biton", "dahan", "avra", "avram", "frida", "fridman"]
    names = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(120)] + [(200, None), (201, ""), (202, "x"), (203, "Cohen-Levi"), (204, "levi cohen")]
    rows = spark.createDataFrame(names, "id long, name string")
    got = R.blocked_pairs(rows, "id", "name", least, organisation=organisation).collect()
    from silthouse.functions.text import block_key, name_tokens, similarity

    tokens = [name_tokens(F.col(c), organisation) for c in ("a.name", "b.name")]
    every = rows.alias("a").join(rows.alias("b"), F.expr("a.id < b.id")).select(
        "a.id", F.col("b.id").alias("other"), *(F.array_join(t, " ").alias(f"t{k}") for k, t in enumerate(tokens)), *(block_key(t).alias(f"k{k}") for k, t in enumerate(tokens)), similarity(F.col("a.name"), F.col("b.name"), *tokens, organisation).alias("s")
    )
    sets = {(r.id, r.other): (r.t0, r.t1, r.s) for r in every.collect() if r.k0 is not None and r.k0 == r.k1 and r.s is not None and r.s >= least}
    first = {}
    for i, n in sorted(names, key=lambda x: x[0]):
        first.setdefault(" ".join(sorted(w for w in (n or "").lower().replace("-", " ").split() if len(w) > 1)), i)
    want = {(a, b): s for (a, b), (s0, s1, s) in sets.items() if (s0 != s1 and first[s0] == a and first[s1] == b) or (s0 == s1 and first[s0] == a)}
    assert {(r.a, r.b): r.score for r in got} == want and len(got) == len(want) > 5


def test_bounds_are_checked(spark):
    one = spark.createDataFrame([(1, "a b")], "id long, plain string")
    for call in (lambda: R.blocked_pairs(one, "id", "plain", 0.6), lambda: L.registry_pairs(one, one, 0.85, prefix=1), lambda: L.registry_pairs(one, one, 0.5)):
        with pytest.raises(ValueError):
            call()


def test_company_names(spark):
    cases = {"אגד חברה ל תחבורה בע\"מ": "אגד תחבורה", "קבוצת דלק (בע\"מ)": "דלק", "בנק לישראל": "בנק", "ישראלי": "ישראלי", "  A   B ": "A B", "בית השקעות ילין": "ילין", "": ""}
    got = spark.createDataFrame([(c,) for c in cases], "n string").select("n", company_name(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == cases
    assert spark.range(1).select(company_name(F.lit(None).cast("string")).alias("c")).first().c is None


def test_two_passes(spark):
    names = spark.createDataFrame([(1, "Acme Tools"), (2, "Acme Tool"), (3, "acne tools"), (4, None), (5, "x"), (6, "Zeta")], "id long, name string")
    known = spark.createDataFrame([(9, "acme tools"), (8, "ACME-tools"), (7, "acme tolls"), (None, "zeta")], "number long, name string")
    got = {r.id: (r.number, r.how) for r in R.two_pass_registry(names, known, "id", "name", "number").collect()}
    assert got == {1: (8, "exact"), 2: (8, "fuzzy")}


def test_registry_is_not_sent_through_the_driver(spark):
    """No join may broadcast names or their letter pairs, however small Spark takes the tables to be: any broadcast fails here."""
    names = spark.range(400).select("id", F.substring(F.md5(F.col("id").cast("string")), 1, 24).alias("name"))
    known = names.select(F.col("id").alias("number"), F.substring("name", 1, 23).alias("name"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        got = R.two_pass_registry(names, known, "id", "name", "number").collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(got) == 400 and all((r.number, r.how, r.score) == (r.id, "fuzzy", 0.978723) for r in got)


def test_common_word_makes_few_candidates(spark):
    """A word in all names is nobody's rarest: candidates grow with the names, not with their square."""
    for n in (500, 1000):
        rows = spark.range(n).select("id", F.lit(0).alias("b"), F.array(F.lit("shared"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("w"))
        own = L._rarest(rows.withColumn("_row", F.col("id")).withColumn("_set", F.col("w")), ["b"], "_set", F.lit(1))
        assert own.groupBy("piece").count().agg(F.max("count")).first()[0] == 1
    assert list(itertools.islice((r.piece for r in own.filter("piece = 'shared'").collect()), 1)) == []


def test_score_is_the_best_of_three():
    def partial(a, b):
        short, long = sorted((a, b), key=len)
        return max(Z.ratio(short, long[max(0, k) : k + len(short)]) for k in range(1 - len(short), len(long))) if short else float(not long)

    rng = random.Random(5)
    for _ in range(20000):
        a, b = ("".join(rng.choices("ab ", k=rng.randrange(12))) for _ in range(2))
        assert Z.partial_ratio(a, b) == partial(a, b), (a, b)
        want = Z.ratio(a, b)
        want = want if want >= 0.95 else max(want, 0.95 * Z.ratio(*(" ".join(sorted(x.split())) for x in (a, b))))
        assert abs(Z.score(a, b) - (want if want >= 0.9 else max(want, 0.9 * partial(a, b)))) < 1e-8, (a, b)
