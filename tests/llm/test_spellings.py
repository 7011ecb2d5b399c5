import re
from collections import Counter
from zlib import crc32

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silthouse.llm import spellings as S


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=5, slip=199):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=str)


def check(docs, **more):
    got = S.variants(docs, **more).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], **more)
    return {r.word: r for r in got.collect()}


def test_against_sql(spark, sf, docs):
    documents = duckdb.read_parquet(f"{sf}/documents.parquet")
    want = duckdb.sql(S.SQL).fetchall()
    got = [tuple(r) for r in S.op12_spelling_variants(spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert documents and sorted(got, key=str) == sorted(want, key=str) and sum(r[4] for r in want)


def test_edges(spark, odd, empty):
    check(odd.withColumnRenamed("hash", "word"), least=1)
    assert S.variants(empty).collect() == []
    long = "ab" * 3000
    words = ["letters"] * 200 + ["leters"] * 30 + ["lettters"] * 6 + ["lettrs"] * 5 + ["Letters"] * 3 + ["lätters"] * 5 + [long, long + "a", long[:-1] + "c"] * 5 + ["aaaaaaa"] * 5 + ["aaaaaa"] * 30
    rows = [(None, " ".join(words)), (1, None), (1, ""), (2, "LETTERS-leters"), (2, "LETTERS-leters")]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got["leters"].form == "letters" and got["lettrs"].form == "letters" and got["lettters"].root == "letters" and got[long].n_near == 2


def test_chains_have_one_root(spark):
    words = ["abcdefg"] * 700 + ["abcdef"] * 130 + ["abcdeg"] * 20 + ["abcdeh"] * 5 + ["abcxeh"] * 1
    got = check(spark.createDataFrame([(0, " ".join(words))], "doc_id long, text string"), least=1)
    assert {got[w].root for w in ("abcdef", "abcdeg", "abcdeh")} == {"abcdefg"}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text("abé", min_size=5, max_size=8), max_size=60))
def test_any_words(spark, words):
    check(spark.createDataFrame([(i % 3, " ".join(words[i::3])) for i in range(3)], "doc_id long, text string"), least=1)


def test_collisions_join_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(0, " ".join(["letters", "leters", "mitten", "mittens", "kittens", "sorting"] * 5))], "doc_id long, text string")
    want = brute([(0, docs.first().text)])
    keyed = S.keyed
    monkeypatch.setattr(S, "keyed", lambda words: keyed(words).withColumn("key", F.lit(7)))
    assert sorted(map(tuple, S.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str) == want
