import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from silthouse.llm import lines as L


def brute(rows, least):
    """Every earlier copy of every run, by comparing all places."""
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})
    split = [t.split("\n") for *_, t in docs]
    places = [(d, p) for d, x in enumerate(split) for p in range(len(x))]
    gone = [set() for _ in split]
    for k, (d, p) in enumerate(places):
        for e, q in places[:k]:
            n = 0
            while p + n < len(split[d]) and q + n < len(split[e]) and split[d][p + n] == split[e][q + n]:
                n += 1
            if n and sum(len(x) + 1 for x in split[d][p : p + n]) >= least:
                gone[d] |= set(range(p, p + n))
    out = {}
    for (null, i, t), own, g in zip(docs, split, gone):
        runs = sum(1 for p in g if p - 1 not in g)
        kept = "\n".join(x for p, x in enumerate(own) if p not in g)
        out[None if null else i, t] = (len(own), len(g), runs, hashlib.sha256(kept.encode()).hexdigest())
    return sorted(((i, *out[i, t or ""]) for i, t in rows), key=str)


def check(docs, least=L.MIN_CHARS):
    got = sorted(map(tuple, L.report(docs, least=least).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], least)
    return got


def test_against_sql(spark, sf, docs):
    documents = duckdb.read_parquet(f"{sf}/documents.parquet")
    want = duckdb.sql(L.SQL).fetchall()
    assert documents and sorted(map(tuple, L.report(docs).collect())) == sorted(want)
    assert sum(r[2] for r in want)


def test_edges(spark, odd, empty):
    check(odd, 4)
    check(empty)
    passage = "\n".join(f"line {k} of a passage" for k in range(12))
    rows = [(9, f"a\n{passage}\nb"), (2, f"c\n{passage}"), (2, f"c\n{passage}"), (7, passage), (8, passage), (None, passage), (4, "x\n" * 150), (5, "x\n" * 150), (6, f"{passage}\n{passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict((r[0], r[1:]) for r in check(docs))
    assert got[2][1] == 0 and got[9][1] == 12 and got[8][1] == 12 and got[4][1] > 0
    kept = L.deduplicated(docs.selectExpr("doc_id", "text", "1 pos", "2 _t1", "3 cuts", "4 _id", "5 _rest"))
    assert kept.columns == ["doc_id", "text", "pos", "_t1", "cuts", "_id", "_rest"] and kept.first()["_t1"] == 2
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id == 9) == [(9, "a\nb")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "", "ccc"]), max_size=12), min_size=1, max_size=5))
def test_any_lines(spark, texts):
    check(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), 6)
