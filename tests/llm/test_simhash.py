import re

import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from silthouse.llm import simhash as S


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [(i, print_of(t)) for i, t in rows]
    of = list(range(len(prints)))

    def root(a):
        while of[a] != a:
            a = of[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 3:
                x, y = sorted((root(a), root(b)))
                of[y] = x
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, f"{p:016x}", least.get(root(k))) for k, (i, p) in enumerate(prints)), key=str)


def check(docs):
    got = sorted(map(tuple, S.near_duplicates(docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    return got


def test_matches_brute_force(docs):
    got = check(docs)
    assert any(i != c for i, _, c in got)


def test_edges(spark, odd, empty):
    check(odd)
    check(spark.createDataFrame([(None, "a b c d"), (None, "q"), (3, "a b c d"), (3, "a b c d"), (4, None)], "doc_id long, text string"))
    assert S.near_duplicates(empty).count() == 0
    assert S.one_of_each(empty).columns == empty.columns


def test_one_of_each(spark, odd, docs):
    for table in (odd.selectExpr("text", "doc_id", "1 _fp", "2 _body", "3 _n", "4 u"), docs, docs.union(docs)):
        kept = S.one_of_each(table)
        assert kept.columns == table.columns
        want = {c for _, _, c in brute([(r.doc_id, r.text) for r in table.collect()])}
        assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_every_near_print_shares_a_key(x, flips):
    y = x
    for b in set(flips):
        y ^= 1 << b
    probe = S.keys(np.array([x], np.uint64), True)[1]
    index = S.keys(np.array([y], np.uint64), False)[1]
    assert set(probe.tolist()) & set(index.tolist())


def test_long_chains(spark):
    from silthouse.operators.graph import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 30)}}
