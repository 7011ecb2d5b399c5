import hashlib
import re
import tracemalloc

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from silthouse.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    tests = {}
    for i, t in items:
        w = words(t)
        for a in range(max(len(w) - 9, 1) if w else 0):
            tests.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
    sizes = {len(x) for x in tests}
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for a in range(len(w)):
            for n in sizes:
                got = tests.get(tuple(w[a : a + n])) if a + n <= len(w) else None
                if got:
                    found |= got
                    hit |= set(range(a, a + n))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def check(docs, bench):
    got = {r[0]: tuple(r[1:6]) for r in D.report(docs, bench).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got == want
    return got


def test_matches_brute_force(spark, docs, sf):
    got = check(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert any(x[4] for x in got.values()) and not all(x[4] for x in got.values())


def test_edges(spark, odd, empty):
    items = [(1, "lazy dog and runs"), (2, None), (3, "quick brown fox jumps over the lazy dog and runs FAR"), (4, "!!"), (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = check(odd, bench)
    assert got[11][4] and got[7][4] and not got[4][4]
    check(odd, spark.createDataFrame([(1, "one"), (2, "a b")], bench.schema))
    check(odd, bench.limit(0))
    assert D.report(empty, bench).count() == 0


def test_blocks_and_clean(spark, odd, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 20)
    bench = spark.createDataFrame([(1, "lazy dog and runs"), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id long, text string")
    check(odd, bench)
    kept = D.clean(odd, bench)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in odd.collect()} - {7, 8, 11, 12}


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "z a b c d e f g h i j k l q")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "x a b c d e f g h i j k l m")], "item_id long, text string")
    r = D.report(docs, bench).collect()[0]
    assert (r.longest_words, r.longest_item, r.longest_at) == (12, "5", 1)


def brute_longest(text, items):
    w, best = words(text), (0, "", 0)
    for item, other in items:
        t = words(other)
        for b in range(max(len(t) - 9, 1) if t else 0):
            for a in range(len(w)):
                n = next((k for k in range(min(len(w) - a, len(t) - b)) if w[a + k] != t[b + k]), min(len(w) - a, len(t) - b))
                if n >= min(10, len(t)):
                    best = max(best, (n, str(item), -a))
    return (best[0], best[1], -best[2]) if best[0] else (0, None, None)


def test_longest_match_of_each_copy(spark):
    """Copies in one slice, whole and cut short, all report their own longest match."""
    item = " ".join(f"q{k}" for k in range(50))
    texts = [f"a {item} z", f"a {item} z", item, f"b b {item[:100]} y", f"{item[20:150]} x {item[60:]}", "nothing of it", f"c {item} m n", f"{item} m", "q1 q2"]
    items = [(5, item), (6, f"{item[:60]} other words"), (7, f"k {item} m"), (8, "m n")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for table in (docs.coalesce(1), docs.repartition(5)):
        got = {r.doc_id: (r.longest_words, r.longest_item, r.longest_at) for r in D.report(table, bench).collect()}
        assert got == {i: brute_longest(t, items) for i, t in enumerate(texts)}
        assert got[0] == got[1] == (50, "7", 1)


def test_longest_match_of_documents(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    hit = {r.doc_id: (r.longest_words, r.longest_item, r.longest_at) for r in D.report(docs, bench).filter("contaminated").collect()}
    few = sorted(hit)[:4]
    assert few and {i: hit[i] for i in few} == {r.doc_id: brute_longest(r.text, items) for r in docs.collect() if r.doc_id in few}


@given(st.lists(st.lists(st.integers(1, 3), max_size=12), min_size=1, max_size=6))
def test_suffix_array(texts):
    ids = np.array([x for t in texts for x in [*t, 0]], np.int32)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    suffixes = {int(first[k]) + i: t[i:] for k, t in enumerate(texts) for i in range(len(t))}
    got = D.suffix_array(ids, first).tolist()
    assert sorted(got) == sorted(suffixes)
    assert [suffixes[i] for i in got] == sorted(suffixes.values())


def test_sections_and_many_blocks(spark, monkeypatch):
    """Long texts and items in sections, and a benchmark of many blocks, give what whole ones give."""
    item = " ".join(f"q{k}" for k in range(60))
    texts = [f"a {item} z {'pad ' * 90}{item[9:80]}", "x " * 300, None, f"{'w ' * 120}{item}", "y" * 900 + " " + item]
    docs = spark.createDataFrame([(2**62 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item[40:]), (3, "x " * 400), (4, "pad pad z"), (5, None)], "item_id long, text string")
    want = check(docs, bench)
    monkeypatch.setattr(D, "SHARD_BYTES", 300)
    monkeypatch.setattr(D, "BLOCK_BYTES", 150)
    assert check(docs, bench) == want
    assert longest(docs, bench) == {i: brute_longest(t, [(k, x) for k, x in [(1, item), (2, item[40:]), (3, "x " * 400), (4, "pad pad z")]]) for i, t in zip(range(2**62, 2**62 + 5), texts)}


def longest(docs, bench):
    return {r.doc_id: (r.longest_words, r.longest_item, r.longest_at) for r in D.report(docs, bench).collect()}


def test_longest_matches_over_section_ends(spark, monkeypatch):
    """Sections of documents and of items, also both at once and at different words, cut no match short."""
    rng = np.random.default_rng(3)
    some = lambda n, k: " ".join(f"w{x}" for x in rng.integers(0, k, n).tolist())
    a, b, c = some(300, 400), some(200, 3), "x " * 150
    texts = [a, f"{some(37, 50)} {a} {some(60, 50)}", f"{b} {a[:900]} {b}", c, c[:120] + a[300:], " ".join(a.split()[20:280]), f"{a} {a}", None, "y " * 90 + "x " * 80, b[9:] + " " + c]
    items = [(1, a), (2, f"q {a} q"), (2, " ".join(a.split()[100:])), (3, b), (4, c + a), (5, None), (6, "w1 w2"), (7, " ".join(a.split()[:150]))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    want = {i: brute_longest(t, items) for i, t in enumerate(texts)}
    assert longest(docs, bench) == want and want[0] == (300, "4", 0)
    for shard, block in ((250, 400), (400, 1 << 20), (150, 150)):
        monkeypatch.setattr(D, "SHARD_BYTES", shard)
        monkeypatch.setattr(D, "BLOCK_BYTES", block)
        assert longest(docs, bench) == want, (shard, block)
        check(docs, bench)


def test_long_item_takes_linear_memory():
    rng = np.random.default_rng(1)
    item = " ".join(f"w{k}" for k in rng.integers(0, 5000, 170_000).tolist())  # about 1 MB
    tracemalloc.start()
    block = D.Block([("a", item), ("b", "x " * 200_000)], 10)
    words = D.Words.of(*D.common.byte_view(D.pa.array([item[3000:90_000], "u v " + item[:300]])))
    place, window = block.search(words)
    most, _ = block.longest(words, place, window)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20 and most.max() == words.first[1] - 1 - (item[2999] != " ")
