import random
import re

import corpus_pipeline as C
import numpy as np

from silthouse.llm import similar as S


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    sets, of = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(a):
        while of[a] != a:
            a = of[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                of[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(root(k), []).append(i)
    return sorted((min((i for i in x if i is not None), default=None) for x in least.values()), key=str)


def check(docs):
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def edited(words, places, tag):
    return " ".join(f"{tag}{i}" if i in places else w for i, w in enumerate(words))


def test_near_copies(spark, sf):
    """Copies at 0.8 to 0.95 go, those below stay, and so do short texts that only have near fingerprints."""
    rng, rows, alike = random.Random(5), [], 0
    for g in range(12):
        words = [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((100 * g, " ".join(words)))
        for k in range(1, 8):
            rows.append((100 * g + k, edited(words, set(rng.sample(range(300), 2 * k)), f"e{k}x")))
            s = likeness(shingles(rows[-1][1]), shingles(rows[8 * g][1]))
            alike += 0.8 <= s <= 0.95
    rows += [(9000 + k, "same " * 200 + f"end {k} of {'abcd'[k]}") for k in range(4)]
    assert alike >= 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 _set", "2 n")
    check(docs)
    kept = {r.doc_id for r in C.one_of_near_copies(spark, docs, sf).collect()}
    assert kept == set(brute(rows))


def test_edges(spark, odd, empty):
    check(odd)
    check(odd.union(odd).distinct())
    check(spark.createDataFrame([(None, "a b c d"), (None, "q"), (3, "a b c d"), (3, "a b c d"), (4, None), (5, "")], "doc_id long, text string"))
    assert S.one_of_each(empty).count() == 0


def test_large_group_and_pivots(spark, monkeypatch):
    """Chains, where a pivot meets few of its group, with every number of pivots."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, edited(words, set(range(i)), "y")) for i in range(0, 60, 5)] + [(500 + i, f"{' '.join(words[:40])} other {i} " + " ".join(f"z{i}_{j}" for j in range(60))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for pivots in (0, 2):
        monkeypatch.setattr(S, "PIVOTS", pivots)
        check(docs)


def test_documents(docs):
    check(docs)


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(3)
    for n, m, both in ((3, 40, 3), (100, 900, 60), (5000, 5100, 4500), (0, 7, 0)):
        own = rng.integers(-(2**63), 2**63, n + m - both)
        assert both <= S.most_shared(S.sketch(own[:n]), S.sketch(own[n - both :])) <= min(n, m)
    assert S.most_shared(S.sketch(np.zeros(70_000, np.int64)), S.sketch(own)) is None
