import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from silthouse.llm import substrings as S


def brute(rows, least):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[a : a + least] for t in texts for a in range(len(t) - least + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for a in range(len(t) - least + 1):
            if seen[t[a : a + least]] > 1:
                gone[a : a + least] = b"\1" * least
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(docs, **how):
    got = sorted(map(tuple, S.report(docs, **how).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], how.get("least", S.LEAST))
    return got


def test_documents(docs):
    assert any(0 < r[2] < r[1] for r in check(docs))


def test_edges(spark, odd, empty, monkeypatch):
    check(odd)
    check(empty)
    base = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(700))
    rows = [(k, f"{'z' * k}{base[k % 5:]}{k}") for k in range(30)] + [(40, base), (40, base), (None, base[:399]), (41, "é" * 300), (42, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 start", "2 copies")
    check(docs)
    monkeypatch.setattr(S, "WIDE", 3)  # the way for anchors with very many kinds of records
    check(docs)
    kept = S.deduplicated(docs).collect()
    assert len(kept) == docs.count() and all(len(r.kept) == r.n_bytes - r.n_removed for r in kept)


def test_sections_of_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    long = "".join(chr(97 + c) for c in rng.integers(0, 26, 9000))
    monkeypatch.setattr(S, "SLICE_BYTES", 100)
    check(spark.createDataFrame([(1, long), (2, long[3000:4500] + "x" + long[100:900]), (3, long[7:])], "doc_id long, text string"))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=8))
def test_small_windows(spark, texts):
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least=9, gram=4)


@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(c % 3 for c in b)), min_size=1, max_size=9))
def test_two_stage_sorting(strings):
    body, ends = b"".join(strings), np.cumsum([len(s) for s in strings])
    order = S.two_stage(body, ends, ends, 50)
    end_of = np.repeat(ends, [len(s) for s in strings])
    suffixes = [body[i : end_of[i]] for i in order]
    assert sorted(order.tolist()) == list(range(len(body)))
    assert suffixes == sorted(suffixes)
    shared = S.common_prefixes(body, order, ends, 50)
    for k in range(1, len(suffixes)):
        n = next((j for j, (a, b) in enumerate(zip(suffixes[k - 1], suffixes[k])) if a != b), min(len(suffixes[k - 1]), len(suffixes[k])))
        assert shared[k] == n


def near_copies(n):
    """Copies of a text with a few other bytes in each."""
    rng = np.random.default_rng(3)
    base, out = rng.integers(97, 123, 1500), []
    for _ in range(n):
        own = base.copy()
        own[rng.integers(0, len(own), 6)] = 65 + rng.integers(0, 26, 6)
        out.append(bytes(own.astype(np.uint8)).decode())
    return out


def test_parts_of_wide_anchors(spark, monkeypatch):
    """Records of an anchor with very many kinds are halved where need be; they don't become a row for each window."""
    made, kept = {}, S.common.written

    def written(df, tag, **how):
        made[tag] = made.get(tag, 0) + (got := kept(df, tag, **how)).count()
        return got

    monkeypatch.setattr(S, "WIDE", 20)
    monkeypatch.setattr(S.common, "written", written)
    got = check(spark.createDataFrame(list(enumerate(near_copies(80))), "doc_id long, text string"))
    assert any(0 < r[2] < r[1] for r in got)
    assert 0 < made["halves"] < 12 * made["records"]


def test_kinds_of_an_anchor_are_split(spark, monkeypatch):
    """Spark may deal the kinds of one anchor to several tasks of the join that looks for open anchors."""
    plans, kept = [], S.common.written

    def written(df, tag, **how):
        if tag == "records":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, tag, **how)

    small = {"autoBroadcastJoinThreshold": -1, "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "1k"}
    small |= {"adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b", "adaptive.skewJoin.skewedPartitionFactor": 0}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in small}
    monkeypatch.setattr(S.common, "written", written)
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.{k}", v)
        check(spark.createDataFrame(list(enumerate(near_copies(200))), "doc_id long, text string"))
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert len(plans) == 1 and "SortMergeJoin(skew=true) [anchor" in plans[0]


@given(st.integers(1, 337), st.integers(0, 336), st.sampled_from([1, 2, 64, 256]))
def test_halves_hold_each_window_once(n, at, width):
    at = max(at, n - 1)
    string = np.random.default_rng(n).integers(0, 256, n + 399).astype(np.uint8).tobytes()
    parts = S.halves(string, n, at, width, 400)
    assert sorted(k for _, first, count, _ in parts for k in range(first, first + count)) == list(range(n))
    for cell, first, count, core in parts:
        assert len(core) == 401 - width
        for k in range(first, first + count):
            assert (at - k) // width == cell and core in string[k : k + 400]
