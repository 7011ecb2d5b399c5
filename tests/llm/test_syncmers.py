import hashlib
import re
import struct

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silthouse.llm import syncmers as S

TEXT = " ".join(f"word{i * 7919 % 1009} of{i % 13}" for i in range(400))


def h(*values):
    """Spark's xxhash64 of longs (and texts), each seeded by the one before; nulls leave the seed."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed & (1 << 64) - 1)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_items(text):
    """The least items of a text, k-mer by k-mer."""
    pieces = [h(p) for run in re.findall(r"\S+", text or "", re.ASCII) for p in (run[i : i + S.PIECE] for i in range(0, len(run), S.PIECE))]
    anchors = []
    for i in range(len(pieces) - S.K + 1):
        inner = [h(*pieces[j : j + S.S]) for j in range(i, i + S.K - S.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            anchors.append((i, h(*(inner[d] for d in [*range(0, S.K - S.S, S.S), S.K - S.S]))))
    if not anchors:
        return {(h(*pieces) & (1 << 64) - 1) >> 32} if pieces else set()
    after = [*anchors[1:], None]
    items = {h(a[1], b[0] - a[0] if b else 0) for a, b in zip(anchors, after)}
    return set(sorted({(x & (1 << 64) - 1) >> 32 for x in items})[: S.SKETCH])


def in_hex(items):
    return "".join(f"{x:08x}" for x in sorted(items))


def likeness(a, b):
    both = set(sorted(a | b)[: S.SKETCH])
    j = len(both & a & b) / max(len(both), 1)
    return 2 * j / (1 + j) if both else 1.0


def run(docs, key="doc_id"):
    rows = S.edited(docs, key)
    return rows.select("_id", "_text", "_edited", S.hexed(F.col("_sketch")).alias("own"), S.hexed(F.col("_sketch_edited")).alias("late"), S.likeness(F.col("_sketch"), F.col("_sketch_edited")).alias("near_edited"), S.likeness(F.col("_sketch"), F.col("_sketch_next")).alias("near_next")).collect()


def check(docs):
    """Every row against a plain form; ids are distinct here."""
    rows = sorted(((i is not None, i or 0, t or "") for i, t in docs.select("doc_id", "text").collect()))
    got = sorted(run(docs), key=lambda r: (r["_id"] is not None, r["_id"] or 0))
    assert len(got) == len(rows)
    for k, (r, (_, i, t)) in enumerate(zip(got, rows)):
        after = rows[(k + 1) % len(rows)][2]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        own, late, then = map(brute_items, (t, edited, after))
        assert (r["_text"], r["_edited"]) == (t, edited)
        assert (r["own"], r["late"]) == (in_hex(own), in_hex(late))
        assert abs(r["near_edited"] - likeness(own, late)) < 1e-12 and abs(r["near_next"] - likeness(own, then)) < 1e-12
    return got


def test_documents(spark, docs, sf):
    check(docs.limit(60))
    got = S.op11_syncmers(spark, sf).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    long = [r for r in got if r.n_chars > 1000]
    assert sum(r.near_edited > 0.5 for r in long) > 0.95 * len(long) and sum(r.near_next < 0.1 for r in long) > 0.9 * len(long)
    shas = {r.doc_id: r.edited_sha256 for r in got}
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        t, after = t or "", after or ""
        assert shas[i] == hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest()


def test_edges(spark, odd, empty):
    check(odd.withColumn("_text", F.lit(1)).withColumn("_range", F.lit(2)))
    assert S.edited(empty).collect() == []
    one = run(spark.createDataFrame([(3, TEXT)], "doc_id long, text string"))
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    check(spark.createDataFrame([(None, TEXT), (1, "中文" * 3000), (2, "中文" * 2999 + "字"), (4, "\U0001f600 " * 50), (5, " "), (9, "a" * 5000)], "doc_id long, text string"))


def test_repeated_ids(spark):
    """All rows of an id stay, and each has one successor."""
    docs = spark.createDataFrame([(7, f"{TEXT} {k % 3}") for k in range(40)] + [(8, "end")], "doc_id long, text string").repartition(5)
    got = run(docs)
    assert len(got) == 41 and sum(r["_id"] == 7 for r in got) == 40 and all(r["_edited"] is not None for r in got)


def test_string_keys(spark):
    got = run(spark.createDataFrame([(f"k{i}", f"{TEXT} {i}") for i in range(30)], "name string, text string"), "name")
    assert len(got) == 30 and all(r["near_next"] > 0.9 for r in got)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text("ab \n", max_size=80), min_size=1, max_size=12))
def test_any_texts(spark, texts):
    check(spark.createDataFrame([(i, t * 3) for i, t in enumerate(texts)], "doc_id long, text string"))
