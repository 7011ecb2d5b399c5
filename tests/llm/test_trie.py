import hashlib
from collections import defaultdict
from zlib import crc32

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from silthouse.llm import trie as T

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            m = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            talks[c].append((turn is not None, turn or 0, m, role, text))
    talks = {c: [x[3:] for x in sorted(own)] for c, own in talks.items()}
    whole = {}
    for c, own in talks.items():
        h = crc32(str(c).encode()) % 9
        base = c - int(abs(c) % 5 * (1 if c >= 0 else -1))
        whole[c] = tuple(talks.get(base, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    kids = defaultdict(list)
    for x in nodes:
        if x:
            kids[x[:-1]].append(x)
    sums = {}
    for x in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[x]) - 1) * len(x[-1][1].encode()) if x else 0
        sums[x] = (sum(sums[k][0] for k in kids[x]) or 1, own + sum(sums[k][1] for k in kids[x]))
    out = []
    for x, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(whole[c]) == len(x))
        out.append((members[0], len(x), nodes[x[:-1]][0] if x else None, len(members), len(kids[x]), *sums[x], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(talks):
    got = T.tree(*T.rebuilt(talks)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.conv_id, r.turn, r.role, r.text) for r in talks.collect()])
    return got


def test_against_sql(spark, sf):
    conversations = duckdb.read_parquet(f"{sf}/conversations.parquet")
    want = duckdb.sql(T.SQL).fetchall()
    got = [tuple(r) for r in T.op13_prefix_trie(spark, sf).select(*COLUMNS).collect()]
    assert conversations and sorted(got, key=str) == sorted(want, key=str) and any(r[6] for r in want)


def test_edges(spark):
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "", ""), (7, 3, "user", "x"), (7, 3, "user", "x"), (8, 1, "a", "é" * 40_000), (-3, 0, "user", "hello"), (-3, 1, "bot", "hi"), (0, 0, "user", "hello"), (0, 1, "bot", "hi")]
    rows += [(k, t, "user", "same") for k in range(20, 60) for t in range(4)] + [(61, t, "user", "same") for t in range(11)] + [(2**62, 0, "a:b", "c"), (2**62 + 1, 0, "a", "b:c")]
    talks = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 c", "2 depth", "3 digest", "4 _at")
    check(talks)
    check(talks.limit(0))
    check(spark.createDataFrame([(61, 0, "a", "b")], SCHEMA))


def test_one_conversation_over_many_ranges(spark):
    """A conversation with most of all rows is cut over ranges and blocks of depths."""
    rows = [(5, t, "user", f"turn {t % 50}") for t in range(700)] + [(k, t, "user", f"turn {t % 50}") for k in (6, 7, 11) for t in range(30 + 290 * (k == 11))]
    check(spark.createDataFrame(rows, SCHEMA).repartition(6))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.sampled_from([None, 0, 1, 2]), st.sampled_from(["u", None]), st.sampled_from(["a", "b", ""])), min_size=1, max_size=50))
def test_any_turns(spark, rows):
    check(spark.createDataFrame(rows, SCHEMA))
