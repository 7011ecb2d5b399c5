"""Conversation prefix trie: shared beginnings of conversations, found by binary search over owners.

A node is a distinct sequence of first turns; its owner is the smallest conversation that starts with it. The owner of
a node owns all longer beginnings of itself, too, so each conversation owns one chain of nodes,
from its first owned depth to its end, and (owner, depth) names a node.

1. Turns become an MD5 of role and text, their bytes and their order. Rows are dealt by ranges of (conversation,
   order) and sorted, tasks number them while they stream, and what a task's first conversation has in earlier ranges is
   added afterwards (`scanned`): a conversation with any number of turns is spread over as many tasks as its rows need.
2. Prefix digests are 128-bit running sums over the hashes of (place, turn), by the same scan.
3. Minima of the digests that several conversations have name their owners. Each conversation, cut in blocks
   of BLOCK depths, searches its first owned depth by halves: one join of all blocks' middle digests with the
   minima for each round, after which half of each block is dropped.
4. A chain hangs on the owner of the depth above its first. Chains are summed level by level from the lowest;
   sums inside a chain are the same scan from its end upwards.
5. Ids of the conversations that end at a node are joined to texts by sorted range, and the texts are hashed one after
   the other in a stream: SHA-256 is sequential, but its task gets a few long texts and holds one at a time.

Nulls and edges: a null role or text is empty; rows with a null conversation are left out. Equal turn numbers (or
nulls, which come first) are ordered by the MD5 of role and text; rows that repeat are turns of their own. An empty table
has no nodes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from silthouse.llm import common

BLOCK = 256
#: The group of conversations that share beginnings, and the longest beginning plus one.
FAMILY, SHARED = 5, 9
CHUNK_IDS = 4096
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value, scrambled one to one."""
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def scanned(rows: DataFrame, group: str, order: list[str], sums: dict[str, Callable[[pa.RecordBatch], np.ndarray]] | None = None) -> DataFrame:
    """The rows with `_at`, their place in the group (a long) in the given order, and for each of `sums` the sum of its values
    up to the row, 64 bits that wrap around. Ranges of rows are one task each, whatever the size of a group.

    What earlier ranges hold of a range's first group is one number of each kind for each range: the driver adds those up.
    """
    spark, sums = rows.sparkSession, sums or {}
    names = ["_at", *sums]
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    keys = [group, *order, "_salt"]
    ranged = salted.repartitionByRange(common.partitions(spark), *keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_range", F.spark_partition_id())
    kept, columns = rows.columns, ranged.columns
    schema = StructType([*ranged.schema.fields, *(StructField(x, LongType()) for x in names)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, np.zeros(len(names), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(group).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sizes = np.diff(np.append(starts, len(own)))
            held = []
            for k, values in enumerate([np.ones(len(own), np.uint64), *(f(batch) for f in sums.values())]):
                total = np.cumsum(values, dtype=np.uint64)
                before = np.where(starts > 0, total[starts - 1], np.uint64(0))
                if last == own[0]:
                    before[0] -= carry[k]
                total = total - np.repeat(before, sizes)
                carry[k] = total[-1]
                held.append((total - np.uint64(1) if k == 0 else total).view(np.int64))
            last = own[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *map(pa.array, held)], schema=None, names=[*columns, *names])

    stored = common.written(ranged.mapInArrow(scan, schema), "scanned")
    ends = stored.groupBy("_range").agg(F.min(group).alias("first"), F.max_by(F.struct(group, *names), F.struct(group, "_at")).alias("last"))
    carried: dict[int, np.ndarray] = {}
    open_group, held = None, np.zeros(len(names), np.uint64)
    for row in ends.orderBy("_range").collect():  # a row for each range
        if row.first == open_group:
            carried[row["_range"]] = held
        own = np.array([row.last[c] + (c == "_at") for c in names], np.int64).view(np.uint64)
        held = held + own if row.last[group] == open_group else own
        open_group = row.last[group]
    if not carried:
        return stored.drop("_range")
    firsts = {r["_range"]: r["first"] for r in ends.collect()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, part = batch.column(group).to_numpy(), batch.column("_range").to_numpy()
            more = np.zeros((len(own), len(names)), np.uint64)
            for p in np.unique(part):
                if p in carried:
                    more[(part == p) & (own == firsts[p])] = carried[p]
            out = [(batch.column(c).to_numpy().view(np.uint64) + more[:, k]).view(np.int64) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, out)], names=[*kept, *names])

    return stored.mapInArrow(add, StructType([f for f in schema.fields if f.name != "_range"]))


def rebuilt(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, size) and their turns (c, at, digest, bytes), after the shared beginnings are put in place."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    digest = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))
    turns = talks.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    placed = common.written(scanned(turns, "c", ["turn", "digest"]).drop("turn"), "turns")
    sizes = placed.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.withColumns({"base": F.col("c") - F.col("c") % FAMILY, "h": F.crc32(F.col("c").cast("string").cast("binary")) % SHARED})
    plan = plan.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("_base")), "base", "left").withColumn("keep", F.least("h", F.coalesce("_base", F.lit(0))))
    plan = common.written(plan.select("c", "base", "h", "keep", (F.col("keep") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "plan")
    own = placed.join(plan.select("c", "h", "keep"), "c").filter("_at >= h").select("c", (F.col("_at") - F.col("h") + F.col("keep")).alias("at"), "digest", "bytes")
    wanted = plan.filter("keep > 0").select(F.col("c").alias("_to"), F.col("base").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("keep") - 1)).alias("at"))
    heads = placed.filter((F.col("_at") < SHARED) & (F.col("c") % FAMILY == 0)).select("c", F.col("_at").alias("at"), "digest", "bytes")
    lent = wanted.join(heads, ["c", "at"]).select(F.col("_to").alias("c"), "at", "digest", "bytes")
    return plan.select("c", "size"), own.unionByName(lent)


def prefixes(turns: DataFrame) -> DataFrame:
    """c, depth, d1, d2 (the digest of the first `depth` turns) and the last turn's bytes."""

    def half(k: int) -> Callable[[pa.RecordBatch], np.ndarray]:
        def values(batch: pa.RecordBatch) -> np.ndarray:
            digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint64).reshape(-1, 2)[:, k]
            return _mixed(digest + (batch.column("at").to_numpy().astype(np.uint64) + np.uint64(1 + k)) * _STEP)

        return values

    found = scanned(turns, "c", ["at"], {"d1": half(0), "d2": half(1)})
    return common.written(found.select("c", (F.col("at") + 1).alias("depth"), "d1", "d2", "bytes"), "prefixes")


def first_owned(found: DataFrame, minima: DataFrame) -> DataFrame:
    """c, first, parent: the first depth of each conversation that it owns (one beyond its end if none), and the owner of the depth above it.

    found: prefixes; minima: d1, d2, owner of the digests that several conversations have.
    """
    block = F.floor((F.col("depth") - 1) / BLOCK)
    rows = found.groupBy("c", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("depth", "d1", "d2"))).alias("open"))
    state = common.written(rows.select("c", "open", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("above")), "search")
    done = []
    while not state.isEmpty():
        middle = F.floor(F.size("open") / 2).cast("int")
        probe = state.withColumns({"_k": middle, "_probe": F.get("open", middle)}).withColumns({"d1": F.col("_probe.d1"), "d2": F.col("_probe.d2")})
        answer = probe.join(minima, ["d1", "d2"], "left")
        own = F.col("owner").isNull() | (F.col("owner") == F.col("c"))
        half = F.when(own, F.slice("open", F.lit(1), F.col("_k"))).otherwise(F.slice("open", F.col("_k") + 2, F.size("open")))
        step = answer.select("c", half.alias("open"), F.when(own, F.col("parent")).otherwise(F.col("owner")).alias("parent"), F.when(own, F.col("above")).otherwise(F.col("_probe.depth")).alias("above"))
        step = common.written(step, "search")
        done.append(step.filter("size(open) = 0").select("c", "parent", "above"))
        state = step.filter("size(open) > 0")
    if not done:
        return found.select("c", F.lit(1).cast("long").alias("first"), F.col("c").alias("parent"))
    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    return ended.groupBy("c").agg((F.max("above") + 1).alias("first"), F.max_by("parent", "above").alias("parent"))


def _levels(chains: DataFrame) -> DataFrame:
    """c, level: how many chains hang above each chain (c, parent), by doubling."""
    state = common.written(chains.select("c", F.col("parent").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("level")), "levels")
    while not state.filter("to is not null").isEmpty():
        up = state.select(F.col("c").alias("to"), F.col("to").alias("_to"), F.col("level").alias("_level"))
        moving = state.filter("to is not null").join(up, "to").select("c", F.col("_to").alias("to"), (F.col("level") + F.col("_level")).alias("level"))
        state = common.written(moving.unionByName(state.filter("to is null")), "levels")
    return state.select("c", "level")


def _hung(chains: DataFrame) -> DataFrame:
    """c, depth, leaves, saved, children: what hangs on each node. chains: c, first, size, parent, saved (its own nodes')."""
    above = chains.filter("parent is not null").select(F.col("parent").alias("c"), (F.col("first") - 1).alias("depth"))
    ends = above.groupBy("c").agg(F.max("depth").alias("_deepest"))
    leaf = F.when(F.coalesce(F.col("_deepest") >= F.col("size"), F.lit(False)), 0).otherwise(1).cast("long")
    rows = chains.join(_levels(chains), "c").join(ends, "c", "left").select("c", "first", "parent", "saved", leaf.alias("leaves"), "level")
    rows = common.written(rows, "chains")
    deepest = rows.agg(F.max("level")).first()[0] or 0
    sums, below = [], None
    for level in range(deepest, 0, -1):
        own = rows.filter(F.col("level") == level).drop("level")
        if below is not None:
            extra = below.groupBy(F.col("c")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
            own = own.join(extra, "c", "left").withColumns({"leaves": F.col("leaves") + F.coalesce("_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("_saved", F.lit(0))})
        hung = own.groupBy(F.col("parent").alias("c"), (F.col("first") - 1).alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("children"))
        below = common.written(hung, "hung")
        sums.append(below)
    if not sums:
        return rows.limit(0).select("c", F.col("first").alias("depth"), "leaves", "saved", F.lit(0).cast("long").alias("children"))
    out = sums[0]
    for more in sums[1:]:
        out = out.unionByName(more)
    return out


def joined_ids(ends: DataFrame) -> DataFrame:
    """c, depth, sha: the SHA-256 of the ids that end at each node. ends: c, depth, id."""
    n = common.partitions(ends.sparkSession)
    keys = ["c", "depth", "id"]
    ranged = ends.repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, depth, ids = (batch.column(k).to_numpy() for k in keys)
            cuts = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (depth[1:] != depth[:-1])])) if len(c) else []
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(c)]):
                out += [(c[a], depth[a], ids[k], ",".join(map(str, ids[k : min(k + CHUNK_IDS, b)].tolist()))) for k in range(a, b, CHUNK_IDS)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*keys, "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for c, depth, ids in zip(*(batch.column(k).to_pylist() for k in ("c", "depth", "ids"))):
                if (c, depth) == node:
                    state.update(f",{ids}".encode())
                    continue
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (c, depth), hashlib.sha256(ids.encode())
            yield _digests(out)
        if node:
            yield _digests([(*node, state.hexdigest())])

    parts = ranged.mapInArrow(chunks, "c long, depth long, id long, ids string")
    return parts.repartition("c", "depth").sortWithinPartitions(*keys).mapInArrow(digests, "c long, depth long, sha string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["c", "depth", "sha"])


def tree(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (c, size) and their turns (c, at, digest, bytes)."""
    total = conversations.agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("n")).first()
    found = prefixes(turns)
    minima = found.groupBy("d1", "d2").agg(F.min("c").alias("owner"), F.count(F.lit(1)).alias("n_convs"))
    minima = common.written(minima.filter("n_convs > 1"), "minima")
    owned = conversations.join(first_owned(found, minima.drop("n_convs")), "c", "left")
    root = F.lit(total.least).cast("long")  # the owner of the root, whose chain starts there
    top = F.col("c") == root
    first = F.when(top, 0).otherwise(F.coalesce("first", F.lit(1))).cast("long")
    parent = F.when(~top, F.coalesce("parent", root))
    chains = common.written(owned.select("c", "size", first.alias("first"), parent.alias("parent")), "owned")

    own = found.join(chains, "c").filter("depth >= first").join(minima.drop("owner"), ["d1", "d2"], "left").drop("d1", "d2")
    own = own.select("c", "depth", "bytes", "first", "size", "parent", F.coalesce("n_convs", F.lit(1)).cast("long").alias("n_convs"))
    above = chains.filter(top).select("c", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "first", "size", "parent", F.lit(total.n).cast("long").alias("n_convs"))
    nodes = common.written(own.unionByName(above).withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
    sums = chains.filter("first <= size").join(nodes.groupBy("c").agg(F.sum("own").alias("saved")), "c")
    hung = _hung(sums)

    met = nodes.join(hung, ["c", "depth"], "left")
    n_children = F.coalesce("children", F.lit(0)) + (F.col("depth") < F.col("size")).cast("long")
    met = met.select("c", "depth", "first", "parent", "n_convs", n_children.alias("n_children"), (-F.col("depth")).alias("up"), (F.col("own") + F.coalesce("saved", F.lit(0))).alias("w"), (F.coalesce("leaves", F.lit(0)) + (n_children == 0).cast("long")).alias("l"))
    values = lambda name: lambda batch: batch.column(name).to_numpy().view(np.uint64)
    summed = scanned(met, "c", ["up"], {"saved_tokens": values("w"), "n_leaves": values("l")})

    last = F.when(F.col("first") > F.col("size"), F.col("parent")).otherwise(F.col("c"))
    ends = joined_ids(chains.select(last.alias("c"), F.col("size").alias("depth"), F.col("c").alias("id")))
    none = hashlib.sha256().hexdigest()
    above = F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("c"))
    return summed.join(ends, ["c", "depth"], "left").select(F.col("c").alias("conv_id"), "depth", above.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(none)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(*rebuilt(common.read(spark, sf_dir, "conversations")))


SQL = r"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
t AS (
  SELECT conv_id AS c, md5(concat_ws(':', length(coalesce(role, '')), coalesce(role, ''), coalesce(text, ''))) AS m, strlen(coalesce(text, '')) AS b, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, m, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) - 1 AS p FROM t),
s AS (SELECT c, count(*) AS n, hex(encode(CAST(c AS VARCHAR))) AS x FROM o GROUP BY c),
h AS (
  SELECT c, n, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
         lambda a, y: xor(a // 256, t[xor(a % 256, y) + 1])), 4294967295) % 9 AS h FROM s, tab),
k AS (SELECT h.c, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS keep, least(h.h, coalesce(b.n, 0)) + greatest(h.n - h.h, 0) AS size FROM h LEFT JOIN s b ON b.c = h.base),
r AS (
  SELECT k.c, o.p AS p, m, b FROM k JOIN o ON o.c = k.base AND o.p < k.keep
  UNION ALL SELECT k.c, o.p - h + keep, m, b FROM k JOIN o ON o.c = k.c AND o.p >= h),
d AS (SELECT c, p + 1 AS depth, b, md5(string_agg(m, '' ORDER BY p) OVER (PARTITION BY c ORDER BY p)) AS node FROM r UNION ALL SELECT c, 0, 0, '' FROM k),
g AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS own FROM d GROUP BY node, depth),
u AS (SELECT g.node, d.node AS up FROM g JOIN d ON d.c = g.conv_id AND d.depth = g.depth - 1),
f AS (SELECT g.node, count(u.node) AS n_children FROM g LEFT JOIN u ON u.up = g.node GROUP BY g.node),
z AS (
  SELECT a.node, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(x.own) AS saved_tokens
  FROM g x JOIN f USING (node) JOIN d a ON a.c = x.conv_id AND a.depth <= x.depth GROUP BY a.node),
e AS (SELECT d.node, sha256(string_agg(CAST(d.c AS VARCHAR), ',' ORDER BY d.c)) AS ends FROM d JOIN k ON k.c = d.c AND k.size = d.depth GROUP BY d.node)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, f.n_children, z.n_leaves, CAST(z.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM g JOIN f USING (node) JOIN z USING (node) LEFT JOIN u ON u.node = g.node LEFT JOIN g p ON p.node = u.up LEFT JOIN e ON e.node = g.node
"""
