"""The near-copy stage of the SimHash operator: word shingles in sets, every pair at SHARE or more, verified exactly.

Golay keys find fingerprints a few bits apart, but sets at 0.8 may differ in a quarter of their fingerprints' bits, so
the keys alone would lose links. They come first, as the cheap way to most links, and a prefix filter,
which misses none, finds the rest.

1. Each task turns its texts into sets of hashed word shingles, with the fingerprint, the first shingles in
   an order and a sketch of counts. Equal sets are one node, a number, from here on.
2. Fingerprints that are equal or linked by their Golay keys (llm/simhash.py) are candidates; those that hold are
   links, and their components are known to the next step.
3. The order: shingles that are common in a sample of documents last, else by hash. Two sets at SHARE or more have
   a shingle in common among the first 1 / 5 of each, which is the key. Any order finds all pairs; the sample
   only makes keys rarer.
4. Of the rows of a key, one pivot meets all others, PIVOTS times, and pairs that hold are linked. A key whose
   rows are all in one component has nothing more to tell; those of the others meet each other, but for pairs
   that a component has already. So a large group of near copies doesn't make its square of pairs.
5. Sizes and places in the order bound a pair's overlap, then the sketches do (the sum of the lesser counts of each
   bucket); pairs that may still reach SHARE are counted from the texts, which only they are joined with.
6. Each step's links join the stars of the components before; the smallest id of each component stays.

Nulls and edges: a null text is empty; texts without words are copies of each other; fewer words than a
shingle are one shingle. Ids may repeat or be null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silthouse.llm import common, simhash
from silthouse.operators.graph import components

SHINGLE = 5
#: Least similarity of near copies: shared shingles by all shingles of both, as a fraction.
SHARE = (4, 5)
PIVOTS = 2
#: Documents that say which shingles are common, and in how many of them a shingle is.
SAMPLE, COMMON = 4000, 3
#: Buckets of a sketch, a power of two of about half as many as shingles: the fewest and the most.
BUCKETS = (32, 4096)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingles of a text, sorted."""
    return np.unique(np.array(simhash.hashes(text, shingle), np.uint64).view(np.int64))


def sketch(own: np.ndarray) -> bytes:
    """How many shingles fall into each bucket, by their lowest bits; empty where a count has no room."""
    buckets = 1 << min(max(BUCKETS[0].bit_length() - 1, len(own).bit_length() - 1), BUCKETS[1].bit_length() - 1)
    counts = np.bincount(own & (buckets - 1), minlength=buckets)
    return counts.astype("<u2").tobytes() if counts.max(initial=0) < 1 << 16 else b""


def most_shared(x: bytes, y: bytes) -> int | None:
    """No two sets with these sketches share more shingles; None where a sketch can't tell."""
    if not x or not y:
        return None
    a, b = np.frombuffer(x, "<u2").astype(np.int64), np.frombuffer(y, "<u2").astype(np.int64)
    n = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, n).sum(axis=0), b.reshape(-1, n).sum(axis=0)).sum())


def _common(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in COMMON or more documents of a sample, and the number of documents."""
    every = rows.count() // SAMPLE + 1

    def emit(batches):
        for batch in common.slices(batches, "_body", simhash.SLICE_BYTES):
            found = [shingles(t, shingle) for t in common.strings(batch.column("_body"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["h"])

    sample = rows.select("_body").filter(F.pmod(F.xxhash64("_body"), F.lit(every)) == 0).mapInArrow(emit, "h long")
    held = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON).toPandas().sort_values("h")
    return held["h"].to_numpy(np.int64), held["n"].to_numpy(np.int64)


def _tagged(rows: DataFrame, shingle: int) -> DataFrame:
    """_id, _t (a hash of the text), _set (a hash of all shingles), _size, _fp, _keys (the first shingles in the order), _sketch."""
    told = rows.sparkSession.sparkContext.broadcast(_common(rows, shingle))
    top, whole = SHARE

    def first(own: np.ndarray) -> np.ndarray:
        known, count = told.value
        n = len(own)
        if not n:
            return own
        weight = np.zeros(n, np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            weight = np.where(known[at] == own, count[at], 0)
        return own[np.lexsort((own, weight))][: n - -(-top * n // whole) + 1]

    def add(batches):
        for batch in common.slices(batches, "_body", simhash.SLICE_BYTES):
            each = [simhash.hashes(t, shingle) for t in common.strings(batch.column("_body"))]
            sets = [np.unique(np.array(x, np.uint64).view(np.int64)) for x in each]
            keys = [first(x) for x in sets]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            tags = [
                pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                pa.array([len(x) for x in sets], pa.int32()),
                pa.array(simhash.majorities(each).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys), pa.int64())),
                pa.array([sketch(x) for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_t"), *tags], names=["_id", "_t", "_set", "_size", "_fp", "_keys", "_sketch"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "_t", "_body").mapInArrow(add, f"_id {kind}, _t string, _set binary, _size int, _fp long, _keys array<bigint>, _sketch binary")


def nodes_of(rows: DataFrame, shingle: int) -> DataFrame:
    """Written: node, size, fp, keys, sketch, and `least`, the smallest id and its text's hash, of each different set; null ids last."""
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_t").alias("t")))
    sets = _tagged(rows, shingle).groupBy("_set").agg(F.first("_size").alias("size"), F.first("_fp").alias("fp"), F.first("_keys").alias("keys"), F.first("_sketch").alias("sketch"), least.alias("least"))
    return common.written(sets.drop("_set").withColumn("node", F.monotonically_increasing_id()), "nodes")


def _may(x: str, y: str) -> Column:
    """Whether two sets whose first shared shingle is at these places can reach SHARE."""
    top, whole = SHARE
    left = F.least(F.col(f"{x}.size") - F.col(f"{x}.place"), F.col(f"{y}.size") - F.col(f"{y}.place"))
    return (top + whole) * left >= top * (F.col(f"{x}.size") + F.col(f"{y}.size"))


def _enough(shared: int, a: int, b: int) -> bool:
    top, whole = SHARE
    return whole * shared >= top * (a + b - shared)


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Written u, v: the different pairs whose sketches may reach SHARE."""
    both = pairs.distinct()
    for side, sk, size in (("u", "x", "m"), ("v", "y", "n")):
        both = both.join(nodes.select(F.col("node").alias(side), F.col("sketch").alias(sk), F.col("size").alias(size)), side)

    def hold(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("x", "y", "m", "n")]
            kept = [(s := most_shared(x, y)) is None or _enough(min(s, m, n), m, n) for x, y, m, n in zip(*columns, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    return common.written(both.select("u", "v", "x", "y", "m", "n").mapInArrow(hold, "u long, v long"), "likely")


def _alike(pairs: DataFrame, nodes: DataFrame, bodies: DataFrame, shingle: int) -> DataFrame:
    """Written u, v: of the pairs of nodes those at SHARE or more, counted from the texts. bodies: node, body, written."""
    both = _likely(pairs, nodes)
    bodies = bodies.join(both.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi")
    both = both.join(bodies.select(F.col("node").alias("u"), F.col("body").alias("x")), "u").join(bodies.select(F.col("node").alias("v"), F.col("body").alias("y")), "v")

    def hold(batches):
        for batch in common.slices(batches, "x", simhash.SLICE_BYTES):
            kept, last, a = [], None, None
            for x, y in zip(common.strings(batch.column("x")), common.strings(batch.column("y")), strict=True):
                if x != last:
                    last, a = x, shingles(x, shingle)
                b = shingles(y, shingle)
                kept.append(_enough(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    return common.written(both.select("u", "v", "x", "y").mapInArrow(hold, "u long, v long"), "alike")


def _golay(nodes: DataFrame) -> DataFrame:
    """u, v: a star for each fingerprint that several nodes have, and for each link of two fingerprints a pair of nodes."""
    prints = common.written(nodes.groupBy(F.col("fp").alias("_fp")).agg(F.min("node").alias("node")), "prints")
    same = nodes.join(prints.select(F.col("_fp").alias("fp"), F.col("node").alias("u")), "fp").filter("u < node").select("u", F.col("node").alias("v"))
    near = simhash.links(prints).withColumnsRenamed({"u": "a", "v": "b"})
    near = near.join(prints.select(F.col("_fp").alias("a"), F.col("node").alias("x")), "a").join(prints.select(F.col("_fp").alias("b"), F.col("node").alias("y")), "b")
    return same.unionByName(near.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")))


def _placed(live: DataFrame, star: DataFrame) -> DataFrame:
    """The postings with the component of their node as `comp`."""
    star = star.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    return common.written(live.select("key", "x").join(star, F.col("x.node") == F.col("_u"), "left").select("key", "x", F.coalesce("_v", "x.node").alias("comp")), "postings")


def stars(nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """u, v: nodes that pairs at SHARE or more connect, and the least of each such component. texts: _id, _t, _body.

    New links join the stars of those before, so no step goes over all links again.
    """
    live = nodes.select("node", "size", F.posexplode("keys").alias("place", "key")).select("key", F.struct("node", "size", "place").alias("x"))
    many = live.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    live = common.written(live.join(many, "key"), "postings")
    first = common.written(_golay(nodes), "golay")
    needed = live.select("x.node").union(first.select(F.explode(F.array("u", "v")))).distinct()
    # written, so that its size is known before the join with all texts; a row that repeats id and text repeats a pair, no more
    needed = common.written(nodes.select("node", "least.id", "least.t").join(needed, "node"), "needed")
    bodies = common.written(texts.join(needed, (F.col("_t") == F.col("t")) & F.col("_id").eqNullSafe(F.col("id"))).select("node", F.col("_body").alias("body")), "bodies", compression="zstd")
    star = components(_alike(first, nodes, bodies, shingle))
    live = _placed(live, star)
    for k in range(PIVOTS + 1):
        mixed = live.groupBy("key").agg(F.min_by("x", F.xxhash64("x.node", F.lit(k))).alias("p"), F.min_by("comp", F.xxhash64("x.node", F.lit(k))).alias("c"), F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b")
        own = common.written(live.join(mixed.select("key", "p", "c"), "key"), "met")
        if own.isEmpty():
            break
        if k < PIVOTS:
            pairs = own.filter((F.col("comp") != F.col("c")) & _may("x", "p")).select(F.least("x.node", "p.node").alias("u"), F.greatest("x.node", "p.node").alias("v"))
        else:
            y = own.select("key", F.col("x").alias("y"), F.col("comp").alias("other"))
            pairs = own.join(y, "key").filter((F.col("x.node") < F.col("y.node")) & (F.col("comp") != F.col("other")) & _may("x", "y")).select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))
        star = components(star.unionByName(_alike(pairs, nodes, bodies, shingle)))
        if k < PIVOTS:
            live = _placed(own, star)
    return star


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Of each component, the document of the smallest key; all columns stay. Of rows that repeat it, one stays."""
    rows = common.set_aside(docs, key, text)
    rows = rows.withColumn("_t", F.md5(F.coalesce("_body", F.lit(""))))
    nodes = nodes_of(rows, shingle)
    star = stars(nodes, rows.select("_id", "_t", "_body"), shingle).select(F.col("u").alias("node"), F.col("v").alias("_to"))
    own = nodes.select("node", "least").join(star, "node", "left").groupBy(F.coalesce("_to", "node").alias("_to")).agg(F.min("least").alias("c"))
    chosen = own.select(F.col("c.id").alias("_least"), F.col("c.t").alias("_chosen"))
    kept = rows.join(chosen, (F.col("_t") == F.col("_chosen")) & F.col("_id").eqNullSafe(F.col("_least"))).select(*rows.columns)
    first = Window.partitionBy("_t", "_id").orderBy(F.lit(0))
    return common.restored(kept.withColumn("_n", F.row_number().over(first)).filter("_n = 1"), docs, key, text)
