"""SimHash near-duplicates by Golay-code fuzzy hashing.

1. Each task turns its texts into 64-bit fingerprints of their word shingles.
2. Equal fingerprints are one node from here on, however many documents have it.
3. A fingerprint is three segments of 22, 21 and 21 bits, each a word of the perfect (23, 12)
   Golay code with its upper bits zero. At 3 differing bits or fewer, either some segment is equal and one of
   the others has at most 1 error, or each has exactly 1. A word and one with 1 error share a
   codeword index if the index of the nearest codeword is held against the indices of the
   nearest codeword and, for a word 3 away from it, of the five codewords 4 away.
   So the keys are: for each ordered pair of segments, one as it is and an index of the
   other; for the last case, halves of the first and second segments (of two halves one is
   free of a single error) and an index of the third. Each key has 32 bits or more.
4. Probing keys meet index keys in an equi-join; the number of differing bits decides.
5. Components of the links, then the smallest id of each.

Nulls and edges: a null text is empty; texts without words have fingerprint zero and are linked
like any others; fewer words than a shingle are one shingle. Ids may repeat or be null (a null id
is a document; a component of null ids only has the id null). Other columns are not looked at.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silthouse.llm import common
from silthouse.operators.graph import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
SLICE_BYTES = 1 << 20
#: Segments of a fingerprint: lowest bit and bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_GENERATOR = 0b101011100011  # of the (23, 12) Golay code

#: For each byte, its bits in eight counters of eight bits each.
_LANES = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], np.uint64)


def hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of each word shingle of a text, ASCII letters in lower case."""
    words = text.lower().split()
    if not words:
        return []
    plain = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(len(words) - shingle + 1, 1)
    ends = [e - 1 for e in starts[min(shingle, len(words)) :]]
    return list(map(xxhash.xxh64_intdigest, map(plain.__getitem__, map(slice, starts[:n], ends)), repeat(SEED)))


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text: bits set in over half of its shingles' hashes."""
    return majorities([hashes(t, shingle) for t in texts])


def majorities(each: list[list[int]]) -> np.ndarray:
    """The bits set in over half of each list's hashes."""
    out = np.zeros(len(each), np.uint64)
    sizes = np.array([len(x) for x in each], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    lanes = _LANES[np.array([h for x in each for h in x], "<u8").view(np.uint8).reshape(-1, 8)]
    chunks = -(-sizes[full] // 255)  # a counter of eight bits holds 255
    first = np.cumsum(chunks) - chunks
    step = np.arange(chunks.sum()) - np.repeat(first, chunks)
    starts = np.repeat(np.cumsum(sizes[full]) - sizes[full], chunks) + 255 * step
    part = np.add.reduceat(lanes, starts, axis=0).astype("<u8").view(np.uint8).reshape(-1, 64)
    counts = np.add.reduceat(part.astype(np.int64), first, axis=0)
    out[full] = np.packbits(2 * counts > sizes[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 23 single bits, and for each syndrome six errors: the lightest, then those of weight 4."""
    single = []
    for k in range(23):
        x = 1 << k
        for j in range(k, 10, -1):
            if x >> j & 1:
                x ^= _GENERATOR << (j - 11)
        single.append(x)
    errors: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            if weight < 4 or sum(map(int, bin(errors[s][0])[2:])) == 3:
                errors[s].append(sum(1 << b for b in bits))
    return np.array(single, np.uint64), np.array([(e * 6)[:6] for e in errors], np.uint64)


_SINGLE, _ERRORS = _golay()


def codewords(words: np.ndarray) -> np.ndarray:
    """Six codeword indices of each 23-bit word: its nearest codeword's first, then near ones, or that one again."""
    syndrome = np.zeros(len(words), np.uint64)
    for k in range(23):
        syndrome ^= (words >> np.uint64(k) & np.uint64(1)) * _SINGLE[k]
    return (words[:, None] ^ _ERRORS[syndrome.astype(np.int64)]) >> np.uint64(11)


def keys(prints: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `prints` and a key of each; probing, all near codewords count, else the nearest."""
    u = np.uint64
    parts = [prints >> u(a) & u((1 << n) - 1) for a, n in SEGMENTS]
    near = [codewords(p) for p in parts]
    heads = [(x, parts[i], j) for x, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j)]
    for x, (a, b) in enumerate((a, b) for a in range(2) for b in range(2)):
        half = [p >> u(11) if k else p & u(0x7FF) for p, k in ((parts[0], a), (parts[1], b))]
        heads.append((6 + x, half[0] << u(11) | half[1], 2))
    at, out = [], []
    for table, head, j in heads:
        for c in range(6 if probe else 1):
            where = np.flatnonzero(near[j][:, c] != near[j][:, 0]) if c else np.arange(len(prints))
            at.append(where)
            out.append(u(table) << u(48) | head[where] << u(12) | near[j][where, c])
    return np.concatenate(at), np.concatenate(out)


def fingerprinted(docs: DataFrame, text: str = "text", columns: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """The columns named (all, if none are) and `_fp`, the fingerprint as a signed long."""
    columns = docs.columns if columns is None else columns

    def add(batches):
        for batch in common.slices(batches, text, SLICE_BYTES):
            prints = fingerprints(common.strings(batch.column(text)), shingle)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(prints.view(np.int64))], names=[*columns, "_fp"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*(docs.schema[c] for c in columns), StructField("_fp", LongType())])
    return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(add, schema)


def links(prints: DataFrame) -> DataFrame:
    """u, v: every two different fingerprints of the column `_fp` at DISTANCE bits or fewer, u below v."""

    def side(probe: bool) -> DataFrame:
        def emit(batches):
            for batch in batches:
                own = batch.column("_fp").to_numpy().view(np.uint64)
                for a in range(0, len(own), 4096):
                    at, key = keys(own[a : a + 4096], probe)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own[a + at].view(np.int64))], names=["key", "p" if probe else "i"])

        return prints.select("_fp").mapInArrow(emit, f"key long, {'p' if probe else 'i'} long")

    near = side(True).join(side(False), "key").filter((F.col("p") < F.col("i")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("i"))) <= DISTANCE))
    return near.select(F.col("p").alias("u"), F.col("i").alias("v")).distinct()


def classes(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """_fp, component_id: for each fingerprint of the rows (key, _fp), the smallest key in its component."""
    nodes = common.written(found.groupBy("_fp").agg(F.min(key).alias("_least")), "prints")
    star = components(links(nodes)).select(F.col("u").alias("_fp"), F.col("v").alias("_to"))
    named = nodes.join(star, "_fp", "left").withColumn("_to", F.coalesce("_to", "_fp"))
    return named.join(named.groupBy("_to").agg(F.min("_least").alias("component_id")), "_to").select("_fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: key, fingerprint in hex, component_id."""
    found = common.written(fingerprinted(docs, text, [key], shingle), "fingerprints")
    return found.join(classes(found, key), "_fp").select(key, F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Of each component, the document of the smallest key; all columns stay. Of rows that repeat it, one stays."""
    rows = common.set_aside(docs, key, text)
    own = fingerprinted(rows, "_body", None, shingle)
    found = common.written(fingerprinted(rows.select("_id", "_body"), "_body", ["_id"], shingle), "fingerprints")
    chosen = found.join(classes(found, "_id"), "_fp").filter(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("_fp").alias("_fp"))
    kept = own.join(chosen, (own["_fp"] == chosen["_fp"]) & own["_id"].eqNullSafe(chosen["component_id"])).select(own["*"])
    first = Window.partitionBy("_fp", "_id").orderBy(F.xxhash64("_body"))
    return common.restored(kept.withColumn("_n", F.row_number().over(first)).filter("_n = 1"), docs, key, text)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))
