"""Best-fit packing of tokenised documents into sequences of a fixed length.

1. Tokenise: each task turns its documents into pieces of at most `limit` tokens.
2. Range-sort the pieces by length over the cluster and number them inside their length; the
   partition counts, at most one row for each partition and length, give every piece its rank.
3. Pieces and gaps are tables of runs: a length with its pieces' ranks, a gap with the sequences that have
   it. Supersteps go from the longest pieces down, halving the length each time. In a superstep the class's
   pieces and all gaps that may hold them are dealt by ranges of size, and each task sweeps its range: longest
   first, pieces go by rank to the smallest gap that holds them. What a range can't place meets the gaps of
   the next larger range, in pairs of ranges, then pairs of pairs; matches inside a range are those of
   the whole. The last sweep of a superstep opens new sequences for what found no gap; gaps are updated,
   written, and the next class follows.
   Runs of equal size have at most two entries for each length and sweep, so the tables' size depends on
   the limit, never on the number of documents: at most about 2 * limit * log2(limit) assignments.
4. Every task looks its pieces up in the assignments by length and rank.

Nulls and edges: a null text is empty and is the single end token; repeated rows are pieces of
their own; a null key is kept. Columns other than key and text are not looked at. Vocabularies that
don't split texts into parts as the production one does are used on whole texts.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silthouse.llm import common

LIMIT = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
SLICE_BYTES = 4 << 20
#: A worker forgets its parts when it knows so many.
CACHE_PARTS = 600_000
#: Parts that are encoded at once.
LEARN_PARTS = 1 << 15

# The vocabulary file's own split into words, digits and runs of signs.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "</w>")
#: What that split does to texts of _PLAIN characters, where letters stay together: these parts get spaces around them.
_APART = r"'(?:s|t|re|ve|m|ll|d)|[^\t-\r \pL\pN]+|\pN"
#: Characters that are their own NFC form beside each other and have one lower-case character.
_PLAIN = r"^[\t-\r -~¡-įı-ɏЀ-џ‐-‧‰-⁞一-龥]*$"
#: The byte-level alphabet: the characters that stand for bytes which are not signs of their own.
_BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: Ranges of size that a superstep starts with, a power of two.
RANGES = 4


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts, part by part, each part encoded once.

    The vocabulary splits texts into words, digits and runs of signs before anything else, so a text's
    ids are those of its parts in turn; Arrow finds the parts of many texts at once. Words with
    characters outside _PLAIN, texts that spell a special token, and all texts where the vocabulary is
    of another make are encoded by the tokenizer itself.
    """

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.by_part = self._by_part()
        # parts in the byte-level alphabet need neither the normalizer nor the split
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.closes = np.zeros(1 + max(self.model.get_vocab().values()), bool)
        self.closes[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    @classmethod
    def drop(cls) -> None:
        """Gives the memory of a worker's encoders back: it goes on with steps that need none."""
        if cls._open:
            cls._open.clear()
            common.trim()

    def _by_part(self) -> bool:
        made = json.loads(self.model.to_str())
        normal, split = made["normalizer"] or {}, made["pre_tokenizer"] or {}
        parts = split.get("pretokenizers", [])
        steps = [x["type"] for x in normal.get("normalizers", [])], [x["type"] for x in parts], made["model"].get("end_of_word_suffix")
        return steps == _STEPS and parts[0]["pattern"] == {"Regex": _SPLIT} and not parts[1]["add_prefix_space"] and all("<|" in x["content"] for x in made["added_tokens"])

    def forget(self) -> None:
        """Known parts by number, and where each one's ids lie; the empty part has none."""
        self.known, self.ids, self.ends = {"": 0}, np.zeros(0, "<u4"), np.zeros(2, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, parts: list[str]) -> None:
        ids, ends, last = [self.ids], [self.ends], len(self.ids)
        for a in range(0, len(parts), LEARN_PARTS):
            some = [p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES) for p in parts[a : a + LEARN_PARTS]]
            got = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stop = np.flatnonzero(self.closes[got]) + 1
            if len(stop) != len(some):
                each = [np.array(x.ids, "<u4") for x in self.bare.encode_batch_fast(some, add_special_tokens=False)]
                got, stop = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids.append(got)
            ends.append(last + stop)
            last += len(got)
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.ids, self.ends = np.concatenate(ids), np.concatenate(ends)

    def plain(self, texts: pa.Array) -> np.ndarray:
        return pc.match_substring_regex(texts, _PLAIN).to_numpy(zero_copy_only=False)

    def plain_ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of texts of _PLAIN characters."""
        if len(self.known) > CACHE_PARTS:
            self.forget()
        found = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _APART, r" \0 "))
        flat = found.flatten().dictionary_encode()
        parts = flat.dictionary.to_pylist()
        if new := [p for p in parts if p not in self.known]:
            self.learn(new)
        of = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))[flat.indices.to_numpy()]
        first, size = self.ends[of], self.ends[of + 1] - self.ends[of]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        at = ends[np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())])].tolist()
        return [ids[a:b] for a, b in pairwise(at)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text as 32-bit numbers; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_part:
            return [self.whole(t) for t in texts.to_pylist()]
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = self.plain(texts) & ~special
        out: list = [None] * len(texts)
        for i, ids in zip(np.flatnonzero(plain).tolist(), self.plain_ids(texts.filter(pa.array(plain))), strict=True):
            out[i] = ids
        # white space stands between words everywhere, so others go word by word
        rest = {i: texts[i].as_py() if special[i] else common.strings(texts[i : i + 1])[0].split() for i in np.flatnonzero(~plain).tolist()}
        words = pa.array(sorted({w.decode() for x in rest.values() if isinstance(x, list) for w in x}), pa.large_string())
        plain = self.plain(words)
        known = dict(zip(words.filter(pa.array(plain)).to_pylist(), self.plain_ids(words.filter(pa.array(plain))), strict=True)) if len(words) else {}
        known |= {w: self.whole(w) for w in words.filter(pa.array(~plain)).to_pylist()}
        for i, x in rest.items():
            out[i] = np.concatenate([np.zeros(0, "<u4"), *(known[w.decode()] for w in x)]) if isinstance(x, list) else self.whole(x)
        return out


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, tokenizer: str | None = None) -> DataFrame:
    """key, piece, start, length, ids_crc32 of each piece of each document."""
    path = tokenizer or tokenizer_path()
    end = END_ID.to_bytes(4, "little")

    def cut(batches):
        encoder = Encoder.at(path)
        for batch in common.slices(batches, text, SLICE_BYTES):
            rows: list[tuple] = []
            for i, ids in enumerate(encoder.encode(batch.column(text))):
                stop = len(ids) + 1
                for k, a in enumerate(range(0, stop, limit)):
                    crc = zlib.crc32(ids[a : a + limit])
                    rows.append((i, k, a, min(limit, stop - a), crc if a + limit < stop else zlib.crc32(end, crc)))
            of, piece, start, length, crc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(of)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def sweep(pieces: list[tuple[int, int, int]], free: list[tuple[int, int, int]], limit: int, used: int | None) -> tuple[list, list, list]:
    """Assignments (length, first rank, first sequence, pieces a sequence, offset, sequences), pieces left over, and gaps after.

    pieces: runs (length, first rank, n); free: runs (gap, first sequence, n). Pieces of an assignment, from its rank
    on, fill the sequences in turn. With `used`, the number of sequences so far, the rest opens new ones.
    """
    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    plan, over = [], []

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, n))

    for run in sorted(free):
        leave(*run)
    for length, rank, left in sorted(pieces, key=lambda x: (-x[0], x[1])):
        behind: list[tuple[int, int, int]] = []

        def fill(gap, first, n, length=length, behind=behind):
            nonlocal rank, left
            each = gap // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for at, bins, k in ((first, full, each), (first + full, int(rest > 0), rest)):
                if bins:
                    plan.append((length, rank, at, k, limit - gap, bins))
                    rank, left = rank + bins * k, left - bins * k
                    behind.append((gap - k * length, at, bins))
            done = full + (rest > 0)
            behind.append((gap, first + done, n - done))

        k = bisect_left(gaps, length)
        while left and k < len(gaps):
            gap = gaps[k]
            todo = runs.pop(gap)
            gaps.pop(k)
            while todo:
                first, n = todo.pop()
                if left:
                    fill(gap, first, n)
                else:
                    behind.append((gap, first, n))
        if left and used is None:
            over.append((length, rank, left))
        elif left:
            n = -(-left // (limit // length))
            fill(limit, used, n)
            used += n
        for run in behind:
            leave(*run)
    return plan, over, [(gap, *run) for gap in gaps for run in runs[gap]]


_RUNS = "kind int, size int, first long, n long, sequence long, offset int, bins long"
_PIECE, _GAP, _PLAN = range(3)


def _swept(rows: DataFrame, span: int, limit: int, used: int | None) -> DataFrame:
    """The runs after a sweep of each `span` ranges; assignments pass through."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        runs = {k: list(g[["size", "first", "n"]].itertuples(index=False, name=None)) for k, g in group.groupby("kind")}
        plan, over, gaps = sweep(runs.get(_PIECE, []), runs.get(_GAP, []), limit, used)
        out = [(_PIECE, *x, 0, 0, 0) for x in over] + [(_GAP, *x, 0, 0, 0) for x in gaps] + [(_PLAN, a, b, each, at, offset, bins) for a, b, at, each, offset, bins in plan]
        made = pd.DataFrame(out, columns=list(group.columns[:-1]))
        return pd.concat([made, group[group["kind"] == _PLAN].iloc[:, :-1]]).assign(range=group["range"].min())

    return rows.groupBy(F.floor(F.col("range") / span)).applyInPandas(one, f"{_RUNS}, range int")


def best_fit(lengths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Written assignments (length, first, sequence, each, offset) of lengths (length, n), by supersteps over tables of runs."""
    zero = F.lit(0).cast("long")
    runs = common.written(
        lengths.select(F.lit(_PIECE).alias("kind"), F.col("length").cast("int").alias("size"), zero.alias("first"), F.col("n").cast("long").alias("n"), zero.alias("sequence"), F.lit(0).alias("offset"), zero.alias("bins")), "runs"
    )
    gaps = plan = runs.limit(0)
    top, used = limit, 0
    while top:
        least = top // 2
        pieces = runs.filter((F.col("size") <= top) & (F.col("size") > least))
        if not pieces.isEmpty():
            # the class in ranges of size, larger gaps with the largest
            range_of = F.least(F.floor((F.col("size") - least - 1) / max((top - least) // RANGES, 1)), F.lit(RANGES - 1)).cast("int")
            state, span = pieces.unionByName(gaps.filter(F.col("size") > least)).withColumn("range", range_of), 1
            while span < RANGES:
                state, span = _swept(state, span, limit, None), 2 * span
            state = common.written(_swept(state, span, limit, used).drop("range"), "swept")
            done = state.filter(F.col("kind") == _PLAN)
            used = max(used, done.agg(F.max(F.col("sequence") + F.col("bins"))).first()[0])
            gaps = common.written(gaps.filter(F.col("size") <= least).unionByName(state.filter(F.col("kind") == _GAP)), "gaps")
            plan = plan.unionByName(done)
        top = least
    return plan.select(F.col("size").alias("length"), "first", "sequence", F.col("n").alias("each"), "offset")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, tokenizer: str | None = None) -> DataFrame:
    """The pieces with sequence_id and offset: gapless in each sequence, none over the limit."""
    spark = docs.sparkSession
    found = common.written(pieces(docs, key, text, limit, tokenizer), "pieces")

    def number(batches):
        Encoder.drop()
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            length = batch.column("length").to_numpy()
            if not len(length):
                continue
            start = np.maximum.accumulate(np.where(np.concatenate([[True], length[1:] != length[:-1]]), np.arange(len(length)), 0))
            rank = np.arange(len(length)) - start + np.where((start == 0) & (length == last), seen, 0)
            last, seen = int(length[-1]), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(rank), part, np.int32)), pa.array(rank)], names=[*batch.schema.names, "part", "rank"])

    order = ["length", key, "piece", "_tie"]
    # no number of partitions, so that Spark joins small ones: the pieces are a few bytes each, whatever the texts
    ranged = found.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    kind = docs.schema[key].dataType.simpleString()
    ranked = common.written(ranged.mapInArrow(number, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long"), "ranked")

    counts = common.written(ranked.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    plan = best_fit(counts.groupBy("length").agg(F.sum("n").alias("n")), limit).toPandas().sort_values(["length", "first"])
    # a row for each partition and length it has, which are few more than either
    before = counts.toPandas().sort_values(["length", "part"])
    before["n"] = before.groupby("length")["n"].cumsum() - before["n"]
    wide = np.int64(1) << 48
    shared = spark.sparkContext.broadcast(
        (before["length"].to_numpy(np.int64) * wide + before["part"].to_numpy(np.int64), before["n"].to_numpy(np.int64), plan["length"].to_numpy(np.int64) * wide + plan["first"].to_numpy(np.int64), plan[["first", "sequence", "each", "offset"]].to_numpy(np.int64))
    )

    def place(batches):
        parts, behind, steps, plan = shared.value
        for batch in batches:
            part, length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("part", "length", "rank"))
            rank = rank + behind[np.searchsorted(parts, length * wide + part)]
            first, sequence, each, offset = plan[np.searchsorted(steps, length * wide + rank, side="right") - 1].T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence + (rank - first) // each), pa.array(offset + (rank - first) % each * length)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"))
