"""Exact substring dedup: every byte inside a string of LEAST bytes that starts anywhere else too.

1. Equal texts are collapsed, with their number, into a table bucketed by a hash of the text.
2. A task slides a window of LEAST bytes over its texts. The least hash of a GRAM-byte string in
   the window is its anchor, so equal windows have equal anchors wherever they are. Windows
   that follow each other with the same anchor are one record: a place, not a copy of bytes.
3. Anchors that occur once are dropped. Records with equal bytes are collapsed with their number:
   where it is two or more, each of their windows occurs elsewhere.
4. Anchors with unlike records, some of them alone, are undecided. One record of each kind is
   fetched, and the records of an anchor meet in one task, which sorts the suffixes of groups of
   a few hundred KB in two stages: suffixes smaller than their successors are sorted directly,
   the others are induced by bucket scans; adjacent suffixes with LEAST bytes in common occur twice.
   Anchors with more than WIDE kinds of records are too many for one task. Their records are halved,
   by the place of the anchor in the window, and those parts meet that have the bytes in common which
   all their windows share; again, parts with equal bodies are decided, groups of at most WIDE
   kinds are sorted, and only what is left is halved further, until a part is one window.
5. The windows found give, for each text, the ranges of bytes that go.

No step gathers an anchor or a group of copies: counts are partial sums before a shuffle, and
joins have one row for each key on one side, so that Spark may split the other.

Nulls and edges: a null text is empty; ids may repeat or be null; a text shorter than LEAST is
left alone; a text cut off by nothing but its end never matches across documents. Columns other
than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silthouse.llm import common

LEAST = 400
GRAM = 64
WIDE = 600
SLICE_BYTES = 1 << 20
SORT_BYTES = 384 << 10
_TEXT = ["_t1", "_t2"]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each `gram` bytes that follow each other."""
    global _UP, _DOWN
    if len(_UP) <= len(data):
        _UP, _DOWN = _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=total[1:])
    h = total[gram:] - total[:-gram]
    h *= _DOWN[: len(h)]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` numbers that follow each other."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    full = full.reshape(-1, width)
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(back, np.minimum.accumulate(full, axis=1).ravel()[width - 1 : width - 1 + n])


def records(data: np.ndarray, at: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, number of windows and anchor of each record; texts lie end to end from at[k] to at[k + 1]."""
    first, count = at[:-1], np.maximum(np.diff(at) - least + 1, 0)
    owner = np.repeat(np.arange(len(first)), count)
    if not len(owner):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    windows = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    h = gram_hashes(data, gram)
    low = np.uint64((1 << 24) - 1)  # the leftmost of equal anchors counts
    found = sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), least - gram + 1)[windows] & low
    new = np.ones(len(owner), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    return owner[start], windows[start], np.diff(np.append(start, len(owner))), h[found[start].astype(np.int64)]


def two_stage(body: bytes, ends: np.ndarray, upto: np.ndarray, depth: int) -> np.ndarray:
    """Suffix places in the order of their first `depth` bytes; a suffix stops at its string's end.

    `ends` has the end of each string in `body`; suffixes that start before upto[k] are wanted of
    string k, and some of the later ones may come too. A suffix is small if it is smaller than its
    successor, the one that starts a byte later.
    """
    data = np.frombuffer(body, np.uint8).astype(np.int16)
    n = len(data)
    end_of = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    follows = np.full(n, -1, np.int16)  # a string's end is smaller than any byte
    follows[:-1] = data[1:]
    follows[ends - 1] = -1
    differs = data != follows
    decided = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]  # the next place that differs from its successor
    small = data[decided] < follows[decided]
    # each chain of large suffixes is induced from the small one behind it, or from its string's end
    stop = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]
    begin = np.concatenate([[0], ends[:-1]])
    last = np.minimum(stop[np.maximum(upto - 1, begin)], ends - 1)
    used = np.arange(n) <= np.repeat(last, ends - begin)
    direct = np.flatnonzero(small & used).tolist()
    limits = np.minimum(np.array(direct, np.int64) + depth, end_of[direct] if direct else 0).tolist()
    keys = [body[a:b] for a, b in zip(direct, limits, strict=True)]
    direct = np.array([direct[i] for i in sorted(range(len(keys)), key=keys.__getitem__)], np.int64)
    del keys
    heads = np.searchsorted(data[direct], np.arange(257))
    large = ~small & used
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def pass_on(places: np.ndarray, byte: int) -> np.ndarray:
        """Large predecessors of sorted suffixes: those of higher bytes wait, those of this byte come back."""
        before = places[(places > 0)] - 1
        before = before[large[before] & (end_of[before] > before + 1)]
        own = data[before]
        for c in np.unique(own[own > byte]).tolist():
            waiting[c].append(before[own == c])
        return before[own == byte]

    lone = np.flatnonzero(large[ends - 1])
    lone = ends[lone] - 1  # one byte long: first in their buckets
    out = []
    for c in range(256):
        wave = np.concatenate([lone[data[lone] == c], *waiting[c]])
        waiting[c] = []
        while len(wave):
            out.append(wave)
            wave = pass_on(wave, c)
        part = direct[heads[c] : heads[c + 1]]
        out.append(part)
        pass_on(part, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _words(body: bytes) -> np.ndarray:
    """The eight bytes from each place, as a number."""
    raw = np.frombuffer(body + b"\0" * 8, np.uint8).astype(np.uint64)
    out = np.zeros(len(body), np.uint64)
    for k in range(8):
        out |= raw[k : k + len(body)] << np.uint64(8 * k)
    return out


def common_prefixes(body: bytes, order: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, at most `depth`, that each suffix of an order shares with the one before it (the first: none)."""
    out = np.zeros(len(order), np.int64)
    end_of = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    room = np.minimum(end_of[order] - order, depth)
    left, right = order[:-1], order[1:]
    most = np.minimum(room[:-1], room[1:])
    words, open_ = _words(body), np.arange(len(left))
    for k in range(0, depth, 8):
        open_ = open_[most[open_] > k]
        if not len(open_):
            break
        x = words[left[open_] + k] ^ words[right[open_] + k]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        out[open_ + 1] = np.minimum(k + same, most[open_])
        open_ = open_[x == 0]
    return out


def repeated(strings: list[bytes], counts: list[int], least: int) -> list[list[tuple[int, int]]]:
    """For each string, ranges of window starts (of counts[k] windows) whose `least` bytes start elsewhere in the strings too."""
    body = b"".join(strings)
    ends = np.cumsum([len(s) for s in strings])
    begin = np.concatenate([[0], ends[:-1]])
    owner = np.repeat(np.arange(len(strings)), ends - begin)
    upto = begin + np.array(counts)
    order = two_stage(body, ends, upto, least)
    order = order[order < upto[owner[order]]]
    shared = common_prefixes(body, order, ends, least) >= least
    shared[:-1] |= shared[1:]
    hit = np.zeros(len(body) + 1, bool)
    hit[order[shared]] = True
    edges = np.diff(hit.astype(np.int8), prepend=0)
    first, stop = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for a, b in zip(first.tolist(), stop.tolist(), strict=True):
        k = owner[a]
        while a < b:  # a run may go on into the next string
            c = min(b, int(ends[k]))
            out[k].append((a - int(begin[k]), c - int(begin[k])))
            a, k = c, k + 1
    return out


def _bucketed(docs: DataFrame, text: str) -> DataFrame:
    """_t1, _t2, _text, copies: the distinct texts, bucketed by _t1 and _t2."""
    spark = docs.sparkSession
    texts = docs.select(*_TEXT, F.coalesce(F.col(text), F.lit("")).alias("_text")).groupBy(*_TEXT).agg(F.first("_text").alias("_text"), F.count(F.lit(1)).alias("copies"))
    name = f"silthouse_texts_{uuid.uuid4().hex}"
    texts.write.bucketBy(common.partitions(spark), *_TEXT).option("path", f"{common.shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _anchored(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """anchor, body (a hash), _t1, _t2, start, n, copies: the records of the texts."""

    def emit(batches):
        for batch in common.slices(batches, "_text", SLICE_BYTES):
            data, at = common.byte_view(batch.column("_text"))
            # a long text goes in sections that overlap by a window less one byte
            for a in range(0, max(len(data) - least + 1, 1), 8 * SLICE_BYTES):
                part = data[a : a + 8 * SLICE_BYTES + least - 1] if batch.num_rows == 1 else data
                owner, start, n, anchor = records(part, np.array([0, len(part)]) if batch.num_rows == 1 else at, least, gram)
                view = memoryview(part)
                body = [xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(start.tolist(), (start + n + least - 1).tolist(), strict=True)]
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(np.array(body, np.uint64).view(np.int64)), batch.column("_t1").take(own), batch.column("_t2").take(own), pa.array((start - at[owner] + a).astype(np.int32)), pa.array(n.astype(np.int32)), batch.column("copies").take(own)],
                    names=["anchor", "body", *_TEXT, "start", "n", "copies"],
                )
                if batch.num_rows > 1:
                    break

    found = texts.filter(F.octet_length("_text") >= least).mapInArrow(emit, "anchor long, body long, _t1 long, _t2 long, start int, n int, copies long")
    return common.written(found, "anchors")


def anchor_place(string: bytes, least: int, gram: int) -> int:
    """Where the anchor of a record begins in its bytes."""
    h = gram_hashes(np.frombuffer(string, np.uint8, count=least), gram)
    return int(np.argmin(h >> np.uint64(24)))


def halves(string: bytes, n: int, at: int, width: int, least: int) -> list[tuple[int, int, int, bytes]]:
    """Parts of a record of n windows with its anchor at `at`: number, first window, windows, and the bytes that any window there has.

    A window whose anchor is i bytes from its start is in part i // width, so equal windows
    are in parts of the same number with the same shared bytes.
    """
    out = []
    for cell in range((at - n + 1) // width, at // width + 1):
        last = at - cell * width
        first = max(0, last - width + 1)
        out.append((cell, first, min(n - 1, last) - first + 1, string[last : last - width + 1 + least]))
    return out


_PART = "anchor long, body long, first int, n int, at int, string binary"


def _sorted(rows: DataFrame, least: int) -> DataFrame:
    """anchor, body, first, stop of windows that occur in two rows of a key: key, anchor, body, first, n, string."""

    def sort(batches):
        held: list[tuple] = []
        size, last = 0, None

        def judged():
            found = repeated([x[5] for x in held], [x[4] for x in held], least)
            rows = [(x[1], x[2], x[3] + a, x[3] + b) for x, own in zip(held, found, strict=True) for a, b in own]
            if rows:
                anchor, body, first, stop = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(body, pa.int64()), pa.array(first, pa.int32()), pa.array(stop, pa.int32())], names=["anchor", "body", "first", "stop"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "anchor", "body", "first", "n", "string")), strict=True):
                if size > SORT_BYTES and row[0] != last:
                    yield from judged()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[5]), row[0]
        if held:
            yield from judged()

    n = common.partitions(rows.sparkSession)
    return rows.select("key", "anchor", "body", "first", "n", "string").repartition(n, "key").sortWithinPartitions("key").mapInArrow(sort, "anchor long, body long, first int, stop int")


def _halved(wide: DataFrame, least: int, gram: int) -> list[DataFrame]:
    """Tables of anchor, body, first, stop: window ranges that occur in two of the records of an anchor, which are too many for one task."""
    found = []
    width = 1 << (least - gram + 1).bit_length() - 1
    while width and not wide.isEmpty():

        def cut(batches, width=width):
            for batch in batches:
                for part in common.parts(batch, "string", SLICE_BYTES):
                    rows = []
                    for anchor, body, first, n, at, string in zip(*(part.column(c).to_pylist() for c in ("anchor", "body", "first", "n", "at", "string")), strict=True):
                        for cell, a, count, core in halves(string, n, at, width, least):
                            own = string[a : a + count + least - 1]
                            rows.append((xxhash.xxh3_64_intdigest(core, (anchor ^ cell) & (1 << 64) - 1), xxhash.xxh3_64_intdigest(own), anchor, body, first + a, count, at - a, own))
                    key, kind, anchor, body, first, n, at, own = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (key, kind)), pa.array(anchor, pa.int64()), pa.array(body, pa.int64()), *(pa.array(x, pa.int32()) for x in (first, n, at)), pa.array(own, pa.binary())],
                        names=["key", "kind", "anchor", "body", "first", "n", "at", "string"],
                    )

        halved = common.written(wide.mapInArrow(cut, f"key long, kind long, {_PART}"), "halves", compression="zstd")
        kinds = common.written(halved.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("number"), F.first(F.struct("anchor", "body", "first", "n", "at", "string")).alias("one")), "half-kinds", compression="zstd")
        twice = kinds.filter("number > 1").select("key", "kind")
        found.append(halved.join(twice, ["key", "kind"], "left_semi").select("anchor", "body", "first", (F.col("first") + F.col("n")).alias("stop")))
        open_ = common.written(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("number").alias("fewest")).filter("kinds > 1 and fewest = 1").select("key", "kinds"), "open")
        left = common.written(kinds.join(open_, "key").select("key", "kinds", "one.*"), "half-records", compression="zstd")
        found.append(_sorted(left.filter(F.col("kinds") <= WIDE), least))
        wide, width = left.filter(F.col("kinds") > WIDE).drop("key", "kinds"), width // 2
    return found


def _undecided(places: DataFrame, kinds: DataFrame, texts: DataFrame, least: int, gram: int) -> DataFrame:
    """anchor, body, first, stop: window ranges, from the record's start, that occur elsewhere, of records that are alone."""
    open_ = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("number").alias("fewest")).filter("kinds > 1 and fewest = 1").select("anchor", "kinds")
    open_ = common.written(open_, "open-anchors")  # so that Spark may split an anchor with very many kinds
    # one place of each kind is found before the join, so that the join has no more rows of an anchor than kinds
    one = places.groupBy("anchor", "body").agg(F.min(F.struct(*_TEXT, "start", "n")).alias("at")).join(open_, "anchor")
    needed = one.select("at._t1", "at._t2", F.struct("anchor", "body", "kinds", "at.start", "at.n").alias("record")).groupBy(*_TEXT).agg(F.collect_list("record").alias("records"))

    def fetch(batches):
        for batch in common.slices(batches, "_text", SLICE_BYTES):
            rows = []
            for text, wanted in zip(common.strings(batch.column("_text")), batch.column("records").to_pylist(), strict=True):
                for x in wanted:
                    string = text[x["start"] : x["start"] + x["n"] + least - 1]
                    rows.append((x["anchor"], x["body"], x["kinds"], x["n"], anchor_place(string, least, gram) if x["kinds"] > WIDE else 0, string))
            for a in range(0, len(rows), 2000):
                anchor, body, kinds, n, at, string = zip(*rows[a : a + 2000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor, pa.int64()), pa.array(body, pa.int64()), pa.array(kinds, pa.int64()), pa.array([0] * len(n), pa.int32()), pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(string, pa.binary())],
                    names=["anchor", "body", "kinds", "first", "n", "at", "string"],
                )

    fetched = texts.join(needed, _TEXT).select("_text", "records").mapInArrow(fetch, "anchor long, body long, kinds long, first int, n int, at int, string binary")
    fetched = common.written(fetched, "records", compression="zstd")
    found = _sorted(fetched.filter(F.col("kinds") <= WIDE).withColumn("key", F.col("anchor")), least)
    for more in _halved(fetched.filter(F.col("kinds") > WIDE).drop("kinds"), least, gram):
        found = found.unionByName(more)
    return found


def removed(docs: DataFrame, text: str, least: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The distinct texts of documents with _t1 and _t2; _t1, _t2, cuts: byte ranges that go, in any order, overlapping."""
    texts = _bucketed(docs, text)
    anchors = _anchored(texts, least, gram)
    # written, so that no aggregate stands in the join's stage and Spark may split an anchor with very many rows
    often = common.written(anchors.groupBy("anchor").agg(F.sum("copies").alias("c")).filter("c > 1").select("anchor"), "often")
    places = common.written(anchors.join(often, "anchor", "left_semi"), "places")
    kinds = common.written(places.groupBy("anchor", "body").agg(F.sum("copies").alias("number")), "kinds")
    whole = places.join(kinds.filter("number > 1").select("anchor", "body"), ["anchor", "body"], "left_semi").select(*_TEXT, F.col("start").alias("a"), (F.col("start") + F.col("n") + (least - 1)).alias("b"))
    found = _undecided(places, kinds, texts, least, gram).join(kinds.filter("number = 1").select("anchor", "body"), ["anchor", "body"], "left_semi")
    part = places.join(found, ["anchor", "body"]).select(*_TEXT, (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("stop") + (least - 1)).alias("b"))
    return texts, whole.unionByName(part).groupBy(*_TEXT).agg(F.collect_list(F.struct("a", "b")).alias("cuts"))


def _merge(cuts: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in cuts or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for c in cuts for x in c), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("_t1", F.xxhash64(body)).withColumn("_t2", F.xxhash64(F.lit("text"), body))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept (the bytes that are left)."""
    return _results(docs, key, text, least, gram, True)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256."""
    return _results(docs, key, text, least, gram, False)


def _results(docs: DataFrame, key: str, text: str, least: int, gram: int, whole: bool) -> DataFrame:
    own = _keyed(docs.select(key, text), text)
    texts, cuts = removed(own, text, least, gram)
    name, kind = ("kept", pa.binary()) if whole else ("kept_sha256", pa.string())

    def apply(batches):
        for batch in common.slices(batches, "_text", 4 * SLICE_BYTES):
            rows = []
            for body, wanted in zip(common.strings(batch.column("_text")), batch.column("cuts").to_pylist(), strict=True):
                merged = _merge(wanted)
                kept = _kept(body, merged)
                rows.append((len(body), len(body) - len(kept), len(merged), kept if whole else hashlib.sha256(kept).hexdigest()))
            n, gone, spans, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("_t1"), batch.column("_t2"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, kind)], names=[*_TEXT, "n_bytes", "n_removed", "n_spans", name])

    results = texts.join(cuts, _TEXT, "left").select(*_TEXT, "_text", "cuts").mapInArrow(apply, f"_t1 long, _t2 long, n_bytes long, n_removed long, n_spans long, {name} {'binary' if whole else 'string'}")
    return own.select(key, *_TEXT).join(common.written(results, "results"), _TEXT).drop(*_TEXT)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.read(spark, sf_dir, "documents"))
