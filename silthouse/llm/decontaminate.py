"""Benchmark decontamination by suffix arrays over the training documents.

1. Each task cuts its documents into shards of about SHARD_BYTES. A shard's words are numbered in the
   order of their bytes, and all its word suffixes are sorted by prefix doubling over these numbers, where
   after each round only ties go on. Dictionary, numbers and suffix array are written, one row a shard.
2. The benchmark goes through the driver in blocks of about BLOCK_BYTES of text, one after the other: a block
   is broadcast, searched for in all stored shards, and destroyed before the next one is made.
3. Every test suffix is binary-searched in a shard by its window, all of a block in one vectorised
   descent; the interval it finds is the places where the window occurs. Each place's longest match is where
   the document's suffix falls among the block's own sorted suffixes.
4. Matches are rows of a document: runs of hit words, items, longest match. They are put together by
   document over blocks and sections.

Arrays refer to one buffer, so memory is linear in shard and block, whatever the length of an item.
A text longer than a shard goes in sections that overlap by a window less one word, and so does an item. A match that runs
over the end of a section is found as pieces in both, each with its item and distance; pieces that touch are one match again.

Nulls and edges: a null text has no words; a null item_id counts as the item "". An item of
fewer than `window` words is one window of all its words; an item without words matches nothing.
Repeated documents are judged one by one; of equally long matches the largest item counts, then the first place. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silthouse.llm import common

WINDOW = 10
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def word_edges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words end to end in lower case, where each begins and ends in `data`, and the first word of each text."""
    low = _LOWER[data]
    mask = _WORD[low]
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    inner = at[:-1][at[:-1] < len(data)]
    begins[inner] = mask[inner]
    inner = at[1:][at[1:] > 0] - 1
    ends[inner] = mask[inner]
    begin = np.flatnonzero(begins)
    return low[mask], begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, at)


def suffix_array(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of all words, in the order of the suffixes that start there; a suffix stops at the 0 behind its text."""
    order = np.flatnonzero(ids)
    order = order[np.argsort(ids[order], kind="stable")]
    stop = np.repeat(first[1:] - 1, np.diff(first))
    rank = np.zeros(len(ids), np.int64)
    key = ids[order].astype(np.int64)
    where, step = np.arange(len(order)), 1
    while len(where):
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[where]] = where[np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))] + 1
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = where[tied]
        places = order[where]
        more = places + step <= stop[places]  # the others are compared to the 0 behind them
        where, places = where[more], places[more]
        key = rank[places] * (len(ids) + 1) + rank[places + step]
        by = np.argsort(key, kind="stable")
        order[where], key = places[by], key[by]
        step *= 2
    return order


class Words:
    """Numbered words of several texts, with a 0 behind each text, and their suffix array."""

    def __init__(self, vocabulary: pa.Array, ids: np.ndarray, first: np.ndarray, order: np.ndarray):
        self.vocabulary, self.ids, self.first, self.order = vocabulary, ids, first, order
        self.stop = np.repeat(first[1:] - 1, np.diff(first))

    @classmethod
    def of(cls, data: np.ndarray, at: np.ndarray) -> Words:
        letters, begin, end, first = word_edges(data, at)
        offsets = np.concatenate([[0], np.cumsum(end - begin)])
        coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        by = pc.sort_indices(coded.dictionary)
        number = np.empty(len(by), np.int32)
        number[by.to_numpy()] = np.arange(1, len(by) + 1)
        texts = len(at) - 1
        ids = np.zeros(len(begin) + texts, np.int32)
        ids[np.arange(len(begin)) + np.repeat(np.arange(texts), np.diff(first))] = number[coded.indices.to_numpy()]
        first = first + np.arange(texts + 1)
        return cls(coded.dictionary.take(by), ids, first, suffix_array(ids, first))

    def stored(self) -> tuple[bytes, bytes, bytes, bytes]:
        return b" ".join(self.vocabulary.to_pylist()), self.ids.tobytes(), self.first.tobytes(), self.order.astype(np.int32).tobytes()

    @classmethod
    def read(cls, vocabulary: bytes, ids: bytes, first: bytes, order: bytes) -> Words:
        return cls(pa.array(vocabulary.split(b" ") if vocabulary else [], pa.large_binary()), np.frombuffer(ids, np.int32), np.frombuffer(first, np.int64), np.frombuffer(order, np.int32))


def _sections(data: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, int, int, bool]]:
    """Parts of a long text, the number of its words before each, the part's words that were in none before, and whether the text goes on."""
    start = before = 0
    size, overlap = SHARD_BYTES, 0
    while True:
        stop = min(start + size, len(data))
        while stop < len(data) and _WORD[_LOWER[data[stop]]]:
            stop += 1
        part = data[start:stop]
        _, begin, _, _ = word_edges(part, np.array([0, len(part)]))
        if stop < len(data) and len(begin) < 2 * window:
            size *= 2
            continue
        yield part, before, len(begin) - overlap, stop < len(data)
        if stop == len(data):
            return
        overlap, size = window - 1, SHARD_BYTES
        before += len(begin) - overlap
        start += int(begin[-overlap]) if overlap else stop - start


def shards(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Written shards: doc (a number), key, at (words before the section), own (words) and more (the text goes on) of each text in it; its arrays."""
    kind = docs.schema[key].dataType

    def build(batches):
        doc = TaskContext.get().partitionId() << 33
        for batch in common.slices(batches, text, SHARD_BYTES):
            data, at = common.byte_view(batch.column(text))
            if len(data) > SHARD_BYTES and batch.num_rows == 1:
                made = [(Words.of(part, np.array([0, len(part)])), [before], [own], [more]) for part, before, own, more in _sections(data, window)]
            else:
                words = Words.of(data, at)
                made = [(words, [0] * batch.num_rows, np.diff(words.first) - 1, [False] * batch.num_rows)]
            for words, before, own, more in made:
                whole = pa.array([0, batch.num_rows], pa.int32())
                lists = [pa.array(range(doc, doc + batch.num_rows), pa.int64()), batch.column(key), pa.array(before, pa.int64()), pa.array(own, pa.int64()), pa.array(more, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(whole, x) for x in lists), *(pa.array([x], pa.binary()) for x in words.stored())], names=["doc", "key", "at", "own", "more", "vocabulary", "ids", "first", "suffixes"])
            doc += batch.num_rows

    rows = docs.select(key, text).mapInArrow(build, f"doc array<long>, key array<{kind.simpleString()}>, at array<long>, own array<long>, more array<boolean>, vocabulary binary, ids binary, first binary, suffixes binary")
    return common.written(rows, "shards", compression="zstd", **{"parquet.block.row.count.limit": 4})


class Block:
    """Test suffixes of some items: their suffix array, the different windows, and the items of each.

    `parts` says of each text which row of the benchmark it is, how many of its words are before, and whether it goes on.
    """

    def __init__(self, items: list[tuple[str, str]], window: int, parts: list[tuple[int, int, bool]] | None = None):
        self.parts = parts or [(k, 0, False) for k in range(len(items))]
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.words = words = Words.of(*common.byte_view(pa.array([t for _, t in items], pa.string())))
        begin = np.repeat(words.first[:-1], np.diff(words.first))
        self.item = np.repeat(np.array([number[name] for name, _ in items], np.int64), np.diff(words.first))
        order, stop = words.order, words.stop
        # a window is a suffix with as many words, or a whole item that is shorter
        at = np.flatnonzero((stop[order] - order >= window) | (order == begin[order]))
        start = order[at]
        n = np.minimum(stop[start] - start, window)
        spread = np.minimum(start[:, None] + np.arange(window), len(words.ids) - 1)
        each = np.where(np.arange(window) < n[:, None], words.ids[spread], 0)
        new = np.ones(len(at), bool)
        new[1:] = (each[1:] != each[:-1]).any(axis=1)
        self.windows, self.n = each[new], n[new]
        heads = np.flatnonzero(new)
        self.low = at[heads]
        self.high = at[np.append(heads[1:], len(at)) - 1] + 1 if len(at) else at
        pairs = np.unique((np.cumsum(new) - 1) * len(self.names) + self.item[start])
        self.items = pairs % max(len(self.names), 1)
        self.of = np.searchsorted(pairs, np.arange(len(heads) + 1) * len(self.names))

    def search(self, shard: Words) -> tuple[np.ndarray, np.ndarray]:
        """The place in the shard of every occurrence of a window, and the window's number."""
        number = np.concatenate([[0], pc.index_in(self.words.vocabulary, value_set=shard.vocabulary).fill_null(-1).to_numpy() + 1])
        wanted = number[self.windows]
        which = np.flatnonzero(((wanted > 0) | (self.windows == 0)).all(axis=1))
        wanted, n = wanted[which], self.n[which]
        width = wanted.shape[1]
        ids = np.concatenate([shard.ids, np.zeros(width, np.int32)])
        heads = shard.ids[shard.order]

        def bound(upper: bool) -> np.ndarray:
            low, high = np.searchsorted(heads, wanted[:, 0]), np.searchsorted(heads, wanted[:, 0], side="right")
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) // 2
                place = shard.order[middle].astype(np.int64)
                sign = np.zeros(len(open_), np.int64)
                for k in range(1, width):
                    sign = np.where((sign == 0) & (n[open_] > k), np.sign(ids[place + k] - wanted[open_, k]), sign)
                below = sign <= 0 if upper else sign < 0
                low[open_[below]] = middle[below] + 1
                high[open_[~below]] = middle[~below]
                open_ = open_[low[open_] < high[open_]]
            return low

        low, high = bound(False), bound(True)
        count = high - low
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return shard.order[at].astype(np.int64), np.repeat(which, count)

    def pieces(self, shard: Words, place: np.ndarray, window: np.ndarray, at: np.ndarray, more: np.ndarray, both: tuple[tuple, tuple]) -> list[tuple]:
        """(text in the shard, first word, word behind the last, row, first word in the item, item) of all matches that end with a section.

        Every window that begins or ends a cut section, of the text or of the item, is drawn out to both sides.
        """
        width, words = self.windows.shape[1], self.words
        row, before, goes_on = (np.array(x) for x in zip(*self.parts, strict=True))

        def cut(w: Words, p: np.ndarray, begun: np.ndarray, on: np.ndarray) -> np.ndarray:
            text = np.searchsorted(w.first, p, side="right") - 1
            return ((p == w.first[text]) & begun[text]) | ((p + width == w.stop[p]) & on[text])

        # positions in the items that begin or end a section, by window
        full = np.flatnonzero(self.n == width)
        spans = self.high[full] - self.low[full]
        spot = words.order[np.repeat(self.low[full] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())].astype(np.int64)
        of = np.repeat(full, spans)
        kept = cut(words, spot, before > 0, goes_on)
        spot, of = spot[kept], of[kept]
        near = np.flatnonzero(cut(shard, place, at > 0, more) & (self.n[window] == width))
        if not len(near) and not len(spot):
            return []
        n = self.high[window[near]] - self.low[window[near]]
        p = np.repeat(place[near], n)
        b = words.order[np.repeat(self.low[window[near]] - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64)
        low, high = np.searchsorted(of, window), np.searchsorted(of, window, side="right")
        n = high - low
        p = np.concatenate([p, np.repeat(place, n)])
        b = np.concatenate([b, spot[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]])
        text, item = np.searchsorted(shard.first, p, side="right") - 1, np.searchsorted(words.first, b, side="right") - 1
        mine, theirs = both
        ahead = _common(theirs, mine, p, b, np.minimum(shard.stop[p] - p, words.stop[b] - b))
        back = _common(theirs, mine, p, b, np.minimum(p - shard.first[text], b - words.first[item]), -1)
        start = p - shard.first[text] + at[text]
        each = np.stack([text, start - back, start + ahead, row[item], b - words.first[item] + before[item] - back, self.item[words.first[item]]])
        return [tuple(x) for x in np.unique(each, axis=1).T.tolist()]

    def longest(self, shard: Words, place: np.ndarray, window: np.ndarray, both: tuple[tuple, tuple] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Words of the longest match from each place on, and the largest item that has it; for the best places of a document, else -1."""
        mine, theirs = both or _Compared(self.words, shard).both()
        order, stop = self.words.order, self.words.stop
        most, item = self.n[window].copy(), np.full(len(place), -1)
        whole = np.flatnonzero(most == self.windows.shape[1])
        p, low, high = place[whole], self.low[window[whole]], self.high[window[whole]]
        room = shard.stop[p] - p

        def shared(k: np.ndarray, at: np.ndarray) -> np.ndarray:
            return _common(theirs, mine, p[k], order[at], np.minimum(room[k], stop[order[at]] - order[at]))

        a, b = low.copy(), high.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) // 2
            n = shared(open_, middle)
            other = order[middle]
            ended = n == stop[other] - other
            x, y = theirs[0][np.minimum(p[open_] + n, len(theirs[0]) - 1)], mine[0][np.minimum(other + n, len(mine[0]) - 1)]
            below = (ended & (n < room[open_])) | (~ended & (n < room[open_]) & (y < x))
            a[open_[below]] = middle[below] + 1
            b[open_[~below]] = middle[~below]
            open_ = open_[a[open_] < b[open_]]
        for at, ok in ((a - 1, a > low), (a, a < high)):
            k = np.flatnonzero(ok)
            most[whole[k]] = np.maximum(most[whole[k]], shared(k, at[k]))
        owner = np.searchsorted(shard.first, place, side="right") - 1
        best = np.zeros(len(shard.first), np.int64)
        np.maximum.at(best, owner, most)
        chosen = most == best[owner]
        for k in np.flatnonzero(chosen & (self.n[window] < self.windows.shape[1])).tolist():
            item[k] = self.items[self.of[window[k]] : self.of[window[k] + 1]].max()
        k = np.flatnonzero(chosen[whole])
        left, right = low[k], a[k]  # the suffixes that share as much lie around the place
        for side in (0, 1):
            x, y = (left.copy(), right.copy()) if side == 0 else (a[k].copy(), high[k].copy())
            open_ = np.flatnonzero(x < y)
            while len(open_):
                middle = (x[open_] + y[open_]) // 2
                up = (shared(k[open_], middle) < most[whole[k[open_]]]) == (side == 0)
                x[open_[up]] = middle[up] + 1
                y[open_[~up]] = middle[~up]
                open_ = open_[x[open_] < y[open_]]
            left, right = (x, right) if side == 0 else (left, x)
        known: dict[tuple[int, int], int] = {}
        for at, x, y in zip(whole[k].tolist(), left.tolist(), right.tolist(), strict=True):
            if (x, y) not in known:
                known[x, y] = int(self.item[order[x:y]].max())
            item[at] = known[x, y]
        return most, item


class _Compared:
    """The words of a block and a shard on one scale: even for the block's, odd between them for words it lacks."""

    def __init__(self, block: Words, shard: Words):
        have = np.array(block.vocabulary.to_pylist(), object)
        words = np.array(shard.vocabulary.to_pylist(), object)
        low, high = np.searchsorted(have, words), np.searchsorted(have, words, side="right")
        self.block = 2 * block.ids.astype(np.int64)
        self.shard = np.concatenate([[-1], low + high + 1])[shard.ids]

    def both(self) -> tuple[tuple, tuple]:
        return _hashed(self.block), _hashed(self.shard)


def _hashed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, sums of their hashes times powers of a base, and the inverse powers."""
    each = x.astype(np.uint64) * _MIX
    each ^= each >> np.uint64(31)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(each * _powers(_BASE, len(x)), out=total[1:])
    return x, total, _powers(_INVERSE, len(x) + 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _common(left: tuple, right: tuple, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int = 1) -> np.ndarray:
    """How many numbers two sequences share from a and b on, or before them with -1 as `way`, at most `most`: by their hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_] + 1) // 2
        x, y = (a[open_], b[open_]) if way > 0 else (a[open_] - middle, b[open_] - middle)
        same = (left[1][x + middle] - left[1][x]) * left[2][x] == (right[1][y + middle] - right[1][y]) * right[2][y]
        low[open_[same]] = middle[same]
        high[open_[~same]] = middle[~same] - 1
    return low


def blocks(benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id") -> Iterator[Block]:
    """The benchmark, in blocks of about BLOCK_BYTES; a longer single item goes in sections, a shorter rest with the next items."""
    rows, parts, size = [], [], 0
    for row, (name, body) in enumerate( benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).toLocalIterator()):
        cut = [(body, 0, False)]
        if len(body) > SHARD_BYTES:
            cut = [(part.tobytes().decode(), before, more) for part, before, _, more in _sections(np.frombuffer(body.encode(), np.uint8), window)]
        for part, before, more in cut:
            if rows and size + len(part) > BLOCK_BYTES:
                yield Block(rows, window, parts)
                rows, parts, size = [], [], 0
            rows.append((name, part))
            parts.append((row, before, more))
            size += len(part)
    if rows:
        yield Block(rows, window, parts)


_MATCH = "doc long, runs array<struct<start:long,stop:long>>, items array<string>, longest struct<words:long,item:string,back:long>, pieces array<struct<start:long,stop:long,row:long,at:long,item:string>>"


def _matched(block: Block, words: Words, at: list[int], more: list[bool]) -> list[tuple]:
    """(text in the shard, runs of hit words, items, longest match, pieces of longer ones) of every text with matches."""
    place, window = block.search(words)
    if not len(place):
        return []
    edge = np.bincount(place, minlength=len(words.ids) + 1) - np.bincount(place + block.n[window], minlength=len(words.ids) + 1)
    hit = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
    starts, stops = np.flatnonzero(np.diff(hit) > 0), np.flatnonzero(np.diff(hit) < 0)
    of = np.searchsorted(words.first, starts, side="right") - 1
    runs: dict[int, list] = {}
    for d, a, b in zip(of.tolist(), starts.tolist(), stops.tolist(), strict=True):
        shift = at[d] - int(words.first[d])
        runs.setdefault(d, []).append({"start": a + shift, "stop": b + shift})
    owner = np.searchsorted(words.first, place, side="right") - 1
    both = _Compared(block.words, words).both()
    pieces: dict[int, list] = {}
    for d, start, stop, row, first, which in block.pieces(words, place, window, np.array(at), np.array(more), both):
        pieces.setdefault(d, []).append({"start": start, "stop": stop, "row": row, "at": first, "item": block.names[which]})
    most, item = block.longest(words, place, window, both)
    best: dict[int, tuple] = {}
    for k in np.flatnonzero(item >= 0).tolist():
        d = int(owner[k])
        best[d] = max(best.get(d, (0, -1, 0)), (int(most[k]), int(item[k]), int(words.first[d] - place[k]) - at[d]))
    pairs = np.unique(owner * len(block.n) + window)
    cut = np.searchsorted(pairs, np.array(sorted(runs)) * len(block.n))
    out = []
    for d, own in zip(sorted(runs), np.split(pairs % len(block.n), cut[1:]), strict=True):
        items = np.unique(np.concatenate([block.items[block.of[w] : block.of[w + 1]] for w in own.tolist()]))
        n, which, back = best[d]
        out.append((d, runs[d], [block.names[i] for i in items.tolist()], {"words": n, "item": block.names[which], "back": back}, pieces.get(d, [])))
    return out


def matches(stored: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Written matches of stored shards: doc, key, runs, items, longest, pieces; a row for each section with matches and each block."""
    spark = stored.sparkSession
    kind = stored.schema["key"].dataType.elementType.simpleString()
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    piece_type = pa.list_(pa.struct([*((c, pa.int64()) for c in ("start", "stop", "row", "at")), ("item", pa.string())]))
    best_type = pa.struct([("words", pa.int64()), ("item", pa.string()), ("back", pa.int64())])
    found = spark.createDataFrame([], f"key {kind}, {_MATCH}")
    for block in blocks(benchmark, window):
        sent = spark.sparkContext.broadcast(block)

        def search(batches, sent=sent):
            for batch in batches:
                for i in range(batch.num_rows):
                    arrays = [batch.column(c)[i].as_buffer() for c in ("vocabulary", "ids", "first", "suffixes")]
                    rows = _matched(sent.value, Words.read(arrays[0].to_pybytes(), *arrays[1:]), batch.column("at")[i].as_py(), batch.column("more")[i].as_py())
                    if rows:
                        of, runs, items, longest, pieces = zip(*rows, strict=True)
                        own = pa.array(of)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("key")[i].values.take(own), batch.column("doc")[i].values.take(own), pa.array(runs, runs_type), pa.array(items, pa.list_(pa.string())), pa.array(longest, best_type), pa.array(pieces, piece_type)],
                            names=["key", "doc", "runs", "items", "longest", "pieces"],
                        )

        own = stored.select("doc", "key", "at", "more", "vocabulary", "ids", "first", "suffixes").mapInArrow(search, f"key {kind}, {_MATCH}")
        found = found.unionByName(common.written(own, "matches"))
        sent.destroy()
    return found


def _covered(runs: Column) -> Column:
    """The words in sorted runs that may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda x, r: F.struct(F.greatest(x["end"], r["stop"]).alias("end"), (x["n"] + F.greatest(r["stop"] - F.greatest(x["end"], r["start"]), F.lit(0))).alias("n"))
    return F.aggregate(F.sort_array(runs), start, step, lambda x: x["n"])


def _joined(found: DataFrame) -> DataFrame:
    """doc, longest of the matches that sections cut: pieces of one document, benchmark row and distance that touch are one."""
    each = found.select("doc", F.explode("pieces").alias("p")).groupBy("doc", "p.row", (F.col("p.start") - F.col("p.at")).alias("_far")).agg(F.array_sort(F.collect_set(F.struct("p.start", "p.stop"))).alias("_p"), F.min("p.item").alias("_item"))
    none = F.struct(*(F.lit(-1).cast("long").alias(c) for c in ("start", "stop", "first", "n")))

    def step(x: Column, p: Column) -> Column:
        start = F.when(p["start"] <= x["stop"], x["start"]).otherwise(p["start"])
        stop = F.greatest(x["stop"], p["stop"])
        longer = stop - start > x["n"]
        return F.struct(start.alias("start"), stop.alias("stop"), F.when(longer, start).otherwise(x["first"]).alias("first"), F.greatest(stop - start, x["n"]).alias("n"))

    best = F.aggregate("_p", none, step)
    return each.select("doc", best.alias("_b"), "_item").select("doc", F.struct(F.col("_b.n").alias("words"), F.col("_item").alias("item"), (-F.col("_b.first")).alias("back")).alias("longest"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, words inside benchmark windows, items found, longest match, places (runs of hit words)."""
    stored = shards(docs, window, key, text)
    found = matches(stored, benchmark, window)
    each = stored.select(F.explode(F.arrays_zip("doc", "key", "own")).alias("x")).select("x.key", "x.doc", F.col("x.own").alias("own"))
    rows = each.unionByName(found.drop("pieces"), allowMissingColumns=True).unionByName(_joined(found), allowMissingColumns=True).groupBy("doc").agg(
        F.first("key", ignorenulls=True).alias(key), F.sum("own").alias("n_words"), F.flatten(F.collect_list("runs")).alias("_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"), F.max("longest").alias("_best")
    )
    return rows.select(
        key, "n_words", _covered(F.col("_runs")).alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("_items", ","), "utf-8"), 256).alias("items_sha256"), (F.size("_runs") > 0).alias("contaminated"),
        F.coalesce("_best.words", F.lit(0).cast("long")).alias("longest_words"), F.col("_best.item").alias("longest_item"), (-F.col("_best.back")).alias("longest_at"), F.array_join(F.transform(F.array_distinct(F.sort_array("_runs")), lambda r: F.concat_ws(":", r["start"], r["stop"])), ",").alias("places"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that share a window with the benchmark; all columns stay."""
    rows = common.set_aside(docs, key, text)
    named = rows.withColumn("_t", F.md5(F.coalesce(F.col("_body"), F.lit(""))))
    hit = matches(shards(named.select("_t", "_body"), window, "_t", "_body"), benchmark, window).select(F.col("key").alias("_t")).distinct()
    return common.restored(named.join(hit, "_t", "left_anti"), docs, key, text)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
