"""Quality classification by co-training two views of a document.

The content view has the words of the whole text (hashed) and binned statistics of it; the
metadata view has the other columns of the page. Each is a logistic regression.

1. Features of every document are written once.
2. At most LABELLED labelled documents, chosen by a hash of the id, go to the driver, in three parts: three fifths
   fit the views, a fifth calibrates them and their combination, a fifth sets the threshold.
3. In each of ROUNDS rounds both views score every other document, each in its own task. What a view is sure of
   (CONFIDENT by its own calibration) is a pseudo-label for the other view. Labels are exchanged as
   counts: in how many documents of each class a feature is. They are partial sums, so every
   document counts and only one row for each feature reaches the driver.
4. A view is then fitted again with one more feature, the sum of the log-odds of its features in these counts.
5. The combination of both views' calibrated scores gives the probability that a document is good: of good quality
   and not toxic. A document is kept from probability THRESHOLD on, or from the lower one, not below FLOOR, that costs
   no more than LOST of the good documents of the last fifth. Every document is scored, over its whole text.

A word may only speak against a document: fitted freely, a long text makes up for anything by its many ordinary
words, and a short good one has too few of them.

Nulls and edges: a null text is empty; a null in a metadata column is a value of its own; a null
quality is no label, a null toxic is not toxic; a null id is scored but never fitted on.
Repeated rows are scored alike. Without labels of both classes in each part every document scores 0.5 and is
kept. Columns other than those named are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silthouse.llm import common

LABELLED = 8000
ROUNDS = 3
CONFIDENT = 0.98
THRESHOLD = 0.5
METADATA = ("lang", "source", "n_chars")
SLICE_BYTES = 1 << 20
WORDS = 1 << 17
BINS = 16
#: A feature counts if its classes differ by so many standard errors.
MIN_Z = 3.5
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_SIGNS = np.zeros(256, bool)
_SIGNS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"()-/@"]] = True
STEM_BYTES = 6
N_STATS = 9
#: Documents of the good class that the threshold may cost, of those held back.
LOST = 0.005
#: The threshold is never lower.
FLOOR = 0.3


def _bin(x: float, top: float) -> int:
    return min(int(x / top * BINS), BINS - 1)


def content(text: bytes) -> list[int]:
    """Feature numbers of a text: its words and their stems, then a bin of each statistic."""
    words = _WORD.findall(text.lower())
    known = set(words)
    stems = {w[:STEM_BYTES] for w in known if len(w) > STEM_BYTES}
    data = np.frombuffer(text, np.uint8)
    n, size = max(len(words), 1), max(len(text), 1)
    counts = np.bincount(data, minlength=256)
    stats = (
        _bin(int(counts[_SIGNS].sum()) / n, 1.6),
        _bin(len(known) / n, 1),
        _bin(sum(map(bytes.__eq__, words, words[1:])) / n, 0.64),
        _bin(sum(map(len, words)) / n, 16),
        _bin(int(counts[10]) / n, 0.32),
        _bin(int(counts[48:58].sum()) / size, 0.32),
        _bin(int(counts[33:].max(initial=0)) / size, 0.32),
        _bin(np.log2(n), 16),
        _bin(int(counts[65:91].sum()) / size, 0.32),
    )
    return [zlib.crc32(w) & (WORDS - 1) for w in known] + [zlib.crc32(w, 1) & (WORDS - 1) for w in stems] + [WORDS + BINS * k + b for k, b in enumerate(stats)]


def metadata(row: tuple) -> list[int]:
    """Feature numbers of the other columns: each value, numbers by their logarithm, and lengths of strings."""
    out = []
    for k, x in enumerate(row):
        x = int(np.log2(abs(x) + 1) * 2) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
        out.append(zlib.crc32(f"{k}={x!r}".encode()) & (WORDS - 1))
    return out


class Rows:
    """Feature numbers of several documents, end to end."""

    def __init__(self, numbers: np.ndarray, at: np.ndarray):
        self.numbers, self.at = numbers, at
        self.sizes = np.diff(at)

    @classmethod
    def of(cls, lists: list[list[int]]) -> Rows:
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return cls(np.array([i for x in lists for i in x], np.int64), at)

    def take(self, where: np.ndarray) -> Rows:
        sizes = self.sizes[where]
        at = np.concatenate([[0], np.cumsum(sizes)])
        return Rows(self.numbers[np.arange(at[-1]) - np.repeat(at[:-1] - self.at[where], sizes)], at)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(weights[self.numbers])])
        return total[self.at[1:]] - total[self.at[:-1]]


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_odds(counts: np.ndarray, sizes: np.ndarray, against: int = 0) -> np.ndarray:
    """What each feature tells, from the documents of either class (bad, good) that have it; 0 where they don't differ.

    The first `against` features may only speak against a document.
    """
    seen, total = counts.sum(axis=0), max(sizes.sum(), 1)
    share = sizes[1] / total
    z = (counts[1] - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    odds = np.log((counts[1] + 1) / (sizes[1] + 2)) - np.log((counts[0] + 1) / (sizes[0] + 2))
    odds[(np.abs(z) <= MIN_Z) | (min(sizes) == 0)] = 0
    odds[:against] = np.minimum(odds[:against], 0)
    return odds


def fit(x: Rows, y: np.ndarray, size: int, against: int = 0, told: np.ndarray | None = None, steps: int = 200, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression over the features whose classes differ; the last is the constant.

    The first `against` features may only speak against a document. `told` are the log-odds
    of all features in the other view's labels; their sum is one more feature, never a negative one.
    """
    told = np.zeros(size) if told is None else told
    sums = x.sums(told)
    spread = sums.std()
    told, sums = (told / spread, sums / spread) if spread > 0 else (np.zeros(size), np.zeros(len(y)))
    trust, trusted = 0.0, 1e-8
    good = np.bincount(x.numbers, np.repeat(y, x.sizes), size)
    seen = np.bincount(x.numbers, minlength=size)
    share = y.mean()
    z = (good - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    used = np.abs(z) > MIN_Z
    used[:against] &= z[:against] < 0
    kept = used[x.numbers]
    own = Rows(x.numbers[kept], np.concatenate([[0], np.cumsum(kept)])[x.at])
    w, pace = np.zeros(size + 1), np.full(size + 1, 1e-8)
    w[-1] = np.log(share / (1 - share))
    for _ in range(steps):
        miss = _squash(own.sums(w) + trust * sums + w[-1]) - y
        step = np.append(np.bincount(own.numbers, np.repeat(miss, own.sizes), size), miss.sum()) / len(y) + ridge * w
        step[:-1][~used] = 0
        pace += step**2
        w -= 0.5 * step / np.sqrt(pace)
        w[:against] = np.minimum(w[:against], 0)
        pull = (miss * sums).mean() + ridge * trust
        trusted += pull**2
        trust = max(trust - 0.5 * pull / np.sqrt(trusted), 0.0)
    w[:-1] += trust * told
    return w


def scale(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of each column of scores and a constant, by Newton's method on smoothed labels."""
    x = np.column_stack([scores, np.ones(len(y))])
    up, down = y.sum(), len(y) - y.sum()
    soft = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _squash(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - soft) + 1e-3 * w)
    return w


#: Features of each view, and how many of them may only speak against a document.
SIZES = ((WORDS + BINS * N_STATS, WORDS), (WORDS, 0))


def co_train(views: list[Rows], y: np.ndarray, exchange: Callable, rounds: int = ROUNDS) -> tuple[list[np.ndarray], np.ndarray, float] | None:
    """Weights of both views and of their combination, and the least probability of a document that is kept.

    views: the labelled documents, in the order of a hash; y: 1 good, 0 not. exchange(weights, scales)
    gives, for each view, the counts of features and the documents of either class by the other view's labels.
    """
    part = np.arange(len(y)) % 5
    held, last, train = np.flatnonzero(part == 0), np.flatnonzero(part == 1), np.flatnonzero(part > 1)
    if any(len({*y[x]}) < 2 for x in (held, last, train)):
        return None
    told: list[np.ndarray | None] = [None, None]
    for r in range(rounds + 1):
        weights = [fit(v.take(train), y[train].astype(float), size, against, t) for v, (size, against), t in zip(views, SIZES, told, strict=True)]
        if r < rounds:
            scales = [scale(v.take(held).sums(w)[:, None] + w[-1], y[held]) for v, w in zip(views, weights, strict=True)]
            told = [log_odds(counts, sizes, against) for (counts, sizes), (_, against) in zip(exchange(weights, scales), SIZES, strict=True)]

    def both(where: np.ndarray) -> np.ndarray:
        return np.column_stack([v.take(where).sums(w) + w[-1] for v, w in zip(views, weights, strict=True)])

    mix = scale(both(held), y[held])
    good = _squash(np.column_stack([both(last), np.ones(len(last))]) @ mix)[y[last] > 0]
    return weights, mix, min(THRESHOLD, max(FLOOR, float(np.quantile(good, LOST))))


def pseudo_labels(views: list[Rows], weights: list[np.ndarray], scales: list[np.ndarray]) -> list[np.ndarray]:
    """For each view, what the other one is sure of: 1 good, 0 not, -1 unsure."""
    out = []
    for v, w, (slope, constant) in zip(views, weights, scales, strict=True):
        p = _squash(slope * (v.sums(w) + w[-1]) + constant)
        out.append(np.where(np.maximum(p, 1 - p) >= CONFIDENT, (p > 0.5).astype(np.int64), -1))
    return out[::-1]


def _features(batch: pa.RecordBatch, text: str, columns: tuple[str, ...]) -> list[Rows]:
    other = [batch.column(c).to_pylist() for c in columns]
    rows = list(zip(*other, strict=True)) if columns else [()] * batch.num_rows
    return [Rows.of([content(t) for t in common.strings(batch.column(text))]), Rows.of([metadata(r) for r in rows])]


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = METADATA) -> DataFrame:
    """Written: _key and the feature numbers of both views, a and b, of every document."""

    def emit(batches):
        for batch in common.slices(batches, "_body", SLICE_BYTES):
            lists = [pa.ListArray.from_arrays(pa.array(x.at, pa.int32()), pa.array(x.numbers, pa.int32())) for x in _features(batch, "_body", names)]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *lists], names=["_key", "a", "b"])

    names = tuple(f"_c{k}" for k in range(len(columns)))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_body"), *(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)))
    return common.written(rows.mapInArrow(emit, f"_key {docs.schema[key].dataType.simpleString()}, a array<int>, b array<int>"), "features", compression="zstd")


def _rows(table: pa.Table | pa.RecordBatch) -> list[Rows]:
    out = []
    for c in ("a", "b"):
        lists = table.column(c)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        out.append(Rows(lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])))
    return out


def train(features: DataFrame, labels: DataFrame, key: str = "doc_id", labelled: int = LABELLED):
    """The fitted model, or None where the labels have one class only. features: of featured()."""
    spark = features.sparkSession
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    known = labels.filter("quality is not null").groupBy(F.col(key).alias("_key")).agg(F.min(good).alias("_y"))
    ids = features.select("_key").filter("_key is not null").distinct().join(known, "_key")
    # at most `labelled` rows
    chosen = common.written(ids.orderBy(F.xxhash64("_key"), "_key").limit(labelled).withColumn("_order", F.xxhash64("_key")), "labelled")
    # of rows that repeat a labelled id, one is used, so that the bound is one of rows
    own = features.join(F.broadcast(chosen), "_key").select("_key", F.struct("_order", "_y", "a", "b").alias("_row"), F.xxhash64("a", "b").alias("_h"))
    table = own.groupBy("_key").agg(F.min_by("_row", "_h").alias("_row")).select("_row.*").toArrow()
    table = table.take(pc.sort_indices(table, [("_order", "ascending")])) if len(table) else table
    others = features.filter("_key is not null").join(F.broadcast(chosen.select("_key")), "_key", "left_anti").select("a", "b")

    def exchange(weights, scales):
        sent = spark.sparkContext.broadcast((weights, scales))

        def count(batches):
            totals = [np.zeros((2, size + 1), np.int64) for size, _ in SIZES]
            for batch in batches:
                views = _rows(batch)
                for total, view, own in zip(totals, views, pseudo_labels(views, *sent.value), strict=True):
                    each = np.repeat(own, view.sizes)
                    for c in (0, 1):
                        total[c] += np.bincount(view.numbers[each == c], minlength=total.shape[1])
                        total[c, -1] += (own == c).sum()
            for k, total in enumerate(totals):
                at = np.flatnonzero(total.any(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])], names=["view", "feature", "bad", "good"])

        summed = others.mapInArrow(count, "view int, feature int, bad long, good long").groupBy("view", "feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
        sent.destroy()
        view, feature, bad, good = (summed.column(c).to_numpy() for c in ("view", "feature", "bad", "good"))
        out = []
        for k, (size, _) in enumerate(SIZES):
            total = np.zeros((2, size + 1), np.int64)
            total[:, feature[view == k]] = bad[view == k], good[view == k]
            out.append((total[:, :-1], total[:, -1]))
        return out

    y = table.column("_y").to_numpy().astype(np.int64)
    views = _rows(table)
    del table
    model = co_train(views, y, exchange)
    del views
    common.trim()  # the driver goes on to other stages
    return model


def _probability(views: list[Rows], n: int, model) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Scores of both views, probability, and whether to keep, for each row."""
    if model is None:
        return [np.zeros(n)] * 2, np.full(n, 0.5), np.ones(n, bool)
    weights, mix, least = model
    scores = [v.sums(w) + w[-1] for v, w in zip(views, weights, strict=True)]
    p = _squash(np.column_stack([*scores, np.ones(n)]) @ mix)
    return scores, p, p >= least


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = METADATA) -> DataFrame:
    """One row per document: key, both views' scores, probability, keep."""
    features = featured(docs, key, text, columns)
    model = docs.sparkSession.sparkContext.broadcast(train(features, labels, key))

    def judge(batches):
        for batch in batches:
            (a, b), p, keep = _probability(_rows(batch), batch.num_rows, model.value)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(a), pa.array(b), pa.array(p), pa.array(keep)], names=[key, "content_score", "metadata_score", "probability", "keep"])

    return features.mapInArrow(judge, f"`{key}` {docs.schema[key].dataType.simpleString()}, content_score double, metadata_score double, probability double, keep boolean")


def good_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = METADATA) -> DataFrame:
    """The documents that are good by the classifier; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(featured(docs, key, text, columns), labels, key))
    rows = common.set_aside(docs, key, text).withColumns({f"_c{k}": F.col("_id" if c == key else f"_rest.`{c}`") for k, c in enumerate(columns)})
    names = tuple(f"_c{k}" for k in range(len(columns)))

    def judge(batches):
        for batch in common.slices(batches, "_body", SLICE_BYTES):
            yield batch.filter(pa.array(_probability(_features(batch, "_body", names), batch.num_rows, model.value)[2]))

    return common.restored(rows.mapInArrow(judge, rows.schema), docs, key, text)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
