"""Spelling variants by rolling-hash deletions.

1. Each task takes its texts' runs of Latin letters, spells some wrong on purpose where a slip is asked for
   (see `counted`), and counts words; counts are summed over the cluster.
2. Words two of which differ by one code point share a deletion: replacing at place i leaves the same
   rest without i, and inserting leaves the shorter word. A word's code points become 64-bit values of
   a polynomial; from its prefix and suffix sums NumPy has the value of every deletion at once, without
   building a string. Keys are that value with the place (for replacements) or alone (for insertions).
3. Keys are dealt by their leading bits and sorted; a task streams over them and passes on only
   those that two words share, or a word and a deletion.
4. Their strings are looked up by the word's number and rests are grouped by the strings themselves, so a
   collision of keys joins nothing. At a place, a rest is shared by words with different letters
   there, so a group is no larger than the alphabet (times the length, for insertions). Each member gets
   the group's size and its best other member from the group's own sums: no pairs are made.
5. A word's form is its near word of largest count if that is FACTOR times its own; forms are
   followed by doubling. Counts grow by the factor with each step, so the rounds are few.

Nulls and edges: a null text has no words; a null id is spelled as nothing before the colon. Rows that repeat
count again. Of very long runs every deletion is a key, but strings travel only with shared keys.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silthouse.llm import common

SLIP = 199
MIN_LENGTH = 6
MIN_COUNT = 5
FACTOR = 5
SLICE_BYTES = 1 << 20
KEY_BYTES = 1 << 18
#: Words that a task counts before it passes its counts on.
HELD = 300_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: What a key stands for: a rest and its place, a rest, a whole word.
REPLACED, SHORTER, WHOLE = 0, 1, 2


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = SLIP) -> DataFrame:
    """word, n. A run whose crc32 of `<id>:<run>`, ASCII lower-cased, is a multiple of `slip` loses a code point."""

    def count(batches):
        held: Counter[str] = Counter()
        for batch in common.slices(batches, "_body", SLICE_BYTES):
            for own, body in zip(batch.column("_id").to_pylist(), common.strings(batch.column("_body"))):
                for run, n in Counter(_RUN.findall(body.lower().decode())).items():
                    h = crc32(f"{own}:{run}".encode())
                    if h % slip == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) >= MIN_LENGTH:
                        held[run] += n
            if len(held) > HELD:
                yield _counts(held)
                held = Counter()
        yield _counts(held)

    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("_id"), F.col(f"`{text}`").alias("_body"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value, scrambled one to one."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def deletion_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of equal length as rows of code points: the value of each deletion and of each whole word, and which
    deletions are the first of those that leave the same rest (letters that repeat next to each other)."""
    m, n = codes.shape
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))[:n]
    terms = _mixed(codes.astype(np.uint64) + np.uint64(1)) * power
    prefix = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(terms, axis=1)], axis=1)
    suffix = prefix[:, -1:] - prefix[:, 1:]
    first = np.concatenate([np.ones((m, 1), bool), codes[:, 1:] != codes[:, :-1]], axis=1)
    return prefix[:, :-1] + suffix * _BACK, prefix[:, -1], first


def keyed(words: DataFrame) -> DataFrame:
    """key, id, at, kind: 2 keys for each letter of each word of words (id, word), and one for the word."""

    def emit(batches):
        for batch in common.slices(batches, "word", KEY_BYTES):
            ids, texts = batch.column("id").to_numpy(), batch.column("word").to_pylist()
            sizes = np.array(list(map(len, texts)), np.int64)
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            starts = np.cumsum(sizes) - sizes
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                rest, whole, first = deletion_keys(codes[starts[own][:, None] + np.arange(n)])
                at = np.broadcast_to(np.arange(n, dtype=np.int32), rest.shape)
                of = np.broadcast_to(ids[own][:, None], rest.shape)
                placed = _mixed(rest + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
                for kind, key, i, a in ((REPLACED, placed.ravel(), of.ravel(), at.ravel()), (SHORTER, _mixed(rest[first]), of[first], at[first]), (WHOLE, _mixed(whole), ids[own], np.zeros(len(own), np.int32))):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(i), pa.array(a, pa.int32()), pa.array(np.full(len(i), kind, np.int8))], names=["key", "id", "at", "kind"])

    return words.select("id", "word").mapInArrow(emit, "key long, id long, at int, kind byte")


def shared(keys: DataFrame) -> DataFrame:
    """id, at, kind of the keys that are worth a look: two rests at one place, or a rest and the word that it is."""
    n = common.partitions(keys.sparkSession)
    dealt = keys.repartition(n, F.shiftright("key", 40)).sortWithinPartitions("key")

    def keep(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([rest, batch] if rest is not None else [batch]).combine_chunks().to_batches()[0]
            key = rows.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last run may go on
            rest = rows.slice(last)
            if last:
                yield _worth(rows.slice(0, last))
        if rest is not None:
            yield _worth(rest)

    return dealt.mapInArrow(keep, "id long, at int, kind byte")


def _worth(rows: pa.RecordBatch) -> pa.RecordBatch:
    key, kind = rows.column("key").to_numpy(), rows.column("kind").to_numpy()
    run = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    kinds = np.stack([np.bincount(run, kind == k) for k in (REPLACED, SHORTER, WHOLE)])
    good = (kinds[REPLACED] > 1) | (kinds[SHORTER] > 0) & (kinds[WHOLE] > 0)
    return rows.filter(pa.array(good[run])).select(["id", "at", "kind"])


def near(words: DataFrame) -> DataFrame:
    """id, n_near and best (-n, word) of each of words (id, word, n) that has a near word."""
    rest = F.when(F.col("kind") == WHOLE, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)")))
    slot = F.when(F.col("kind") == REPLACED, F.col("at")).otherwise(-1)
    rows = shared(keyed(words)).join(words, "id").select("id", "kind", slot.alias("slot"), rest.alias("rest"), F.struct((-F.col("n")).alias("n"), "word").alias("own"))
    group = Window.partitionBy("slot", "rest")
    ranked = group.orderBy("own")
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    rows = rows.withColumns({"_first": F.first("own").over(ranked), "_second": F.lead("own").over(ranked), "_whole": F.max(of(WHOLE, F.col("own"))).over(group), "_longer": F.min(of(SHORTER, F.col("own"))).over(group), "_n": F.count(of(SHORTER, F.lit(1))).over(group), "_all": F.count(F.lit(1)).over(group)})
    other = F.when(F.col("own") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    best = of(REPLACED, other).when(F.col("kind") == SHORTER, F.col("_whole")).otherwise(F.col("_longer"))
    links = of(REPLACED, F.col("_all") - 1).when(F.col("kind") == SHORTER, F.col("_whole").isNotNull().cast("long")).otherwise(F.col("_n"))
    return rows.groupBy("id").agg(F.sum(links).alias("n_near"), F.min(best).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to their ends, by doubling."""
    state = common.written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        state = common.written(state.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "forms")
        if state.filter("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_COUNT, factor: int = FACTOR, slip: int = SLIP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of MIN_LENGTH letters that occurs `least` times."""
    words = common.written(counted(docs, key, text, slip).filter(F.col("n") >= least).withColumn("id", F.monotonically_increasing_id()), "words")
    form = F.col("best.n") * -1 >= F.col("n") * factor
    found = words.join(near(words), "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n"))
    found = common.written(found, "near")
    return found.join(roots(found.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE
tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (
  SELECT d, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  GROUP BY ALL),
hexed AS (SELECT d, run, n, hex(encode(d || ':' || run)) AS x FROM runs),
crc AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
         lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM hexed, tab),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM crc)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min((-n, encode(other))) AS b FROM pairs GROUP BY word),
forms AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 5 * w.n THEN decode(b[2]) END AS form, CASE WHEN -b[1] >= 5 * w.n THEN -b[1] END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word) r USING (word)
"""
