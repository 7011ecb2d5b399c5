"""Line dedup by prefix doubling over line-ID sequences; DataFrame functions only.

A document is a sequence of lines. A run of consecutive lines of MIN_CHARS characters or more
(each line counts its newline) that occurs at an earlier place, in this document or another, is
a later copy, and all its lines go. Documents are ordered by id (null ids last, ties by text).

1. Equal texts are collapsed to their first document; the other copies are later copies whole.
2. Only lines that occur at least twice can be in a repeated run. They get order-preserving
   numbers: distinct lines are sorted over ranges, and their place is their number.
3. Prefix doubling: numbers of 2**k lines are the places of the distinct, repeated pairs of
   numbers of 2**(k-1) lines. They rank the suffixes by their first 2**k lines; a window that
   occurs once drops out. Levels end with the longest window that step 4 needs, at most
   log2(MIN_CHARS) whatever the input.
4. Suffixes whose common prefix has MIN_CHARS characters or more are an interval of the suffix
   array; the shortest such prefix of a suffix is a window of some l lines, and two overlapping
   numbers of 2**k <= l lines name the interval. The same with the shortest windows that end at
   each line. The union of these windows is that of all repeated runs long enough: a maximal
   run contains the windows from its lines, or to them, and they cover it.
5. Of each interval the first place stays; the others' lines are cut, merged for each text.

Counts are partial sums before any shuffle and the large side of each join is one that Spark may
split, so a line or text with a third of all rows is no single task's. Windows run inside one
document. Ranks are written before use, as places must not change on a second evaluation.

Nulls and edges: a null text is empty, one line without characters; rows that repeat id and text
are one document and share its fate; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silthouse.llm import common

MIN_CHARS = 200
_TEXT = ["_t1", "_t2"]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("_t1", F.xxhash64(body)).withColumn("_t2", F.xxhash64(F.lit("text"), body))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _places(pairs: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct rows with their place in sorted order; places rise with the order, with gaps."""
    n = common.partitions(pairs.sparkSession)
    ordered = pairs.select(*columns).repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    return common.written(ordered.withColumn(name, F.monotonically_increasing_id()), "places")


def ranked(texts: DataFrame) -> DataFrame:
    """_t1, _t2, key, pos, n, r0 of every line that occurs at least twice. texts: _t1, _t2, key, lines (h1, h2, n)."""
    lines = texts.select(*_TEXT, "_key", F.posexplode("lines").alias("pos", "line")).select(*_TEXT, "_key", "pos", "line.*")
    twice = lines.groupBy("h1", "h2").count().filter("count > 1")
    return common.written(lines.join(_places(twice, ["h1", "h2"], "r0"), ["h1", "h2"]).drop("h1", "h2"), "ranked")


def windows(rows: DataFrame, least: int) -> DataFrame:
    """The rows with `island` (of lines without a gap) and the shortest windows of `least` characters:
    `ahead`, the lines of the one that starts here, and `back`, of the one that ends here; null without one."""
    in_text = Window.partitionBy(*_TEXT).orderBy("pos")
    own = Window.partitionBy(*_TEXT, "island")
    rows = rows.withColumn("island", F.col("pos") - F.row_number().over(in_text))
    rows = rows.withColumn("after", F.sum("n").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("after") - F.col("n"))
    rows = rows.withColumn("total", F.sum("n").over(own)).withColumn("first", F.min("pos").over(own)).withColumn("end", F.max("pos").over(own) + 1)
    stop = F.last("pos").over(own.orderBy(F.col("before").desc()).rangeBetween(Window.unboundedPreceding, -least))
    stop = F.coalesce(stop, F.when(F.col("total") - F.col("before") >= least, F.col("end")))
    start = F.last("pos").over(own.orderBy("after").rangeBetween(Window.unboundedPreceding, -least)) + 1
    start = F.coalesce(start, F.when(F.col("after") >= least, F.col("first")))
    return rows.withColumn("ahead", stop - F.col("pos")).withColumn("back", F.col("pos") + 1 - start).drop("after", "before", "total", "first", "end")


def doubled(rows: DataFrame, levels: int) -> DataFrame:
    """The rows with r1 .. r(levels): the rank of the 2**k lines from here, null where they occur once or there are fewer."""
    own = Window.partitionBy(*_TEXT, "island").orderBy("pos")
    for k in range(1, levels + 1):
        paired = rows.withColumn("_b", F.lead(f"r{k - 1}", 1 << (k - 1)).over(own))
        pairs = paired.filter(f"r{k - 1} is not null and _b is not null").groupBy(f"r{k - 1}", "_b").count().filter("count > 1")
        rows = common.written(paired.join(_places(pairs, [f"r{k - 1}", "_b"], f"r{k}"), [f"r{k - 1}", "_b"], "left").drop("_b"), "doubled")
    return rows


def later_copies(rows: DataFrame, levels: int) -> DataFrame:
    """_t1, _t2, start, stop of every window that has an earlier copy."""
    ranks = F.array(*(F.col(f"r{k}") for k in range(levels + 1)))
    sides = [
        rows.filter("ahead is not null").select(F.lit(0).alias("side"), *_TEXT, "_key", F.col("pos").alias("start"), F.col("ahead").alias("l")),
        rows.filter("back is not null").select(F.lit(1).alias("side"), *_TEXT, "_key", (F.col("pos") + 1 - F.col("back")).alias("start"), F.col("back").alias("l")),
    ]
    found = sides[0].unionByName(sides[1]).withColumn("k", F.floor(F.log2("l")).cast("int"))
    found = found.withColumn("pos", F.explode(F.array("start", (F.col("start") + F.col("l") - F.call_function("shiftleft", F.lit(1), F.col("k"))).cast("int"))))
    named = found.join(rows.select(*_TEXT, "pos", ranks.alias("ranks")), [*_TEXT, "pos"]).withColumn("rank", F.element_at("ranks", F.col("k") + 1)).filter("rank is not null")
    # the window's first and last 2**k lines, which are the same rows where l is 2**k
    both = named.groupBy("side", *_TEXT, "_key", "start", "l").agg(F.min_by("rank", "pos").alias("a"), F.max_by("rank", "pos").alias("b"), F.count(F.lit(1)).alias("c")).filter("c = 2").drop("c")
    both = common.written(both, "intervals")
    place = F.struct(F.col("_key").isNull(), F.col("_key"), F.col("_t1"), F.col("_t2"), F.col("start"))
    first = both.groupBy("side", "l", "a", "b").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    return both.join(first, ["side", "l", "a", "b"]).filter(place > F.col("_first")).select(*_TEXT, "start", (F.col("start") + F.col("l")).alias("stop"))


def merged(ranges: DataFrame) -> DataFrame:
    """_t1, _t2, cuts: the ranges of each text, merged and sorted."""
    own = Window.partitionBy(*_TEXT).orderBy("start", "stop")
    fresh = F.coalesce(F.col("start") > F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    grouped = ranges.distinct().withColumn("_new", fresh.cast("int")).withColumn("_group", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = grouped.groupBy(*_TEXT, "_group").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy(*_TEXT).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))


def _kept(lines: Column, cuts: Column) -> Column:
    """What is left of the lines beside the cuts, in linear time."""

    def between(i: Column) -> Column:
        start = F.when(i > 0, F.element_at(cuts, i)["stop"]).otherwise(0)
        stop = F.when(i < F.size(cuts), F.try_element_at(cuts, i + 1)["start"]).otherwise(F.size(lines))
        return F.slice(lines, start + 1, stop - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts)), between)), "\n")


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """The documents with _lines, _cuts (merged line ranges that go) and _kept, the text that is left."""
    named = _keyed(docs, text)
    each = F.transform(_lines(F.col(text)), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"), (F.length(x) + 1).cast("long").alias("n")))
    texts = common.written(named.select(*_TEXT, F.col(key).alias("_key"), each.alias("lines")).groupBy(*_TEXT).agg(F.min("_key").alias("_key"), F.first("lines").alias("lines")), "texts")
    rows = common.written(windows(ranked(texts), least), "windows")
    longest = rows.agg(F.max(F.greatest("ahead", "back"))).first()[0]
    none = "array<struct<start:int,stop:int>>"
    if longest is None:
        firsts = texts.select(*_TEXT, "_key", F.lit(None).cast(none).alias("cuts"))
    else:
        levels = int(longest).bit_length() - 1
        firsts = texts.select(*_TEXT, "_key").join(merged(later_copies(doubled(rows, levels), levels)), _TEXT, "left")
    own = named.join(firsts.withColumnRenamed("_key", "_first"), _TEXT)
    lines = _lines(F.col(text))
    whole = ~F.col(key).eqNullSafe(F.col("_first")) & (F.length(F.coalesce(F.col(text), F.lit(""))) + 1 >= least)
    cuts = F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.size(lines).alias("stop")))).otherwise(F.coalesce("cuts", F.array().cast(none)))
    own = own.withColumn("_cuts", cuts).withColumn("_kept", F.when(F.size("_cuts") == 0, F.col(text)).otherwise(_kept(lines, F.col("_cuts"))))
    return own.withColumn("_lines", F.size(lines)).drop(*_TEXT, "_first", "cuts")


def _removed() -> Column:
    return F.aggregate("_cuts", F.lit(0), lambda n, c: n + c["stop"] - c["start"])


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """One row per document: key, n_lines, n_removed, n_runs (maximal runs of removed lines), kept_sha256."""
    return cut(docs.select(key, text), key, text, least).select(
        key, F.col("_lines").cast("long").alias("n_lines"), _removed().cast("long").alias("n_removed"), F.size("_cuts").cast("long").alias("n_runs"), F.sha2(F.encode(F.coalesce("_kept", F.lit("")), "utf-8"), 256).alias("kept_sha256")
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """The documents without later copies of line runs; those that lose all their lines go. All columns stay."""
    kept = cut(common.set_aside(docs, key, text), "_id", "_body", least).filter(_removed() < F.col("_lines"))
    return common.restored(kept, docs, key, text, F.col("_kept"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.read(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM d),
c AS (SELECT doc_id, ls, pos, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS after,
             sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS before FROM l),
w AS (
  SELECT 0 AS side, a.doc_id, a.pos AS start, min(b.pos) + 1 AS stop
  FROM c a ASOF JOIN (SELECT doc_id, pos, after FROM c) b ON a.doc_id = b.doc_id AND a.before + 200 <= b.after GROUP BY ALL
  UNION ALL
  SELECT 1 AS side, a.doc_id, max(b.pos) AS start, a.pos + 1 AS stop
  FROM c a ASOF JOIN (SELECT doc_id, pos, before FROM c) b ON a.doc_id = b.doc_id AND a.after - 200 >= b.before GROUP BY a.doc_id, a.pos),
t AS (SELECT side, w.doc_id, start, stop, array_to_string(list_slice(ls, start + 1, stop), chr(10)) AS body FROM w JOIN d USING (doc_id)),
f AS (SELECT side, md5(body) AS body, min((doc_id, start)) AS first FROM t GROUP BY ALL),
r AS (SELECT DISTINCT doc_id, unnest(range(start, stop)) AS pos FROM t JOIN f ON t.side = f.side AND md5(t.body) = f.body WHERE (doc_id, start) > first),
k AS (SELECT l.doc_id, l.pos, l.line, r.pos IS NOT NULL AS gone FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.pos = r.pos),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""
