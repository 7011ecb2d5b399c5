"""Document fingerprints from closed syncmers; DataFrame functions only.

1. A text is a sequence of pieces: each run of non-blanks, cut from its start on into pieces of PIECE code points.
2. A k-mer of K pieces is an anchor if the least hash of its S-piece substrings is that of its first or its last: a
   closed syncmer. That depends on the k-mer alone, so equal passages have equal anchors wherever they stand, and
   any K - S + 1 k-mers in a row hold one. The least hash of all windows comes from doubled window lengths.
3. An item of the fingerprint is an anchor's hash with the distance to the next anchor: anchors match where they stand
   equally far apart. The fingerprint has the SKETCH least items (all of a short text), in hex.
4. The likeness of two fingerprints is 2j / (1 + j), the part of their items in common, with j the share of common items among
   the SKETCH least of both.

`successors` gives each document the text after it: rows are dealt to ranges of (key, hash of the text), one shuffle of the
texts; the first row of each range goes to the range before, too (of the first range: to the last one).
An edited text keeps the anchors of what it keeps: only k-mers that reach into its new tail are looked at.

Nulls and edges: a null text is empty; a text without pieces has the empty fingerprint, which is like
itself (1) and like no other (0). Without any anchor, all pieces together are one. Null ids come first; rows with the
same id follow each other by a hash of their texts. A single document is its own successor. Other columns
may have any names and are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silthouse.llm import common

PIECE = 8
K, S = 5, 2
SKETCH = 128
_WINDOW = K - S + 1  # a power of two


def piece_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rf"\S{{1,{PIECE}}}"), F.lit(0)), lambda x: F.xxhash64(x))


def _from(array: str, n: int) -> Column:
    return F.slice(F.col(array), F.lit(n + 1), F.greatest(F.size(array) - n, F.lit(0)))


def with_anchors(rows: DataFrame, pieces: str, name: str) -> DataFrame:
    """The rows with `name`: array of (at, hash), the closed syncmers among the piece hashes in column `pieces`, in order.

    Arrays go on to the last piece; what they hold where a k-mer doesn't fit any more is never looked at.
    """
    rows = rows.withColumn("_s", F.zip_with(pieces, _from(pieces, 1), lambda a, b: F.xxhash64(a, b)))  # of S pieces
    rows = rows.withColumn("_m", F.zip_with("_s", _from("_s", 1), lambda a, b: F.least(a, b)))
    width = 2
    while width < _WINDOW:
        rows = rows.withColumn("_m", F.zip_with("_m", _from("_m", width), lambda a, b: F.least(a, b)))
        width *= 2
    rows = rows.withColumn("_m", F.slice("_m", F.lit(1), F.greatest(F.size(pieces) - (K - 1), F.lit(0))))
    edge = lambda m, i: (m == F.get("_s", i)) | (m == F.get("_s", i + (K - S)))
    # the k-mer's hash: that of the S-piece substrings that cover it
    tile = lambda i: F.xxhash64(*(F.get("_s", i + d) for d in [*range(0, K - S, S), K - S]))
    found = F.transform("_m", lambda m, i: F.when(edge(m, i), F.struct(i.alias("at"), tile(i).alias("hash"))))
    return rows.withColumn(name, F.filter(found, lambda x: x.isNotNull())).drop("_s", "_m")


def _sketch(anchors: str, pieces: Column) -> Column:
    """The least items of a fingerprint; all pieces at once where there is no anchor."""
    after = F.slice(F.col(anchors), F.lit(2), F.size(anchors))
    items = F.zip_with(anchors, after, lambda a, b: F.shiftrightunsigned(F.xxhash64(a["hash"], F.coalesce(b["at"] - a["at"], F.lit(0)).cast("long")), 32))
    whole = F.when(F.size(pieces) > 0, F.array(F.shiftrightunsigned(F.xxhash64(pieces), 32))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(anchors) > 0, F.slice(F.sort_array(F.array_distinct(items)), 1, SKETCH)).otherwise(whole)


def likeness(a: Column, b: Column) -> Column:
    """The part of two sketches' items in common, 0 to 1; 1 for two empty ones."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    j = F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.greatest(F.size(both), F.lit(1))
    return F.when(F.size(both) == 0, 1.0).otherwise(2 * j / (1 + j))


def hexed(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def fingerprinted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with `_sketch`, the items of each text's fingerprint."""
    rows = docs.withColumn("_pieces", piece_hashes(F.coalesce(F.col(text), F.lit(""))))
    return with_anchors(rows, "_pieces", "_anchors").withColumn("_sketch", _sketch("_anchors", F.col("_pieces"))).drop("_pieces", "_anchors")


def successors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Window]:
    """_id, _text of all documents in ranges, and of each range's end the row after it (with _guest); and the window whose
    lead() is the next document."""
    n = 2 * common.partitions(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("_id"), body.alias("_text"), F.struct(F.col(f"`{key}`").alias("id"), F.xxhash64(body).alias("h")).alias("_place"))
    firsts = rows.select("_place").repartitionByRange(n, "_place").groupBy(F.spark_partition_id().alias("range")).agg(F.min("_place").alias("first")).orderBy("range").collect()
    kind = docs.schema[key].dataType
    bounds = F.array(*(F.struct(F.when(F.lit(True), F.lit(r.first.id).cast(kind)).alias("id"), F.lit(r.first.h).cast("long").alias("h")) for r in firsts)) if firsts else F.array(F.struct(F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("h")))
    steps = [1 << b for b in reversed(range(len(firsts).bit_length()))]
    rows, found = rows.withColumn("_b", bounds).withColumn("_range", F.lit(0)), F.col("_range")
    for step in steps:  # the number of bounds at or below the row, bit by bit
        more = (found + step <= len(firsts)) & (F.get("_b", found + (step - 1)) <= F.col("_place"))
        rows = rows.withColumn("_range", found + F.when(more, step).otherwise(0))
    opens = F.get("_b", F.col("_range") - 1) == F.col("_place")
    before = F.when(F.col("_range") > 1, F.col("_range") - 1).otherwise(len(firsts))
    rows = rows.withColumn("_to", F.explode(F.when(opens, F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("g")), F.struct(before.alias("r"), F.lit(True).alias("g")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("g"))))))
    return rows.select("_id", "_text", "_place", F.col("_to.r").alias("_range"), F.col("_to.g").alias("_guest")), Window.partitionBy("_range").orderBy("_guest", "_place")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _text, _edited (its last quarter replaced by the start of the next document), and the sketches of both and of the next text."""
    rows, after = successors(docs, key, text)
    rows = rows.withColumn("_n", F.length("_text")).withColumn("_cut", F.floor(F.col("_n") / 4).cast("int"))
    rows = rows.withColumn("_tail", F.substring(F.lead("_text").over(after), F.lit(1), F.col("_cut")))
    # the pieces that stay are those before the run of non-blanks that the cut falls into
    rows = rows.withColumn("_stays", F.substring("_text", F.lit(1), F.col("_n") - F.col("_cut")))
    rows = rows.withColumn("_blank", F.length(F.regexp_extract("_stays", r"(?s)\A.*\s", 0)))
    rows = rows.withColumn("_pieces", piece_hashes(F.col("_text")))
    rows = with_anchors(rows, "_pieces", "_anchors")
    rows = rows.withColumn("_kept", F.size("_pieces") - F.size(F.regexp_extract_all(F.substring("_text", F.col("_blank") + 1, F.col("_n")), F.lit(rf"\S{{1,{PIECE}}}"), F.lit(0))))
    rows = rows.withColumn("_from", F.greatest(F.col("_kept") - (K - 1), F.lit(0)))
    fresh = piece_hashes(F.concat(F.substring("_stays", F.col("_blank") + 1, F.col("_n")), F.coalesce("_tail", F.lit(""))))
    rows = rows.withColumn("_new", F.concat(F.slice("_pieces", F.col("_from") + 1, F.col("_kept") - F.col("_from")), fresh))
    rows = with_anchors(rows, "_new", "_late")
    late = F.transform("_late", lambda x: F.struct((x["at"] + F.col("_from")).alias("at"), x["hash"].alias("hash")))
    rows = rows.withColumn("_later", F.concat(F.filter("_anchors", lambda x: x["at"] < F.col("_from")), late))
    every = F.concat(F.slice("_pieces", F.lit(1), F.col("_from")), F.col("_new"))
    rows = rows.withColumn("_sketch", _sketch("_anchors", F.col("_pieces"))).withColumn("_sketch_edited", _sketch("_later", every))
    rows = rows.withColumn("_edited", F.concat("_stays", F.coalesce("_tail", F.lit(""))))
    rows = rows.select("_id", "_text", "_n", "_edited", "_sketch", "_sketch_edited", "_range", "_guest", "_place")
    return rows.withColumn("_sketch_next", F.lead("_sketch").over(after)).filter("not _guest").drop("_range", "_guest", "_place")


def op11_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(common.read(spark, sf_dir, "documents"))
    return rows.select(
        F.col("_id").alias("doc_id"), F.col("_n").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), hexed(F.col("_sketch")).alias("fingerprint"), hexed(F.col("_sketch_edited")).alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_sketch_edited")).alias("near_edited"), likeness(F.col("_sketch"), F.col("_sketch_next")).alias("near_next"),
    )
