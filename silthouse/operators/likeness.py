"""Joins of alike names that lose no pair and compare no block in full.

A likeness of at least some bound needs shared pieces: words, for the likeness of sorted words, or pairs of
neighbouring letters, for longest common subsequences. Each name keeps only so many of its rarest pieces that two
alike names must meet in one, names join on these, and the exact likeness decides. Pieces are counted inside a block,
so a common piece is taken only from names that have nothing rarer.

Null and empty names have no partners. Equal names are to be collapsed before; each pair comes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silthouse.functions.fuzzy import PARTIAL, SORTED, registry_score
from silthouse.storage import written

_EPS = 1e-9


def _rarest(rows: DataFrame, block: list[str], pieces: str, keep: Column) -> DataFrame:
    """The rows with `piece`, one for each of their `keep` rarest pieces, ties in the order of the pieces."""
    each = rows.select("_row", *block, F.explode(pieces).alias("piece"))
    often = each.groupBy(*block, "piece").agg(F.count(F.lit(1)).alias("_n"))
    ranked = each.join(often, [*block, "piece"]).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_n", "piece"))).alias("_r"))
    own = rows.join(ranked, "_row")
    return own.withColumn("piece", F.explode(F.slice(F.col("_r")["piece"], F.lit(1), F.greatest(F.lit(1), keep)))).drop("_r", pieces)


def word_pairs(names: DataFrame, block: list[str], words: str, share: float) -> DataFrame:
    """x, y: structs of the rows of a block, x.id below y.id, whose different words have a Jaccard likeness of `share` or more.

    names: id, the block's columns, words (an array) and whatever the caller needs of a row.
    """
    if not 0 < share <= 1:
        raise ValueError("names without a shared word cannot be found by words: share must be above 0")
    every = [c for c in names.columns]
    rows = names.withColumn("_row", F.col("id")).withColumn("_set", F.array_distinct(words)).withColumn("_size", F.size("_set")).filter("_size > 0")
    own = _rarest(rows, block, "_set", F.col("_size") - F.ceil(F.col("_size") * share - _EPS).cast("int") + 1)
    x, y = own.alias("x"), own.alias("y")
    same = F.lit(True)
    for c in (*block, "piece"):
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    near = F.least("x._size", "y._size") >= share * F.greatest("x._size", "y._size") - _EPS
    both = x.join(y, same & (F.col("x.id") < F.col("y.id")) & near)
    found = both.select(*(F.struct(*(F.col(f"{s}.{c}") for c in every)).alias(s) for s in ("x", "y")))
    # a pair that shares several of its rarest words meets in each of them
    shared = F.size(F.array_intersect(f"x.{words}", f"y.{words}")) / F.size(F.array_union(f"x.{words}", f"y.{words}"))
    return found.filter(shared >= share - _EPS).dropDuplicates()


def _letters(text: Column) -> Column:
    """The different pairs of neighbouring letters."""
    return F.when(F.length(text) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def _sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")), " ")


def _lost(length: Column, least: float) -> Column:
    """How many letter pairs of a text the edits may take that leave a common-subsequence ratio of `least` or more.

    A deleted letter takes two, an inserted one takes one; the worst partner is the shortest or the longest one possible.
    """
    return F.floor(length * max(4 * (1 - least) / (2 - least), 2 * (1 - least) / least) + _EPS).cast("int")


def registry_pairs(left: DataFrame, right: DataFrame, least: float, text: str = "plain", prefix: int = 3) -> DataFrame:
    """a, b, score: different names of two sides with the same first `prefix` letters and a registry score of `least` or more.

    The score has three parts, and each has its own pieces: the plain ratio and that of sorted words need rare letter pairs
    of both; the partial ratio needs one of the shorter name's rarest ones anywhere in the longer name.
    """
    if prefix < 2 or not 0.5 < least <= 1:
        raise ValueError("prefix must be 2 or more, least above 0.5 and at most 1")

    def side(df: DataFrame, of: int) -> DataFrame:
        names = df.select(F.col(text).alias("t")).filter(F.length("t") >= prefix).distinct()
        return names.select(F.lit(of).alias("side"), "t", F.substring("t", 1, prefix).alias("head"))

    def near(bound: float) -> Column:
        return F.least("x.n", "y.n") * (2 - bound) >= F.greatest("x.n", "y.n") * bound - _EPS

    #: part, its text, its bound, whether a side sends all its letter pairs, and which lengths may meet
    parts = [
        ("ratio", "plain", least, (False, False), near(least)),
        ("sorted", "sorted", least / SORTED, (False, False), near(least / SORTED)),
        ("short", "plain", least / PARTIAL, (False, True), F.expr("x.n <= y.n")),
        ("long", "plain", least / PARTIAL, (True, False), F.expr("x.n > y.n")),
    ]
    parts = [p for p in parts if p[2] <= 1]
    names = written(side(left, 0).unionByName(side(right, 1)), "names")
    texts = {"plain": F.col("t"), "sorted": _sorted_words(F.col("t"))}
    used = [F.struct(F.lit(k).alias("kind"), v.alias("s")) for k, v in texts.items() if any(p[1] == k for p in parts)]
    sized = names.withColumn("_s", F.explode(F.array(*used))).select("side", "t", "head", "_s.kind", F.length("_s.s").alias("n"), _letters(F.col("_s.s")).alias("_all"))
    # sorted words with so few letter pairs that edits may take them all meet one another
    few = (F.col("kind") == "sorted") & (F.size("_all") <= _lost(F.col("n"), min(1, least / SORTED)))
    each = sized.select("side", "t", "head", "kind", "n", F.explode(F.when(few, F.array_append("_all", "")).otherwise(F.col("_all"))).alias("p"))
    often = each.groupBy("kind", "head", "p").agg(F.count(F.lit(1)).alias("_n"))
    # Spark's size of a table leaves out that explode makes many rows of one: no such table may be sent whole through the driver
    ranked = each.hint("merge").join(often, ["kind", "head", "p"]).groupBy("side", "t", "head", "kind", "n").agg(F.array_sort(F.collect_list(F.struct("_n", "p"))).alias("_r"))
    sends = F.array(*(F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), F.when(F.col("side").isin([k for k in (0, 1) if whole[k]]), F.size("_r")).otherwise(_lost(F.col("n"), bound) + 1).alias("keep")) for part, kind, bound, whole, _ in parts))
    own = ranked.withColumn("_p", F.explode(F.filter(sends, lambda s: s["kind"] == F.col("kind"))))
    sent = own.select("side", "t", "head", "n", "_p.part", F.explode(F.slice(F.col("_r")["p"], F.lit(1), F.col("_p.keep"))).alias("p"))
    x, y = sent.filter("side = 0").alias("x"), sent.filter("side = 1").alias("y")
    meet = (F.col("x.part") == F.col("y.part")) & (F.col("x.head") == F.col("y.head")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.t") != F.col("y.t"))
    lengths = F.lit(False)
    for part, *_, fits in parts:
        lengths = lengths | ((F.col("x.part") == part) & fits)
    found = x.hint("merge").join(y, meet & lengths).select(F.col("x.t").alias("a"), F.col("y.t").alias("b")).distinct()
    return found.withColumn("score", registry_score("a", "b")).filter(F.col("score") >= least)
