"""Column profiles: one scan for all columns' figures, types by evidence, keywords and guesses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, FloatType, NumericType, StringType, TimestampNTZType, TimestampType

#: Date patterns, in the order in which they are tried; the first that fits best counts.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "M/d/yyyy", "yyyyMMdd", "d/M/yy")
#: What a column's name, in lower case, says of it, and what it must not say.
FLAGS = {
    "has_locality": (r"יישוב|ישוב|עיר|(^|[^a-z])(city|town|locality)", r"עירוני|capacity"),
    "has_authority": (r"רשות|מועצה|(^|[^a-z])(authority|municipal)", r"לרשות|ברשות|רשותם"),
    "has_ministry": (r"משרד|ministry|(^|[^a-z])office($|[^a-z])", None),
    "has_date": (r"תאריך|שנה|שנת|date|datetime|(^|_)dt($|_)|(^|_)yr($|_)|year", r"אחוז"),
    "has_parcel": (r"גוש|חלקה|חלקות|(^|[^a-z])(gush|parcel|helka)", r"אבו גוש|גוש עציון|גוש חלב|גוש יער|היערני|מחלקת|המחלקה"),
    "has_geometry": (r"(^|_)geom($|_)|geometry|_wkt$|קואורדינט|נ\.צ|(^|[^a-z])(lat|lon|lng|latitude|longitude|easting|northing)($|[^a-z])", None),
}
STOPWORDS = ("the", "and", "of", "to", "in", "is", "it", "for", "that", "was", "with", "this", "are", "be", "by", "or", "at", "as", "on", "an", "de", "la", "der", "die", "und")


def numeric_text(c: Column) -> Column:
    """Whether a text is a number once commas and spaces are gone; null for null and ''."""
    text = F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.regexp_replace(text, r"[,\s]", "").rlike(r"^-?[0-9]+(\.[0-9]+)?$")


def numeric_value(c: Column) -> Column:
    return F.when(numeric_text(c), F.regexp_replace(c.cast("string"), r"[,\s]", "")).try_cast("double")


def _cell(df: DataFrame, c: str) -> tuple[Column, Column]:
    """A column as it is counted (null where it says nothing) and its number, if it has one, by the column's type."""
    kind, own = df.schema[c].dataType, F.col(f"`{c}`")
    if isinstance(kind, (FloatType, DoubleType)):
        plain = own.cast("double")
        return own, F.when(~F.isnan(plain) & (F.abs(plain) < float("inf")), plain)
    if isinstance(kind, NumericType):
        return own, own.cast("double")
    if isinstance(kind, StringType):
        return F.nullif(F.trim(own), F.lit("")), numeric_value(own)
    flat = own if isinstance(kind, (DateType, TimestampType, TimestampNTZType, BooleanType)) else own.cast("string")
    return flat, F.lit(None).cast("double")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: rows, filled, distinct (estimate), numeric share, min/max/avg of numbers. One aggregate over one scan.

    Only text is parsed; numbers are taken as they are, dates and flags have none. Blank texts are not filled.
    """
    columns = columns or df.columns
    cells = [_cell(df, c) for c in columns]
    flat = df.select(*(x.alias(f"{n}{k}") for k, cell in enumerate(cells) for n, x in zip("tv", cell, strict=True)))
    parts = []
    for k in range(len(columns)):
        parts += [F.count(f"t{k}").alias(f"f{k}"), F.approx_count_distinct(f"t{k}").alias(f"d{k}"), F.count(f"v{k}").alias(f"s{k}"), F.min(f"v{k}").alias(f"l{k}"), F.max(f"v{k}").alias(f"h{k}"), F.avg(f"v{k}").alias(f"a{k}")]
    one = flat.agg(F.count(F.lit(1)).alias("rows"), *parts)
    share = {k: (F.col(f"s{k}") / F.nullif(F.col(f"f{k}"), F.lit(0))).alias("numeric_share") for k in range(len(columns))}
    rows = [F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"f{k}").alias("filled"), F.col(f"d{k}").alias("distinct_estimate"), share[k], *(F.col(f"{x}{k}").alias(n) for x, n in (("l", "min"), ("h", "max"), ("a", "avg")))) for k, c in enumerate(columns)]
    found = one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")
    return found.withColumn("fill_rate", F.col("filled") / F.nullif(F.col("rows"), F.lit(0))).withColumn("distinct_ratio", F.col("distinct_estimate") / F.nullif(F.col("filled"), F.lit(0)))


def candidate_key(profiled: DataFrame) -> Column:
    """Of a profile: whether a column could be a key."""
    return (F.col("distinct_ratio") >= 0.99) & (F.col("fill_rate") >= 0.99)


def top_values(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    text = F.trim(F.col(column).cast("string"))
    return df.select(text.alias("value")).filter("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("value")).limit(n)


def keywords(df: DataFrame, column: str, n: int = 25, least: int = 3) -> DataFrame:
    """The most frequent words but stopwords; ties in the order of the words."""
    words = F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"[\p{L}]+"), F.lit(0))
    rows = df.select(F.explode(words).alias("word")).filter((F.length("word") >= least) & ~F.col("word").isin(*STOPWORDS))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("word")).limit(n)


def date_formats(df: DataFrame, column: str, least: float = 0.8) -> list[tuple[str, float]]:
    """The patterns that parse at least that share of the filled values, in order: one aggregate."""
    text = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    shares = df.agg(*(F.sum(F.try_to_timestamp(text, F.lit(p)).isNotNull().cast("int")).alias(f"p{k}") for k, p in enumerate(DATE_FORMATS)), F.count(text).alias("n")).first()
    n = shares["n"] or 0
    return [(p, shares[f"p{k}"] / n) for k, p in enumerate(DATE_FORMATS) if n and (shares[f"p{k}"] or 0) / n >= least]


def infer_types(df: DataFrame) -> dict[str, str]:
    """integer, numeric, date or text for each column: every filled value must fit. One aggregate."""
    texts = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in df.columns}
    parts = []
    for k, t in enumerate(texts.values()):
        plain = F.regexp_replace(t, ",", "")
        parts += [F.bool_and(plain.rlike(r"^[+-]?[0-9]+$")).alias(f"i{k}"), F.bool_and(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")).alias(f"n{k}"), F.bool_and(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$") & F.substring(t, 1, 10).try_cast("date").isNotNull()).alias(f"d{k}")]
    one = df.agg(*parts).first()
    return {c: "integer" if one[f"i{k}"] else "numeric" if one[f"n{k}"] else "date" if one[f"d{k}"] else "text" for k, c in enumerate(texts)}


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The columns cast to inferred types; values that don't fit are null."""
    cast = {"integer": "bigint", "numeric": "double", "date": "date"}
    plain = lambda c, kind: F.substring(F.trim(F.col(c)), 1, 10) if kind == "date" else F.regexp_replace(F.trim(F.col(c)), ",", "")
    return df.select(*(plain(c, types[c]).try_cast(cast[types[c]]).alias(c) if types.get(c) in cast else F.col(c) for c in df.columns))


def name_flags(columns: list[str]) -> dict[str, bool]:
    return {flag: any(re.search(yes, c.lower()) and not (no and re.search(no, c.lower())) for c in columns) for flag, (yes, no) in FLAGS.items()}


def entity_guess(kind: str, name: str, top: list[str], places: set[str]) -> str:
    """What a column holds: a date, place, company, id, amount or plain text."""
    known = sum(v.strip().lower() in places for v in top)
    if kind == "date":
        return "date"
    if top and known >= len(top) / 2:
        return "locality"
    if re.search("company|corporation|supplier|חברה|תאגיד", name, re.I):
        return "corporation"
    if kind in ("integer", "numeric"):
        return "id" if re.search(r"(^|_)(id|key|code|no|num)$|key$|id$", name, re.I) else "amount" if re.search("price|cost|amount|sum|bal|tax|סכום|מחיר", name, re.I) else "number"
    return "person" if re.search("name|שם", name, re.I) else "text"


def result_kinds(result: DataFrame, first: int = 60, rows: int = 1000) -> DataFrame:
    """column, kind (number, date or text) of a shown result: what its first `first` values that aren't empty all are.

    Only the first `rows` rows are looked at, as many as the console shows. Numbers are finite, in text plain decimals; dates are
    YYYY-MM, YYYY-MM-DD with or without a time, or MM/DD/YYYY with slashes or points. A column without values is text.
    """

    def number(v: Column) -> Column:
        return F.trim(v).rlike(r"^-?[0-9]+(\.[0-9]+)?$")

    def date(v: Column) -> Column:
        iso = v.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?([ T][0-9].*)?$") & F.concat(F.substring(v, 1, 7), F.coalesce(F.nullif(F.regexp_extract(v, r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})", 1), F.lit("")), F.lit("-01"))).try_cast("date").isNotNull()
        us = F.regexp_replace(v, r"^([0-9]{2})[/.]([0-9]{2})[/.]([0-9]{4})$", "$3-$1-$2")
        return iso | ((us != v) & us.try_cast("date").isNotNull())

    made = []
    for name, kind in result.dtypes:
        c = F.col(f"`{name}`")
        text = c.cast("string") if kind not in ("double", "float") else F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.format_string("%.6f", c.cast("double"))).otherwise("?")
        if kind not in ("string", "date", "timestamp", "timestamp_ntz", "double", "float", "tinyint", "smallint", "int", "bigint") and not kind.startswith("decimal"):
            text = F.when(c.isNotNull(), F.lit("?"))  # booleans and nested values are neither
        made.append(F.slice(F.collect_list(F.nullif(text, F.lit(""))), 1, first))
    lists = result.limit(rows).agg(F.array(*made).alias("l")).select(F.posexplode("l").alias("at", "v"))
    names = F.array(*(F.lit(c) for c in result.columns))
    kind = F.when(F.size("v") == 0, "text").when(F.forall("v", number), "number").when(F.forall("v", date), "date").otherwise("text")
    return lists.select(names[F.col("at")].alias("column"), kind.alias("kind"))
