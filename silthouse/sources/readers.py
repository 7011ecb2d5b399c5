"""Sources: CSV of uncertain encoding, calendars, seeds, samples, and the catalog of what is there."""

from __future__ import annotations

import io
import re
from csv import reader
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silthouse.functions.identity import clean_headers

ENCODINGS = ("utf-8-sig", "utf-8", "windows-1255", "iso-8859-8", "latin-1")
#: Names under which Spark's CSV reader knows them.
_SPARK_NAMES = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "windows-1255": "windows-1255", "iso-8859-8": "ISO-8859-8", "latin-1": "ISO-8859-1"}
PREFIX_BYTES = 4 << 20
MOST_HEADER_ROWS = 20
FORMATS = ("csv", "xlsx", "xls", "json", "geojson", "xml", "ics", "zip", "pdf", "doc", "docx", "txt", "parquet")


def prefix(spark: SparkSession, path: str, size: int = PREFIX_BYTES) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(place)
    try:
        return bytes(stream.readNBytes(int(min(size, fs.getFileStatus(place).getLen()))))
    finally:
        stream.close()


def encoding_of(data: bytes) -> str:
    """The first encoding of the ladder that reads a prefix; a character cut off at its end doesn't count."""
    for name in ENCODINGS:
        if name == "utf-8-sig" and not data.startswith(b"\xef\xbb\xbf"):
            continue
        for cut in range(4):
            try:
                data[: len(data) - cut].decode(name)
                return name
            except UnicodeDecodeError:
                if name in ("windows-1255", "iso-8859-8"):
                    break
    return "latin-1"


def delimiter_of(text: str) -> str:
    """The separator that is there in the first line most often."""
    line = text.lstrip("﻿").split("\n", 1)[0]
    return max((",", ";", "\t", "|"), key=lambda d: (line.count(d), d == ","))


def _undefined(name: str) -> list[str]:
    """The bytes, in hex, that an 8-bit encoding has no character for."""
    return [f"{k:02X}" for k in range(256) if not bytes([k]).decode(name, errors="ignore")]


def csv_facts(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The first encoding of the ladder that every line of a file can be read in, and whether a quoted newline may occur.

    One pass over all lines, as bytes. A line break inside quotes leaves an odd number of quotes on its line.
    """
    lines = spark.read.text(path)
    digits = F.hex(F.col("value").cast("binary"))
    gaps = {n: _undefined(n) for n in ("windows-1255", "iso-8859-8")}
    broken = [F.bool_or(digits.rlike(f"^(?:..)*?(?:{'|'.join(g)})")).alias(n) for n, g in gaps.items()]
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    facts = lines.agg(F.bool_or(~F.is_valid_utf8("value")).alias("utf-8"), *broken, F.bool_or(quotes % 2 == 1).alias("odd")).first()
    name = next((n for n in ("utf-8", *gaps) if not facts[n]), "latin-1")
    return name, bool(facts["odd"])


def csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A CSV file as texts: the encoding by all its bytes, the separator by its first line, short rows padded, long ones cut, clean headers.

    It is split over tasks unless a quoted newline may occur.
    """
    name, whole = csv_facts(spark, path)
    if name in ("windows-1255", "iso-8859-8"):  # Spark reads these only with Java's character sets
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    text = prefix(spark, path).decode(name, errors="ignore").lstrip("\ufeff")
    sep = delimiter_of(text)
    rows = spark.read.option("encoding", _SPARK_NAMES[name]).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", whole).option("mode", "PERMISSIVE").option("header", header).csv(path)
    # Spark renames repeated headers, so the names come from the first line
    names = next(reader(io.StringIO(text), delimiter=sep), []) if header else []
    return rows.toDF(*clean_headers((names + [""] * len(rows.columns))[: len(rows.columns)]))


def header_row(rows: list[list[str | None]]) -> int | None:
    """Which of the first rows has the most cells with letters; 5 or more settle it, and none means no header."""
    best, most = None, 0
    for k, row in enumerate(rows[:MOST_HEADER_ROWS]):
        n = sum(bool(re.search(r"[^\W\d_]", c or "")) for c in row)
        if n > most:
            best, most = k, n
        if n >= 5:
            break
    return best


def sheet(spark: SparkSession, path: str, name: str | int | None = None) -> DataFrame:
    """The widest sheet of a workbook as texts; needs pandas' Excel readers, which are optional."""
    book = pd.read_excel(path, sheet_name=name, header=None, dtype=str)
    frames = list(book.values()) if isinstance(book, dict) else [book]
    frame = max(frames, key=lambda f: f.shape[1])
    at = header_row(frame.head(MOST_HEADER_ROWS).where(frame.notna(), None).values.tolist())
    names = clean_headers([""] * frame.shape[1] if at is None else [str(c or "") for c in frame.iloc[at]])
    body = frame.iloc[0 if at is None else at + 1 :]
    return spark.createDataFrame(body.where(body.notna(), None).values.tolist(), ", ".join(f"`{n}` string" for n in names))


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """Events of iCalendar files, one row each: folded lines joined, escapes undone."""
    text = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "\n[ \t]", "")
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all(text, F.lit("(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))).alias("e"))

    def prop(name: str) -> Column:
        raw = F.nullif(F.regexp_extract("e", rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1), F.lit(""))
        return F.regexp_replace(F.regexp_replace(raw, r"\\n", "\n"), r"\\([,;\\])", "$1")

    def when(name: str) -> Column:
        raw = F.regexp_extract("e", rf"(?m)^{name}(?:;[^:\n]*)?:([0-9TZ]+)$", 1)
        return F.coalesce(F.try_to_timestamp(F.regexp_replace(raw, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(raw, F.lit("yyyyMMdd")))

    guests = F.array_join(F.transform(F.regexp_extract_all("e", F.lit(r"(?m)^ATTENDEE(?:;[^:\n]*)?:(?:mailto:)?(.*)$"), F.lit(1)), F.trim), "; ")
    return blocks.select(prop("SUMMARY").alias("title"), when("DTSTART").alias("start"), when("DTEND").alias("end"), prop("LOCATION").alias("location"), prop("DESCRIPTION").alias("description"), F.regexp_replace(prop("ORGANIZER"), "^mailto:", "").alias("organizer"), F.nullif(guests, F.lit("")).alias("participants"), prop("UID").alias("uid"), prop("STATUS").alias("status"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def format_of(declared: Column, name: Column) -> Column:
    """The declared format if it is a known one, else that of a file name or URL path."""
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    own = F.lower(F.trim(declared))
    return F.when(own.isin(*FORMATS), own).when(ending.isin(*FORMATS), ending)


#: Types of OData metadata.
EDM = {"Edm.Int16": "smallint", "Edm.Byte": "smallint", "Edm.Int32": "int", "Edm.Int64": "bigint", "Edm.Boolean": "boolean", "Edm.DateTimeOffset": "timestamp", "Edm.String": "string", "Edm.Decimal": "decimal(38,10)", "Edm.Double": "double", "Edm.Guid": "string"}


def edm_schema(metadata: str, entity: str) -> str:
    """The schema of an entity type of an OData metadata document; unknown types are texts."""
    block = re.search(rf'<EntityType[^>]*Name="{re.escape(entity)}"[^>]*>(.*?)</EntityType>', metadata, re.S)
    if not block:
        raise ValueError(f"no entity type {entity}")
    return ", ".join(f"`{n}` {EDM.get(t, 'string')}" for n, t in re.findall(r'<Property[^>]*Name="([^"]+)"[^>]*Type="([^"]+)"', block[1]))


def json_pages(spark: SparkSession, path: str, schema: str, records: str = "result.records") -> DataFrame:
    """Saved pages of a paged API, one JSON document each: their records as rows."""
    wrapped = schema_path(records, f"array<struct<{', '.join(p.replace('` ', '`: ') for p in schema.split(', '))}>>")
    return spark.read.schema(wrapped).json(path, multiLine=True).select(F.explode(records).alias("r")).select("r.*")


def schema_path(path: str, inner: str) -> str:
    first, _, rest = path.partition(".")
    return f"{first} struct<{schema_path(rest, inner).replace(' ', ': ', 1)}>" if rest else f"{first} {inner}"


def keyset_page(df: DataFrame, key: str, after, n: int = 100) -> DataFrame:
    """The next page in key order."""
    return (df if after is None else df.filter(F.col(key) > F.lit(after))).orderBy(key).limit(n)


def sample(df: DataFrame, rows: int, wanted: int, seed: int = 7) -> DataFrame:
    """A random share of about `wanted` of `rows` rows."""
    return df if rows <= wanted else df.sample(fraction=min(1.0, wanted / rows), seed=seed)


def catalog(spark: SparkSession) -> DataFrame:
    """table, column, kind, ordinal of everything in the current catalog."""
    rows = [(t.name, c.name, c.dataType, k) for t in spark.catalog.listTables() for k, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "table string, column string, kind string, ordinal int")


def tables_with(columns: DataFrame, signature: set[str]) -> DataFrame:
    """Tables that have all columns of a signature, whatever their names."""
    own = columns.filter(F.lower("column").isin(*(s.lower() for s in signature)))
    return own.groupBy("table").agg(F.countDistinct(F.lower("column")).alias("n")).filter(F.col("n") == len(signature)).select("table")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and time of the files below a folder: signs of change without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def stacked(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of several sources one below the other, each row with its `source`; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(name)) for name, df in parts.items()])
