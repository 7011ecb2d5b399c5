"""Sinks: versioned tables with a pointer, CSV and GeoJSON files, partitioned downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silthouse.operators.merge import insert_if_absent


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions below a folder."""
    fs, place = _fs(spark, root)
    if not fs.exists(place):
        return []
    names = [s.getPath() for s in fs.listStatus(place)]
    done = [p for p in names if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()[2:]) for p in done)


def rebuild(df: DataFrame, root: str) -> int:
    """The rows as the next version of a table; readers see it once it is whole."""
    number = max(versions(df.sparkSession, root), default=0) + 1
    df.write.mode("overwrite").parquet(f"{root}/v={number}")
    return number


def current(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """A version of a table, the newest if none is named."""
    return spark.read.parquet(f"{root}/v={number or versions(spark, root)[-1]}")


def every_version(spark: SparkSession, root: str) -> DataFrame:
    """All versions one below the other, with their number as `v`."""
    return spark.read.option("basePath", root).parquet(*(f"{root}/v={n}" for n in versions(spark, root)))


def csv_file(df: DataFrame, path: str, most: int = 200_000) -> bool:
    """CSV with a byte order mark for spreadsheets, nulls as empty cells; whether there were more than the `most` rows that it holds."""
    names = df.columns
    marked = df.limit(most).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(("﻿" if k == 0 else "") + c) for k, c in enumerate(names)))
    marked.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return not df.offset(most).isEmpty()


def downloads(df: DataFrame, path: str, by: str, fmt: str = "json") -> None:
    """A folder of files for each value of a column."""
    df.write.mode("overwrite").partitionBy(by).format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)


def feature_collection(df: DataFrame, feature: Column, most: int) -> DataFrame:
    """One row: a FeatureCollection of at most `most` features, and whether there were more. For answers, not for whole tables."""
    rows = df.select(feature.alias("f")).limit(most + 1)
    kept = F.slice(F.collect_list("f"), 1, most)
    return rows.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(kept, ","), F.lit("]}")).alias("collection"), (F.count(F.lit(1)) > most).alias("exceeded_transfer_limit"))


def version_record(old: DataFrame | None, summary: DataFrame, dataset: str, number: int) -> DataFrame:
    """A table of versions with one row more: the counts of each kind of change. summary: key .., change."""
    counts = [F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified")]
    row = summary.agg(*counts).select(F.lit(dataset).alias("dataset"), F.lit(number).alias("version"), F.to_json(F.struct("added", "removed", "modified")).alias("change_summary"))
    return row if old is None else old.unionByName(row)


def dual_write(batch: DataFrame, rows_root: str, version_root: str, number: int, key: list[str] | None = None) -> int:
    """Writes a batch twice: whole as version `number` in CSV, and the rows that the archive lacks below `rows_root`; the count of the latter.

    For foreachBatch: both writes replace what an earlier try of the same number left, so a repeated batch changes nothing.
    """
    spark = batch.sparkSession
    batch.write.mode("overwrite").option("header", True).csv(f"{version_root}/v={number}")
    older = [n for n in versions(spark, rows_root) if n != number]
    old = spark.read.parquet(*(f"{rows_root}/v={n}" for n in older)) if older else batch.limit(0)
    fresh = insert_if_absent(old, batch, key)
    fresh.write.mode("overwrite").parquet(f"{rows_root}/v={number}")
    return spark.read.parquet(f"{rows_root}/v={number}").count()
