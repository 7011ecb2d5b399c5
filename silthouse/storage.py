"""Tables written on the way: the shared folder and written-then-read DataFrames."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent on one machine (local master, as in tests) a temporary folder takes its
    place; a cluster must name one, as its executors don't see the driver's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return f"{root.rstrip('/')}/silthouse"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="silthouse-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def written(df: DataFrame, tag: str, compression: str | None = None, **options: object) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back.

    It cuts the lineage: a lost executor costs the tasks that ran there, not the stages before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, on any file system that Spark knows; none if it is not there."""
    own, fs = _place(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(own)) if fs.exists(own) else []


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    own, fs = _place(spark, path)
    return fs.getContentSummary(own).getLength()
