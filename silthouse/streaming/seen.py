"""A stored set of seen keys: buckets by hash with a Bloom filter for each file, so a batch opens only files it may hit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silthouse.storage import children, size_of

#: Bits of a filter for each key, and bits set by one: about one key in a hundred is taken for a seen one.
BITS, PROBES = 10, 7
_FILTERS = "bucket long, n long, bits binary"


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each 64-bit hash in a filter of so many bits."""
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def bloom(h: np.ndarray) -> bytes:
    """The filter of a file's hashes."""
    bits = max(64, -(-len(h) * BITS // 64) * 64)
    held = np.zeros(bits, np.uint8)
    held[_places(h, bits).ravel().astype(np.int64)] = 1
    return np.packbits(held).tobytes()


def may_hold(bits: bytes, h: np.ndarray) -> np.ndarray:
    """Which of the hashes a filter may have; false only for those that it surely has not."""
    at = _places(h, 8 * len(bits)).astype(np.int64)
    held = np.frombuffer(bits, np.uint8)
    return (held[at >> 3] >> (7 - (at & 7)) & 1).all(axis=1)


class SeenKeys:
    """The keys that earlier batches had, in a folder of its own.

    A generation g is the folder g=<g>-<buckets>: `keys` and `bits`, by bucket and batch. The number of buckets doubles when
    they hold more than `per_bucket` keys on average; each doubling writes a new generation, so its cost is a constant share of
    all keys ever added, and what a batch reads depends on its own keys and `per_bucket`. A batch that is
    replayed finds its own former traces left out and written over.

    Null key columns are values like others. `read` has the bytes of the files that the last batch opened.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], per_bucket: int = 250_000, buckets: int = 16):
        self.spark, self.root, self.key, self.per_bucket, self.buckets, self.read = spark, root.rstrip("/"), list(key), per_bucket, buckets, 0

    def _generation(self) -> tuple[int, int]:
        """Number and buckets of the newest generation that was finished."""
        own = [tuple(map(int, name[2:].split("-"))) for name in children(self.spark, self.root) if name.startswith("g=") and "_SUCCESS" in children(self.spark, f"{self.root}/{name}/start")]
        return max(own, default=(-1, self.buckets))

    def _hashed(self, rows: DataFrame, buckets: int) -> DataFrame:
        h = F.xxhash64(*(F.struct(k) for k in self.key))
        return rows.withColumn("_h", h).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))

    def _store(self, keys: DataFrame, place: str, buckets: int, batch: int) -> None:
        """Writes keys with their batch (`_of`) and their filters, one file of each for a bucket; over what the batch had there."""
        rows = self._hashed(keys.select(*self.key, "_of"), buckets).repartition("_bucket")

        def filters(table: pa.Table) -> pa.Table:
            h = table.column("_h").to_numpy().view(np.uint64)
            return pa.table({"bucket": table.column("_bucket").slice(0, 1), "n": [len(h)], "bits": [bloom(h)]})

        both = {"keys": rows.withColumnRenamed("_bucket", "bucket").drop("_h"), "bits": rows.select("_bucket", "_h").groupBy("_bucket").applyInArrow(filters, _FILTERS)}
        for name, found in both.items():
            out = found.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy("bucket", "batch").parquet(f"{place}/{name}")
        count = self.spark.read.parquet(f"{place}/bits").filter(F.col("batch") == batch).agg(F.sum("n").alias("n")) if children(self.spark, f"{place}/bits") else None
        if count is not None:
            count.write.mode("overwrite").parquet(f"{place}/counts/batch={batch}")

    def _files(self, place: str, name: str, buckets: list[int], batch: int) -> list[str]:
        """Folders of these buckets that other batches wrote."""
        there = set(children(self.spark, f"{place}/{name}"))
        own = [f"{place}/{name}/bucket={b}" for b in buckets if f"bucket={b}" in there]
        return [f"{b}/{x}" for b in own for x in children(self.spark, b) if x.startswith("batch=") and x != f"batch={batch}"]

    def _open(self, place: str, name: str, files: list[str]) -> DataFrame:
        self.read += sum(size_of(self.spark, f) for f in files)
        return self.spark.read.option("basePath", f"{place}/{name}").parquet(*files)

    def grow(self, batch: int) -> None:
        """A new generation with more buckets, if the batches before this one need it."""
        g, buckets = self._generation()
        place = f"{self.root}/g={g}-{buckets}"
        if g < 0:
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/g=0-{buckets}/start")
            return
        counted = [f"{place}/counts/{x}" for x in children(self.spark, f"{place}/counts") if x != f"batch={batch}"]
        total = self.spark.read.parquet(*counted).agg(F.sum("n")).first()[0] or 0 if counted else 0
        more = buckets
        while total > more * self.per_bucket:
            more *= 2
        if more > buckets:
            fresh = f"{self.root}/g={g + 1}-{more}"
            self._store(self.spark.read.parquet(f"{place}/keys"), fresh, more, -1)
            self.spark.range(1).write.mode("overwrite").parquet(f"{fresh}/start")

    def unseen(self, rows: DataFrame, batch: int) -> DataFrame:
        """One row for each key that no other batch had."""
        self.grow(batch)
        g, buckets = self._generation()
        place, self.read = f"{self.root}/g={g}-{buckets}", 0
        fresh = rows.dropDuplicates(self.key)
        hashed = self._hashed(fresh.select(*self.key), buckets)
        touched = [r["_bucket"] for r in hashed.select("_bucket").distinct().collect()]  # at most all buckets
        filters = self._files(place, "bits", touched, batch)
        if not filters:
            return fresh

        def hits(own: pa.Table, stored: pa.Table) -> pa.Table:
            h = own.column("_h").to_numpy().view(np.uint64)
            found = [(n, b) for n, b, bits in zip(stored.column("batch").to_pylist(), stored.column("bucket").to_pylist(), stored.column("bits").to_pylist()) if len(h) and may_hold(bits, h).any()]
            return pa.table({"batch": pa.array([n for n, _ in found], pa.int64()), "bucket": pa.array([b for _, b in found], pa.int64())})

        stored = self._open(place, "bits", filters).select(F.col("bucket").cast("long"), F.col("batch").cast("long"), "bits")
        found = hashed.select("_bucket", "_h").groupBy("_bucket").cogroup(stored.groupBy("bucket")).applyInArrow(hits, "batch long, bucket long").collect()  # files, not keys
        files = [f"{place}/keys/bucket={r.bucket}/batch={r.batch}" for r in found]
        if not files:
            return fresh
        known = self._open(place, "keys", files).filter(F.col("_of") != batch).select(*(F.col(k).alias(f"_{k}") for k in self.key))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key]
        return fresh.join(known, same, "left_anti")

    def add(self, keys: DataFrame, batch: int) -> None:
        """Keeps the keys of a batch, once what it brought is stored."""
        g, buckets = self._generation()
        self._store(keys.withColumn("_of", F.lit(batch)), f"{self.root}/g={g}-{buckets}", buckets, batch)
