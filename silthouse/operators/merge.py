"""Writing a row archive: every merge is a plan over the old and the new rows, written as a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silthouse.functions.identity import content_hash, repair_hash, row_hash


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str] | None = None, stamp: str | None = None) -> DataFrame:
    """The new rows whose key (without one: row hash) the archive doesn't have, each once."""
    if key:
        return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")
    own = [c for c in new.columns if c in old.columns]
    new = new.withColumn("row_hash", row_hash(own, stamp)).dropDuplicates(["row_hash"])
    return new.join(old.select(row_hash(own, stamp).alias("row_hash")), "row_hash", "left_anti").drop("row_hash")


def content_diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """The new rows whose content the archive has not seen; repeated new rows stay as they are."""
    return new.withColumn("_hash", content_hash(columns)).join(old.select(content_hash(columns).alias("_hash")), "_hash", "left_anti").drop("_hash")


def refresh_stamp(old: DataFrame, new: DataFrame, stamp: str, first_seen: str = "first_seen") -> DataFrame:
    """Insert or refresh: content once, the earliest first_seen and the latest stamp of it."""
    own = [c for c in old.columns if c not in (stamp, first_seen)]
    both = old.unionByName(new, allowMissingColumns=True)
    best = both.groupBy(row_hash(own).alias("_hash")).agg(*(F.first(c).alias(c) for c in own), F.min(first_seen).alias(first_seen), F.max(stamp).alias(stamp))
    return best.select(*old.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """The new rows in place of the old ones of their key. Of several new ones the first in an order counts."""
    if order:
        own = Window.partitionBy(*key).orderBy(*order)
        new = new.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates(key)
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def weighted_upsert(old: DataFrame, new: DataFrame, key: list[str], weight: str = "weight") -> DataFrame:
    """One row per key with the highest weight; ties go to the smallest row."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in key and c != weight]
    best = both.groupBy(*key).agg(F.min(F.struct((-F.col(weight)).alias("_w"), *rest)).alias("_b"))
    return best.select(*key, *(F.col(f"_b.{c}").alias(c) for c in rest), (-F.col("_b._w")).alias(weight))


def accumulating_upsert(old: DataFrame, new: DataFrame, key: str, count: str, sources: str) -> DataFrame:
    """Occurrences add up, lists of sources are joined without repeats."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.sum(count).alias(count), F.array_sort(F.array_distinct(F.flatten(F.collect_set(sources)))).alias(sources))


def collapse_history(df: DataFrame, columns: list[str], first_seen: str, stamp: str, loose: bool = False) -> DataFrame:
    """One row per content: the row first seen, with the latest stamp. loose: '180.0' is '180'."""
    hashed = df.withColumn("_hash", (repair_hash if loose else content_hash)(columns))
    rest = [c for c in df.columns if c not in (first_seen, stamp)]
    kept = hashed.groupBy("_hash").agg(F.min(F.struct(first_seen, *rest)).alias("_b"), F.max(stamp).alias(stamp))
    return kept.select(*(F.col(stamp) if c == stamp else F.col(f"_b.{c}").alias(c) for c in df.columns))


def version_diff(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key, change: rows added, removed and modified between two versions."""
    a = old.select(*key, content_hash(columns).alias("_a"))
    b = new.select(*key, content_hash(columns).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, key, "full_outer").select(*key, change.alias("change")).filter("change is not null")


def metadata_diff(old: Column, new: Column, skipped: tuple[str, ...] = (), most: int = 500) -> Column:
    """Entries (path, change, before, after) between two string maps, values cut to `most` characters."""
    paths = F.array_sort(F.array_distinct(F.concat(F.map_keys(old), F.map_keys(new))))
    kept = F.filter(paths, lambda p: ~p.isin(list(skipped))) if skipped else paths
    entry = F.transform(
        kept,
        lambda p: F.struct(
            p.alias("path"),
            F.when(~F.map_contains_key(old, p), "added").when(~F.map_contains_key(new, p), "removed").when(~F.try_element_at(old, p).eqNullSafe(F.try_element_at(new, p)), "changed").alias("change"),
            F.substring(F.try_element_at(old, p), 1, most).alias("before"),
            F.substring(F.try_element_at(new, p), 1, most).alias("after"),
        ),
    )
    return F.filter(entry, lambda e: e["change"].isNotNull())


def replay(versions: DataFrame, columns: list[str], version_at: str) -> DataFrame:
    """All rows of all versions once, first_seen that of the earliest version: one aggregate, in any order of versions."""
    return versions.groupBy(*columns).agg(F.min(version_at).alias("first_seen"))


def consolidate(batches: DataFrame, key: list[str], first_seen: str = "first_seen") -> DataFrame:
    """The newest row of each key over the batches of a version."""
    own = Window.partitionBy(*key).orderBy(F.col(first_seen).desc_nulls_last(), *(F.col(c) for c in batches.columns if c not in key))
    return batches.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n", first_seen)


def one_per_date(snapshots: DataFrame, day: str, live: str) -> DataFrame:
    """One snapshot for each date, the live one before a copy, renumbered over all dates as `version`.

    The numbering is over dates, of which there are few; it runs after the reduction to one row each.
    """
    best = snapshots.groupBy(day).agg(F.max_by(F.struct(*(c for c in snapshots.columns if c != day)), F.struct(F.col(live).cast("int"), *(c for c in snapshots.columns if c not in (day, live)))).alias("_b"))
    flat = best.select(day, *(F.col(f"_b.{c}").alias(c) for c in snapshots.columns if c != day))
    return flat.withColumn("version", F.row_number().over(Window.orderBy(day)))


def find_or_create(members: DataFrame, names: DataFrame, name: str = "name", ident: str = "id") -> DataFrame:
    """The members and a new one for each name without, its id a hash of the name."""
    fresh = names.select(name).filter(F.trim(name) != "").distinct().join(members.select(name), name, "left_anti")
    return members.select(ident, name).unionByName(fresh.select(F.sha2(name, 256).alias(ident), name))


def shrink_guard(last_full: int, rows: int, share: float = 0.5, override: bool = False) -> bool:
    """Whether a new version may replace the last full one."""
    return override or last_full <= 0 or rows >= share * last_full


def short_load(table_rows: int, version_rows: int, share: float = 0.95) -> bool:
    """Whether a table holds too little of its version."""
    return version_rows > 0 and table_rows < share * version_rows
