"""Reading a row archive: projections, filters, sorts, pages, and the newest state of each item."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of wide values, left out of previews.
BULK = ("geometry_wkt", "geometry", "geom", "wkt")
HIDDEN = ("row_hash", "_row_hash")


def project(df: DataFrame, fields: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """The known ones of the fields, or all columns where none is known."""
    out = df.select(*([c for c in fields or () if c in df.columns] or df.columns))
    return out.distinct() if distinct else out


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.lower() in BULK + HIDDEN)).limit(rows)


def any_column_like(df: DataFrame, q: str) -> Column:
    """Some column has the text, in any case; % and _ are wildcards."""
    return reduce(or_, [F.col(c).cast("string").ilike(f"%{q}%") for c in df.columns])


def columns_like(df: DataFrame, wanted: dict[str, str]) -> Column:
    """Every named column has its text; empty texts and unknown columns don't count."""
    tests = [F.col(c).cast("string").ilike(f"%{v}%") for c, v in wanted.items() if v and c in df.columns]
    return reduce(and_, tests, F.lit(True))


def columns_equal(df: DataFrame, wanted: dict[str, object]) -> Column:
    """Every named column equals its value, or one of a list of values, as text."""
    tests = [F.col(c).cast("string").isin([str(x) for x in v]) if isinstance(v, (list, tuple)) else F.col(c).cast("string") == str(v) for c, v in wanted.items() if c in df.columns]
    return reduce(and_, tests, F.lit(True))


def from_query_string(params: dict[str, str], reserved: tuple[str, ...] = ("q", "limit", "offset", "sort", "fields", "distinct")) -> dict[str, str]:
    return {k: v for k, v in params.items() if k not in reserved and v != ""}


def sort_orders(df: DataFrame, spec: str) -> list[Column]:
    """'a, b desc' as orders, nulls last; unknown columns are skipped."""
    out = []
    for part in filter(None, map(str.strip, spec.split(","))):
        name, down = re.sub(r"\s+(asc|desc)$", "", part, flags=re.I), part.lower().endswith(" desc")
        name = part if part in df.columns else name
        if name in df.columns:
            out.append(F.col(name).desc_nulls_last() if down and name != part else F.col(name).asc_nulls_last())
    return out


def page(df: DataFrame, orders: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(*orders).offset(max(offset, 0)).limit(min(max(limit, 1), 500))


def search(df: DataFrame, fields=None, filters=None, q: str = "", sort: str = "", limit: int = 100, offset: int = 0, distinct: bool = False) -> DataFrame:
    """The datastore search: filter, project, sort and page in one plan."""
    rows = df.filter(columns_equal(df, filters or {}))
    if q:
        rows = rows.filter(any_column_like(df, q))
    rows = project(rows, fields, distinct)
    return page(rows, sort_orders(rows, sort) or [F.col(rows.columns[0]).asc_nulls_last()], limit, offset)


def capped_count(df: DataFrame, cap: int = 10_000) -> tuple[int, bool]:
    """Rows, counted no further than one beyond the cap; whether it was reached."""
    n = df.limit(cap + 1).count()
    return min(n, cap), n > cap


def truncated(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """At most so many rows, and whether there are more."""
    return df.limit(most), df.limit(most + 1).count() > most


def newest(df: DataFrame, item: list[str], order: list[Column]) -> DataFrame:
    """One row per item: the first in an order, which should end with a tie-breaker. Filters come after it."""
    own = Window.partitionBy(*item).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


def newest_by(df: DataFrame, item: list[str], order: list[str]) -> DataFrame:
    """As newest() for descending columns without nulls, by a partial aggregate: no row of an item but its best is shuffled."""
    rest = [c for c in df.columns if c not in item]
    best = df.groupBy(*item).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*(F.col(c) if c in item else F.col(f"_best.{c}").alias(c) for c in df.columns))


def value_counts(latest: DataFrame, value: str) -> DataFrame:
    return latest.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("items")).orderBy(F.desc("items"), F.asc("value"))


def item_history(df: DataFrame, item: str, key: object, order: list[str], watch: str) -> DataFrame:
    """All samples of an item in order, each with whether its watched value changed."""
    own = Window.partitionBy(item).orderBy(*order)
    changed = ~F.col(watch).eqNullSafe(F.lag(watch).over(own)) | (F.row_number().over(own) == 1)
    return df.filter(F.col(item) == F.lit(key)).withColumn("changed", changed)


def key_frontier(df: DataFrame, key: Column, separator: str = "-") -> DataFrame:
    """The highest key of each prefix, as text."""
    return df.select(key.alias("_key")).filter("_key is not null").groupBy(F.split_part("_key", F.lit(separator), F.lit(1)).alias("prefix")).agg(F.max("_key").alias("frontier"))


def recent_series(frontier: DataFrame, n: int) -> DataFrame:
    return frontier.orderBy(F.desc("prefix")).limit(n)


def item_keys(latest: DataFrame, key: str, statuses: list[str] | None = None, excluded: list[str] | None = None, status: str = "status") -> DataFrame:
    """Keys of the items in some statuses; exclusion keeps items without a status."""
    rows = latest
    if statuses:
        rows = rows.filter(F.trim(status).isin(statuses))
    if excluded:
        rows = rows.filter(~F.coalesce(F.trim(status), F.lit("")).isin(excluded))
    return rows.select(key).distinct()


def corrupt(df: DataFrame) -> Column:
    """Some text column has the replacement character."""
    own = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return reduce(or_, [F.coalesce(F.contains(F.col(c), F.lit("�")), F.lit(False)) for c in own], F.lit(False))


def truthy(c: Column) -> Column:
    return F.lower(c.cast("string")).isin("true", "1")


def in_bbox(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def years_overlap(start: Column, end: Column, first: int | None, last: int | None) -> Column:
    """The span meets the wanted one; open ends count as endless."""
    test = F.lit(True)
    if first is not None:
        test &= end.isNull() | (end >= first)
    if last is not None:
        test &= start.isNull() | (start <= last)
    return test


def carrying_all(bridge: DataFrame, item: str, tag: str, wanted: list[str]) -> DataFrame:
    """Items that carry every one of the tags."""
    found = bridge.filter(F.col(tag).isin(wanted)).groupBy(item).agg(F.countDistinct(tag).alias("_n"))
    return found.filter(F.col("_n") == len(set(wanted))).select(item)


def identified(columns: list[Column], lists: list[Column], value: str) -> Column:
    """Some identifier equals the value, or some list of them has it."""
    return reduce(or_, [*(c == value for c in columns), *(F.array_contains(c, value) for c in lists)])


def facets(df: DataFrame, axes: dict[str, Column | None]) -> DataFrame:
    """Counts of each axis' values with every filter but that axis' own: axis, value, n.

    One pass: a row counts for an axis if it passes the other axes' filters.
    """
    tests = {a: F.lit(True) if t is None else F.coalesce(t, F.lit(False)) for a, t in axes.items()}
    marks = [F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value"), reduce(and_, [t for b, t in tests.items() if b != a], F.lit(True)).alias("ok")) for a in axes]
    rows = df.select(F.explode(F.array(*marks)).alias("m")).filter("m.ok")
    return rows.groupBy("m.axis", "m.value").agg(F.count(F.lit(1)).alias("n"))


def relaxed(df: DataFrame, filters: list[tuple[str, Column]], order: list[str]) -> tuple[DataFrame, list[str]]:
    """Filters dropped one by one in an order until a row is left; what was dropped."""
    kept, dropped = dict(filters), []
    for name in [None, *order]:
        if name is not None:
            if name not in kept:
                continue
            kept.pop(name)
            dropped.append(name)
        rows = df.filter(reduce(and_, kept.values(), F.lit(True)))
        if rows.limit(1).count():
            return rows, dropped
    return df.filter(reduce(and_, kept.values(), F.lit(True))), dropped


def top_with_other(counts: DataFrame, label: str, measures: list[str], order: str, n: int) -> DataFrame:
    """The first n - 1 labels by a measure, the rest summed up as 'other'. counts has a row for each label."""
    best = counts.orderBy(F.desc(order), F.asc(label)).limit(n - 1).select(label, F.lit(True).alias("_in"))
    named = counts.join(F.broadcast(best), label, "left").withColumn(label, F.when(F.col("_in"), F.col(label)).otherwise("other"))
    return named.groupBy(label).agg(*(F.sum(m).alias(m) for m in measures))
