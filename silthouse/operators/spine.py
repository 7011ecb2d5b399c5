"""Streets and addresses: one street for each town and name, one address for each door, assets folded onto parcels, the queue of doors to locate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silthouse.functions.text import as_int, house_number, house_suffix, norm, strip_type

UNKNOWN = "?"


def folded_assets(assets: DataFrame, parcels: DataFrame, block: str, parcel: str, count: dict[str, Column]) -> DataFrame:
    """Assets summed up for each block and parcel, on every parcel of the spine with that pair (parcel_key, gp_key).

    Rows whose block or parcel is no number are left out. The sums come before the join, whose left side then has
    one row for each pair.
    """
    key = F.concat_ws("-", as_int(F.col(block)), as_int(F.col(parcel)))
    rows = assets.filter(as_int(F.col(block)).isNotNull() & as_int(F.col(parcel)).isNotNull()).withColumn("gp_key", key)
    return parcels.select("parcel_key", "gp_key").join(rows.groupBy("gp_key").agg(*(c.alias(n) for n, c in count.items())), "gp_key")


def street_universe(sources: dict[str, DataFrame]) -> DataFrame:
    """street_key, town, name, n, in_<source>: the streets that some sources (town, name) list, spellings with one normal form being one street.

    Its name is the spelling with the most rows, of equals the first in order. Empty and unknown names are no streets.
    """
    both = None
    for label, df in sources.items():
        own = df.filter(F.coalesce(norm(F.col("name")), F.lit("")) != "").filter("town is not null").groupBy("town", "name").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(label))
        both = own if both is None else both.unionByName(own)
    spelled = both.groupBy("town", "name").agg(F.max("n").alias("n"), *(F.bool_or(F.col("source") == s).alias(f"in_{s}") for s in sources))
    key = F.concat_ws("|", "town", norm(F.col("name"))).alias("street_key")
    best = F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("b")
    out = spelled.groupBy(key, "town").agg(best, *(F.bool_or(f"in_{s}").alias(f"in_{s}") for s in sources))
    return out.select("street_key", "town", "b.name", (-F.col("b.n")).alias("n"), *(f"in_{s}" for s in sources))


def street_keys(pairs: DataFrame, aliases: DataFrame, types: list[str]) -> DataFrame:
    """The distinct (town, name) pairs with their street `key`, null where none is known.

    The name as it is counts before the name without its street type, then the weight, then the lower key.
    aliases: town, variant, key, weight.
    """
    names = pairs.select("town", "name").distinct()
    tries = F.array(F.struct(F.lit(1).alias("tier"), norm(F.col("name")).alias("variant")), F.struct(F.lit(2).alias("tier"), norm(strip_type(F.col("name"), types)).alias("variant")))
    hit = names.select("town", "name", F.explode(tries).alias("t")).select("town", "name", "t.*").join(aliases.select("town", "variant", "key", "weight"), ["town", "variant"])
    best = hit.groupBy("town", "name").agg(F.min(F.struct("tier", (-F.col("weight")).alias("w"), "key"))["key"].alias("key"))
    return names.join(best, ["town", "name"], "left")


def unmatched_streets(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """town, name, rows of the spellings that have no street."""
    missing = keyed.filter("key is null").select("town", "name")
    return pairs.groupBy("town", "name").agg(F.count(F.lit(1)).alias("rows")).join(missing, ["town", "name"], "left_semi")


def address_spine(rows: DataFrame) -> DataFrame:
    """One row for each door of address rows: town, street, street_key, house, entrance, zip5, zip7, lon, lat, source.

    Doors are told apart by town, street, house number with its letter, and entrance. A row without a street key takes its own zip, else
    its place, else its text for one, so that doors of unknown streets don't fall together. Zip and place are the least that
    the door's rows have; `sources` lists who has it. Rows without a town are left out.
    """
    place = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.format_string("xy:%.6f,%.6f", "lat", "lon"))
    part = F.coalesce("street_key", F.concat(F.lit("zip:"), "zip7"), place, F.concat(F.lit("raw:"), F.coalesce("street", F.lit(""))))
    own = rows.filter("town is not null").withColumn("part", part).withColumn("house_num", house_number(F.col("house"))).withColumn("suffix", house_suffix(F.col("house")))
    key = F.concat_ws("|", "town", "part", F.concat(F.coalesce(F.col("house_num").cast("string"), F.lit(UNKNOWN)), F.coalesce("suffix", F.lit(""))), F.coalesce("entrance", F.lit("")))
    at = F.min(F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct("lon", "lat"))).alias("at")
    doors = own.groupBy(key.alias("address_key"), "town", "street_key", "house_num", "suffix").agg(
        F.min(F.when(F.col("street") != UNKNOWN, F.col("street"))).alias("street"), F.max("zip5").alias("zip5"), F.max("zip7").alias("zip7"), at, F.array_sort(F.collect_set("source")).alias("sources")
    )
    level = F.when(F.col("zip7").isNotNull(), "address").alias("zip_level")
    return doors.select("address_key", "town", "street_key", "street", "house_num", "suffix", "zip5", "zip7", level, "at.lon", "at.lat", "sources")


def with_zip_tiers(doors: DataFrame, town_zips: DataFrame) -> DataFrame:
    """Doors without a zip take their town's, else the area code (zip5) that all doors of their street share.

    town_zips: town, zip5, zip7, one row for each town that has a single zip. A street with several area codes gives
    none, and the seven digits of another door are never taken: they name a house.
    """
    known = town_zips.filter("zip7 is not null").select("town", F.col("zip5").alias("_z5"), F.col("zip7").alias("_z7"))
    fill = F.col("zip7").isNull() & F.col("_z7").isNotNull()
    out = doors.join(known, "town", "left").select(
        *(c for c in doors.columns if c not in ("zip5", "zip7", "zip_level")),
        F.when(fill, F.coalesce("zip5", "_z5")).otherwise(F.col("zip5")).alias("zip5"),
        F.coalesce("zip7", "_z7").alias("zip7"),
        F.when(fill, "locality").otherwise(F.col("zip_level")).alias("zip_level"),
    )
    shared = out.filter("zip5 is not null and street_key is not null").groupBy("town", "street_key").agg(F.min("zip5").alias("_s"), F.max("zip5").alias("_t")).filter("_s = _t").drop("_t")
    near = F.col("zip7").isNull() & F.col("zip5").isNull() & F.col("_s").isNotNull()
    put = out.join(shared, ["town", "street_key"], "left").withColumn("zip_level", F.when(near, "street").otherwise(F.col("zip_level"))).withColumn("zip5", F.coalesce("zip5", F.when(near, F.col("_s"))))
    return put.select(*doors.columns)


def to_locate(doors: DataFrame, asked: DataFrame, today: str, attempts: int = 3, days: int = 30) -> DataFrame:
    """address_key, asked_before of doors still worth asking for: named and without a place, never asked, or missed fewer times than `attempts`, `days` ago or more.

    asked: address_key, status, attempts, asked_on, one row for each. In the order of the queue: those never asked come first.
    """
    named = doors.filter("lon is null and street is not null and house_num is not null and town is not null").select("address_key")
    rows = named.join(asked.select("address_key", "status", "attempts", "asked_on"), "address_key", "left")
    due = ~F.col("status").isin("hit", "wrong_locality") & (F.col("attempts") < attempts) & (F.col("asked_on") < F.date_sub(F.lit(today).cast("date"), days))
    rows = rows.filter(F.col("status").isNull() | due).select("address_key", F.col("status").isNotNull().alias("asked_before"))
    return rows.orderBy("asked_before", "address_key")


def without_misses(asked: DataFrame, burned: int | None = None) -> DataFrame:
    """The answers without misses, which so return to the queue; with `burned`, without those of that many attempts. Hits stay."""
    miss = F.col("status") == "not_found"
    return asked.filter(~F.coalesce(miss if burned is None else miss & (F.col("attempts") >= burned), F.lit(False)))


def harvested(columns: list[tuple[str, str, DataFrame]], aliases: DataFrame) -> DataFrame:
    """code, surface, table, column, rows: the spellings under which known places stand in some columns.

    columns: table, column, its rows. Values are counted before they are looked up.
    """
    counts = None
    for table, column, df in columns:
        own = df.select(F.trim(F.col(column).cast("string")).alias("surface")).filter("surface <> ''").groupBy("surface").agg(F.count(F.lit(1)).alias("rows")).select("surface", F.lit(table).alias("table"), F.lit(column).alias("column"), "rows")
        counts = own if counts is None else counts.unionByName(own)
    return counts.withColumn("variant", norm(F.col("surface"))).join(aliases.select("variant", "code"), "variant").drop("variant").select("code", "surface", "table", "column", "rows")


def sniffed(q: Column) -> Column:
    """Struct mode, a, b, other of a search text: point (lat, lon in either order), parcel (block, parcel), zip, block, address or empty.

    Five digits may be a zip or a block: `other` names the second reading.
    """
    text = F.trim(F.coalesce(q, F.lit("")))
    pair, lot, digits = r"^(-?[0-9]{1,3}\.[0-9]+)\s*[,;\s]\s*(-?[0-9]{1,3}\.[0-9]+)$", r"^(?:block\s+|גוש\s+)?([0-9]{1,6})\s*(?:/|,?\s*parcel\s+|,?\s*חלקה\s+)\s*([0-9]{1,5})$", r"^[0-9]{1,7}$"
    part = lambda pattern, k: F.regexp_extract(text, pattern, k).try_cast("double")
    made = lambda mode, a, b, other=None: F.struct(F.lit(mode).alias("mode"), a.cast("double").alias("a"), b.cast("double").alias("b"), F.lit(other).cast("string").alias("other"))
    none = F.lit(None)
    return (
        F.when(text == "", made("empty", none, none))
        .when(text.rlike(pair), made("point", F.least(part(pair, 1), part(pair, 2)), F.greatest(part(pair, 1), part(pair, 2))))
        .when(text.rlike(lot), made("parcel", part(lot, 1), part(lot, 2)))
        .when(text.rlike(digits) & (F.length(text) == 7), made("zip", text.try_cast("double"), none))
        .when(text.rlike(digits) & (F.length(text) == 5), made("zip", text.try_cast("double"), none, "block"))
        .when(text.rlike(digits), made("block", text.try_cast("double"), none))
        .otherwise(made("address", none, none))
    )


def doors_at(doors: DataFrame, zip_code: str | None = None, street_key: str | None = None, house: int | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Doors by zip (five or seven digits), street and house, or in a box of west, south, east, north; what is None doesn't matter."""
    tests = []
    if zip_code is not None:
        tests.append(F.col("zip7" if len(zip_code) == 7 else "zip5") == zip_code)
    if street_key is not None:
        tests.append(F.col("street_key") == street_key)
    if house is not None:
        tests.append(F.col("house_num") == house)
    if box is not None:
        tests += [F.col("lon").between(box[0], box[2]), F.col("lat").between(box[1], box[3])]
    for t in tests:
        doors = doors.filter(t)
    return doors
