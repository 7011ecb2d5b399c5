"""Points and polygons on lon/lat: cells for candidates, then exact tests."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silthouse.storage import written

EARTH_M = 6_371_008.8
LON_NAMES, LAT_NAMES = r"^(lon|lng|longitude|x|x_?coord.*|itm_?x)$", r"^(lat|latitude|y|y_?coord.*|itm_?y)$"
#: The GRS80 ellipsoid and the Israeli transverse Mercator grid.
_A, _F = 6378137.0, 1 / 298.257222101
_LAT0, _LON0, _K0, _X0, _Y0 = math.radians(31.734393611111), math.radians(35.204516944444), 1.0000067, 219529.584, 626907.390


def coordinate_columns(columns: list[str]) -> tuple[str, str] | None:
    """The first lon-like and lat-like names."""
    lon = next((c for c in columns if re.match(LON_NAMES, c, re.I)), None)
    lat = next((c for c in columns if re.match(LAT_NAMES, c, re.I)), None)
    return (lon, lat) if lon and lat else None


def oriented(x: Column, y: Column, west=33.0, east=37.0, south=29.0, north=34.0) -> Column:
    """Struct lon, lat, kind of a pair in either order, or of grid metres; null where it is neither."""
    ok = lambda a, b: a.between(west, east) & b.between(south, north)
    grid = x.between(100_000, 400_000) & y.between(350_000, 900_000)
    made = lambda lon, lat, kind: F.struct(lon.alias("lon"), lat.alias("lat"), F.lit(kind).alias("kind"))
    point = from_grid(x, y)
    return F.when(ok(x, y), made(x, y, "degrees")).when(ok(y, x), made(y, x, "swapped")).when(grid, made(point["lon"], point["lat"], "grid"))


#: The third flattening, the rectifying radius and the series of the grid, forwards and backwards, up to its third power.
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_OUT = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_ECC = 2 * math.sqrt(_N) / (1 + _N)
_XI0 = math.atan(math.sinh(math.atanh(math.sin(_LAT0)) - _ECC * math.atanh(_ECC * math.sin(_LAT0))))
_ORIGIN = _XI0 + sum(a * math.sin(2 * j * _XI0) for j, a in enumerate(_OUT, 1))


def from_grid(x: Column, y: Column) -> Column:
    """Struct lon, lat of grid metres: the inverse transverse Mercator series, as a Column expression."""
    xi, eta = (y - _Y0) / (_K0 * _RADIUS) + _ORIGIN, (x - _X0) / (_K0 * _RADIUS)
    u = xi - sum((F.sin(2 * j * xi) * F.cosh(2 * j * eta) * b for j, b in enumerate(_BACK, 1)), F.lit(0.0))
    v = eta - sum((F.cos(2 * j * xi) * F.sinh(2 * j * eta) * b for j, b in enumerate(_BACK, 1)), F.lit(0.0))
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi + sum((F.sin(2 * j * chi) * d for j, d in enumerate(_LATITUDE, 1)), F.lit(0.0))
    return F.struct(F.degrees(F.lit(_LON0) + F.atan2(F.sinh(v), F.cos(u))).alias("lon"), F.degrees(lat).alias("lat"))


def to_grid(lon: Column, lat: Column) -> Column:
    """Struct x, y in grid metres of a place in degrees: the transverse Mercator series."""
    sine, away = F.sin(F.radians(lat)), F.radians(lon) - _LON0
    t = F.sinh(F.atanh(sine) - _ECC * F.atanh(_ECC * sine))
    u, v = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    xi = u + sum((F.sin(2 * j * u) * F.cosh(2 * j * v) * a for j, a in enumerate(_OUT, 1)), F.lit(0.0))
    eta = v + sum((F.cos(2 * j * u) * F.sinh(2 * j * v) * a for j, a in enumerate(_OUT, 1)), F.lit(0.0))
    return F.struct((_X0 + _K0 * _RADIUS * eta).alias("x"), (_Y0 + _K0 * _RADIUS * (xi - _ORIGIN)).alias("y"))


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def _columns(band: Column, step: float, metres: float) -> Column:
    """Into how many cells a band of latitude is cut, so that points at most `metres` apart that are in or next to it lie in
    the same cell or in neighbours; near the poles there is one."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(band), F.abs(band + 1)) * step + step)
    half = math.sin(min(metres / (2 * EARTH_M), math.pi / 2))
    wide = F.degrees(2 * F.asin(F.least(F.lit(1.0), half / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12)))))
    return F.greatest(F.floor(360 / F.greatest(wide * (1 + 1e-9), F.lit(1e-9))), F.lit(1)).cast("long")


def _column(lon: Column, n: Column) -> Column:
    return F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n).cast("long"), n - 1)


def within(left: DataFrame, right: DataFrame, metres: float, inner: float = -1.0) -> DataFrame:
    """Pairs of rows (each with lon, lat) at most `metres` apart and more than `inner`: an equi-join on cells, then the distance.

    Cells are bands of latitude, each cut into as many cells as fit around the earth there, so the poles and the 180th
    meridian are no edges. Both sides need other column names except lon and lat, which the result has as lon, lat (of the
    left) and distance_m.
    """
    step = min(math.degrees(metres / EARTH_M) * (1 + 1e-9), 180.0) or 1e-9
    grown = left.withColumn("_cy", F.explode(F.array(*(_cell(F.col("lat"), step) + k for k in (-1, 0, 1)))))
    n = _columns(F.col("_cy"), step, metres)
    grown = grown.withColumn("_cx", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(_column(F.col("lon"), n) + k, n)))))
    own = right.withColumn("_cy", _cell(F.col("lat"), step))
    own = own.withColumn("_cx", _column(F.col("lon"), _columns(F.col("_cy"), step, metres))).withColumnRenamed("lon", "_lon").withColumnRenamed("lat", "_lat")
    pairs = grown.join(own, ["_cx", "_cy"]).withColumn("distance_m", distance_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")))
    return pairs.filter((F.col("distance_m") <= metres) & (F.col("distance_m") > inner)).drop("_cx", "_cy", "_lon", "_lat")


#: Halvings of the world in the grid of counts; its smallest cells have about 19 metres.
HALVINGS = 20


def reach(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """The rows of `left` with `_reach`: metres within which there are at least k rows of `right` for sure, from counts in a grid.

    Counts of the smallest cells are summed for the cells around them, at every size; a point takes the smallest of its
    cells that has k rows, and no two points of a cell are farther apart than its height and width along the ground.
    """
    cell = lambda v, top: F.floor((v + top) * (float(1 << HALVINGS) / 180.0)).cast("long")
    placed = lambda df: df.withColumn("_gx", cell(F.col("lon"), 180.0)).withColumn("_gy", cell(F.col("lat"), 90.0))
    sizes = F.explode(F.sequence(F.lit(0), F.lit(HALVINGS)))
    up = lambda c: F.call_function("shiftright", F.col(c), F.col("_up"))
    coarse = lambda df: df.withColumn("_up", sizes).withColumn("_ux", up("_gx")).withColumn("_uy", up("_gy"))
    counts = placed(right).groupBy("_gx", "_gy").agg(F.count(F.lit(1)).alias("_n"))
    full = coarse(counts).groupBy("_up", "_ux", "_uy").agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= k)
    cells = coarse(placed(left).select("_gx", "_gy").distinct()).join(full, ["_up", "_ux", "_uy"]).groupBy("_gx", "_gy").agg(F.min("_up").alias("_up"))
    half = math.pi * EARTH_M
    degrees = 2 * 180.0 * F.pow(F.lit(2.0), F.col("_up") - HALVINGS)
    metres = F.coalesce(F.least(F.lit(half), F.radians(degrees) * EARTH_M * (1 + 1e-9) + 1e-6), F.lit(half))
    return placed(left).join(cells, ["_gx", "_gy"], "left").withColumn("_reach", metres).drop("_gx", "_gy", "_up")


def nearest(left: DataFrame, key: str, right: DataFrame, target: str, k: int = 1, most: float | None = None) -> DataFrame:
    """key, target, distance_m, rank of the k nearest rows of `right` for each of `left`, equal distances by target; fewer where
    there are fewer, or within `most` metres.

    Each point is joined once, within its reach: points are dealt to classes of reach (powers of two), one distance join each.
    A far-off point costs one wide ring, and the others nothing.
    """
    rows = written(reach(left.select(key, "lon", "lat"), right.select("lon", "lat"), k).withColumn("_class", F.ceil(F.log2(F.greatest("_reach", F.lit(1.0)))).cast("int")), "reach")
    near, half = None, math.pi * EARTH_M
    for row in rows.select("_class").distinct().orderBy("_class").collect():  # at most one for each halving
        metres = min(2.0 ** row["_class"], half, half if most is None else most)
        own = rows.filter(F.col("_class") == row["_class"]).select(key, "lon", "lat")
        found = within(own, right.select(target, "lon", "lat"), metres).select(key, target, "distance_m")
        near = found if near is None else near.unionByName(found)
    if near is None:
        near = left.select(key).join(right.select(target), F.lit(False)).withColumn("distance_m", F.lit(0.0))
    ranked = Window.partitionBy(key).orderBy("distance_m", target)
    return near.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def parse_wkt(text: str | None) -> list[list[tuple[float, float]]] | None:
    """Rings of a POLYGON or MULTIPOLYGON, points of a POINT or LINESTRING as one ring; None if it can't be read."""
    if not text or not re.match(r"^\s*(SRID=\d+;)?\s*(POINT|LINESTRING|POLYGON|MULTIPOLYGON)\s*Z?\s*\(", text, re.I):
        return None
    try:
        return [[(float(p.split()[0]), float(p.split()[1])) for p in ring.split(",")] for ring in re.findall(r"\(([^()]+)\)", text)] or None
    except (ValueError, IndexError):
        return None


def inside(x: np.ndarray, y: np.ndarray, rings: list[list[tuple[float, float]]]) -> np.ndarray:
    """Which points lie inside: even-odd crossings over all rings."""
    odd = np.zeros(len(x), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y1 != y2:
                odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return odd


def interior_point(rings: list[list[tuple[float, float]]]) -> tuple[float, float]:
    """A point inside: the middle of the widest span that a level line has in the polygon."""
    ys = sorted({p[1] for r in rings for p in r})
    y = (ys[len(ys) // 2 - 1] + ys[len(ys) // 2]) / 2 if len(ys) > 1 else ys[0]
    cuts = sorted(x1 + (y - y1) * (x2 - x1) / (y2 - y1) for r in rings for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]], strict=True) if (y1 > y) != (y2 > y))
    spans = list(zip(cuts[::2], cuts[1::2], strict=False))
    a, b = max(spans, key=lambda s: s[1] - s[0]) if spans else (rings[0][0][0],) * 2
    return (a + b) / 2, y


def interior(wkt: Column) -> Column:
    """Struct lon, lat of a point inside a polygon's text; null where it can't be read."""

    @F.pandas_udf("lon double, lat double")
    def run(texts: pd.Series) -> pd.DataFrame:
        points = [interior_point(rings) if (rings := parse_wkt(t)) else (None, None) for t in texts]
        return pd.DataFrame(points, columns=["lon", "lat"], dtype="float64")

    point = run(wkt)
    return F.when(point["lon"].isNotNull(), point)


def first_polygon(joined: DataFrame, point: str, order: str) -> DataFrame:
    """One polygon for each point."""
    own = Window.partitionBy(point).orderBy(order)
    return joined.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


def geojson(df: DataFrame, lon: str = "lon", lat: str = "lat", digits: int = 7) -> Column:
    """A GeoJSON feature of each row, its other columns as properties."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(F.col(lon), digits), F.round(F.col(lat), digits)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties")))


def wkt_kind(wkt: Column) -> Column:
    """degrees or grid by the first number of a geometry text; null if it is neither."""
    first = F.regexp_extract(F.substring(wkt, 1, 120), r"(-?[0-9]+\.?[0-9]*)", 1).try_cast("double")
    return F.when(first.between(33, 37), "degrees").when(first.between(100_000, 400_000), "grid")


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A line with the points that matter: those farther than a tolerance from the chord of what is kept around them."""
    keep = {0, len(points) - 1}
    left = [(0, len(points) - 1)]
    while left:
        a, b = left.pop()
        (x1, y1), (x2, y2) = points[a], points[b]
        length = math.hypot(x2 - x1, y2 - y1)
        off = [(abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / length if length else math.hypot(x - x1, y - y1), k) for k, (x, y) in enumerate(points[a + 1 : b], a + 1)]
        far, k = max(off, default=(0.0, a))
        if far > tolerance:
            keep.add(k)
            left += [(a, k), (k, b)]
    return [points[k] for k in sorted(keep)]


def simplify(wkt: Column, tolerance: float) -> Column:
    """Polygons as WKT with fewer points; rings that would vanish stay as they are, texts that can't be read are null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            rings = parse_wkt(text)
            own = [s if len(s := simplified(r, tolerance)) >= 4 else r for r in rings or []]
            out.append("POLYGON(" + ", ".join("(" + ", ".join(f"{x:.10g} {y:.10g}" for x, y in r) + ")" for r in own) + ")" if rings else None)
        return pd.Series(out, dtype="object")

    return run(wkt)


def point_wkt(lon: Column, lat: Column, digits: int = 6) -> Column:
    """POINT text of a place, null where a part is."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.format_string(f"POINT(%.{digits}f %.{digits}f)", lon.cast("double"), lat.cast("double")))


def z_order(lon: Column, lat: Column, bits: int = 15) -> Column:
    """A number whose bits are those of the cells of lon and lat in turn, lon first: near places mostly have near numbers.

    As many bits for each, null where a part is; sort or range-partition by it to keep places together.
    """
    top = (1 << bits) - 1
    x = F.greatest(F.lit(0), F.least(F.lit(top), F.floor((lon + 180) / 360 * (1 << bits)))).cast("long")
    y = F.greatest(F.lit(0), F.least(F.lit(top), F.floor((lat + 90) / 180 * (1 << bits)))).cast("long")
    bit = lambda v, k: F.shiftright(v, k).bitwiseAND(F.lit(1))
    mixed = sum((F.shiftleft(bit(x, k), 2 * k + 1) + F.shiftleft(bit(y, k), 2 * k) for k in range(bits)), F.lit(0).cast("long"))
    return F.when(lon.isNotNull() & lat.isNotNull(), mixed)


def geohash(lon: Column, lat: Column) -> Column:
    """The six characters of a place's geohash."""
    z, digits = z_order(lon, lat, 15), F.lit("0123456789bcdefghjkmnpqrstuvwxyz")
    return F.concat(*(F.substring(digits, (F.shiftright(z, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(5, -1, -1)))

