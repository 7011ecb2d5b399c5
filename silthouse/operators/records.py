"""Records of uncertain shape: mapped fields, JSON objects, derived labels, spines with fallbacks, queues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a column's name must match to feed a field, the surest pattern first.
FIELDS = {
    "title": (r"^(title|subject|summary|נושא)$", r"title|subject|event|נושא|כותרת"),
    "start": (r"^(start|date|תאריך)$", r"start|begin|date|תאריך"),
    "end": (r"^(end|until)$", r"end|finish|סיום"),
    "location": (r"^(location|place|מיקום)$", r"location|place|where|מיקום"),
    "participants": (r"^(participants|attendees|משתתפים)$", r"participant|attendee|with|משתתפ"),
}
#: Words of a title and what they say.
FORMS = (("table", r"\btables?\b|לוח"), ("map", r"\bmaps?\b|מפה"), ("survey", r"\bsurveys?\b|סקר"), ("index", r"\bindex|מדד"))
FREQUENCIES = (("monthly", r"\bmonthly\b|חודשי"), ("quarterly", r"\bquarterly\b|רבעוני"), ("annual", r"\b(annual|yearly)\b|שנתי"), ("weekly", r"\bweekly\b|שבועי"))


def column_mapping(columns: list[str]) -> dict[str, tuple[str, float]]:
    """Each field's column and a confidence that falls with the pattern's place; a column feeds one field."""
    out: dict[str, tuple[str, float]] = {}
    for field, patterns in FIELDS.items():
        for k, p in enumerate(patterns):
            hit = next((c for c in columns if re.search(p, c.strip(), re.I) and c not in {x for x, _ in out.values()}), None)
            if hit:
                out[field] = (hit, round(1 - 0.3 * k, 2))
                break
    return out


def transformed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The mapped fields, and the other filled cells as a JSON object `other_fields`; rows without title or start go."""
    rest = [c for c in df.columns if c not in mapping.values()]
    filled = F.map_filter(F.create_map(*(x for c in rest for x in (F.lit(c), F.col(c).cast("string")))), lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "") if rest else F.create_map()
    rows = df.select(*(F.col(c).alias(f) for f, c in mapping.items()), F.to_json(filled).alias("other_fields"))
    return rows.filter((F.coalesce(F.trim("title"), F.lit("")) != "") & F.col("start").isNotNull())


def json_entries(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """One row for each entry of a JSON object kept as text: the kept columns, key, value. What is no object gives none."""
    return df.select(*keep, F.explode(F.from_json(text, "map<string,string>")).alias("key", "value"))


def labelled(c: Column, ladder: tuple[tuple[str, str], ...]) -> Column:
    """The first label of a ladder whose pattern a text has."""
    return F.coalesce(*(F.when(F.lower(c).rlike(p), label) for label, p in ladder))


def vintage(c: Column) -> Column:
    """The latest year that a text names."""
    years = F.transform(F.regexp_extract_all(c, F.lit(r"(?<![0-9])(19[5-9][0-9]|20[0-4][0-9])(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_max(years)


def series_key(c: Column) -> Column:
    """A title without years, digits and case: editions of a series share it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", " "), r"[\s,.:()/-]+", " "))


def size_band(rows: Column) -> Column:
    return F.when(rows.isNull(), "unknown").when(rows < 1000, "small").when(rows < 100_000, "medium").otherwise("large")


def calendar_window(day: Column, view: str) -> Column:
    """Struct first, last of a calendar page: a month padded to whole weeks from Sunday, a week, 4 days or a day."""
    sunday = lambda d: F.date_sub(d, F.dayofweek(d) - 1)
    first = {"month": sunday(F.trunc(day, "month")), "week": sunday(day)}.get(view, day)
    last = {"month": F.date_add(sunday(F.last_day(day)), 6), "week": F.date_add(sunday(day), 6), "4day": F.date_add(day, 3)}.get(view, day)
    return F.struct(first.alias("first"), last.alias("last"))


def crosswalk(rows: DataFrame, codes: DataFrame, names: DataFrame, code: str, name: str) -> DataFrame:
    """rows with target and match_kind: by the published code, else by the resolved name. codes: code, target; names: name, target; one row for each."""
    by = rows.join(codes.select(F.col("code").alias(code), F.col("target").alias("_c")), code, "left").join(names.select(F.col("name").alias(name), F.col("target").alias("_n")), name, "left")
    kind = F.when(F.col("_c").isNotNull(), "code").when(F.col("_n").isNotNull(), "name").otherwise("none")
    return by.withColumn("target", F.coalesce("_c", "_n")).withColumn("match_kind", kind).drop("_c", "_n")


def resolved_pairs(rows: DataFrame, pair: list[str], resolver: DataFrame) -> DataFrame:
    """Distinct pairs resolved once, then joined back: the resolver sees each spelling a single time."""
    found = rows.select(*pair).distinct().join(resolver, pair, "left")
    return rows.join(found, pair, "left")


def colliding(edges: DataFrame, mapping: DataFrame, kind: list[str]) -> DataFrame:
    """Edges that a merge would make equal to another one: all but the least of their new key. mapping: id, canonical; edges have an id."""
    moved = edges
    for s in ("src", "dst"):
        moved = moved.join(mapping.select(F.col("id").alias(s), F.col("canonical").alias(f"_{s}")), s, "left").withColumn(f"_{s}", F.coalesce(f"_{s}", s))
    key = ["_src", "_dst", *kind]
    least = moved.groupBy(*key).agg(F.min("id").alias("_id"))
    return moved.join(least, key).filter("id <> _id").select(*edges.columns)


def claims(wanted: DataFrame, holders: DataFrame, item: str, holder: str, items: str) -> DataFrame:
    """Each wanted item with the first holder (by name) whose list has it."""
    held = holders.select(F.col(holder).alias("_h"), F.explode(items).alias(item)).groupBy(item).agg(F.min("_h").alias("held_by"))
    return wanted.join(held, item, "left")


def accepted(candidates: DataFrame, key: str, places: DataFrame, own: str, metres: float, inside) -> DataFrame:
    """key, verdict of located answers: ok near a place of their own locality or where none is known, else wrong_locality.

    candidates: key, own, lon, lat; places: own, lon, lat. `inside` is the distance join.
    """
    known = candidates.join(places.select(own).distinct(), own, "left_semi").select(key).withColumn("_known", F.lit(True))
    other = places.withColumnRenamed(own, "_own")
    near = inside(candidates, other, metres).filter(F.col(own) == F.col("_own")).select(key).distinct().withColumn("_near", F.lit(True))
    rows = candidates.select(key).join(known, key, "left").join(near, key, "left")
    return rows.select(key, F.when(F.col("_near") | F.col("_known").isNull(), "ok").otherwise("wrong_locality").alias("verdict"))


def claim_order(tasks: DataFrame, capped: DataFrame, source: str) -> DataFrame:
    """Pending tasks of sources with room, in the order in which workers take them."""
    return tasks.filter("status = 'pending'").join(capped.select(source), source, "left_anti").orderBy(F.desc("priority"), "created_at", "id")


def one_of_family(df: DataFrame, title: str, size: str, n: int) -> DataFrame:
    """The largest row of each family of titles that differ in digits only; n families by size."""
    family = F.trim(F.regexp_replace(title, "[0-9]+", ""))
    best = df.groupBy(family.alias("family")).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(size), F.col(title))).alias("b"))
    return best.select("family", "b.*").orderBy(F.desc(size), "family").limit(n)


def source_load(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts by key of several tables side by side, 0 where a table has none."""
    out = None
    for name, df in parts.items():
        own = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = own if out is None else out.join(own, key, "full_outer")
    return out.fillna(0, list(parts))


def spine(newest: DataFrame, key: str, group: str) -> DataFrame:
    """A spine of keys with whether their shorter group key stands for several."""
    many = newest.groupBy(group).agg((F.countDistinct(key) > 1).alias("ambiguous"))
    return newest.join(many, group)


def mentions(events: DataFrame, ident: str, text: str, names: DataFrame, name: str, least: int = 3) -> DataFrame:
    """Events joined with the names whose words they have in a row: equi-joins on runs of words, one for each length of name."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    known = names.select(F.lower(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}]+", " "))).alias("plain"), F.col(name).alias("name")).filter(F.length("plain") >= least).withColumn("n", F.size(F.split("plain", " ")))
    rows = events.select(F.col(ident).alias("id"), words.alias("w"))
    lengths = sorted(r.n for r in known.select("n").distinct().collect())  # as many rows as there are lengths
    runs = F.flatten(F.transform(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda k: F.array_join(F.slice("w", k, n), " "))).otherwise(F.array().cast("array<string>"))))
    return rows.select("id", F.explode(F.array_distinct(runs)).alias("plain")).join(known, "plain").select("id", "name").distinct()
