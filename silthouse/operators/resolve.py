"""Messy names to keys: weighted aliases, blocked likeness, registries, same-day matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silthouse.functions.text import block_key, jaccard, name_tokens, no_parens, norm, plain_name, similarity, strip_type_key
from silthouse.operators.graph import clusters
from silthouse.operators.likeness import registry_pairs, word_pairs
from silthouse.storage import written

#: Weights of a place's aliases.
PLACE_WEIGHTS = {"official": 100, "no_paren": 90, "english": 70, "translit": 70, "admin_prefix": 55, "prefix": 50}
#: What stands before a Hebrew place name, a preposition or its kind of authority, both in normal form.
PREFIXES = ("ה", "ו", "ב", "ל", "מ", "כ", "ש", "וה", "ול", "וב", "ומ", "וכ", "כש", "מה", "שב", "של", "שה", "לכ")
ADMIN_PREFIXES = ("עיריית", "עירית", "מועצהמקומית", "מועצהאזורית", "מא", "ממ", "מועצה")
#: Weights of a street's aliases.
STREET_WEIGHTS = {"official": 100, "no_paren": 90, "no_type": 85, "no_article": 70, "token_set": 60, "last_token": 40}
#: Weights of spellings that an official file or the post publishes.
PUBLISHED_WEIGHTS = {"official_file": 100, "official_synonym": 92, "postal_synonym": 92}
#: Words that say what kind of street it is.
STREET_TYPES = (
    "רחוב", "רח", "שדרות", "שדרה", "שד", "סמטה", "סמטת", "דרך", "כיכר", "ככר", "כיכרת", "משעול", "מעלה", "מורד", "נתיב", "מבוא",
    "מעבר", "טיילת", "גשר", "רחבת", "רחבה", "שכונת", "שכונה", "כביש", "street", "st", "road", "rd",
)


def place_aliases(places: DataFrame, code: str, name: str, english: str | None = None, translit: str | None = None) -> DataFrame:
    """variant, code, surface, kind, weight: the spellings under which a place is known.

    Hebrew names also stand behind prepositions and kinds of authorities. Empty and null names have no variants.
    """

    def alias(variant: Column, surface: Column, kind: str) -> Column:
        return F.struct(variant.alias("variant"), surface.alias("surface"), F.lit(kind).alias("kind"), F.lit(PLACE_WEIGHTS[kind]).alias("weight"))

    def behind(c: Column) -> Column:
        near = F.transform(F.array(*map(F.lit, PREFIXES)), lambda p: alias(F.concat(p, norm(c)), F.concat(p, c), "prefix"))
        office = F.transform(F.array(*map(F.lit, ADMIN_PREFIXES)), lambda p: alias(F.concat(p, norm(c)), c, "admin_prefix"))
        return F.filter(F.concat(near, office), lambda x: norm(c).rlike("[א-ת]"))

    own = [("official", F.trim(F.col(name))), ("no_paren", no_parens(F.col(name)))]
    latin = [(k, F.trim(F.col(c))) for k, c in (("english", english), ("translit", translit)) if c]
    rows = F.concat(F.array(*(alias(norm(c), c, k) for k, c in own + latin)), *(behind(c) for _, c in own))
    return best_alias(places.select(F.col(code).alias("code"), F.explode(rows).alias("a")).select("a.variant", "code", "a.surface", "a.kind", "a.weight"), ["variant", "code"])


def street_ladder(name: Column, types: tuple[str, ...] = STREET_TYPES) -> Column:
    """Array of (variant, kind, weight), strongest first: the spellings under which a street's name may be found.

    Brackets and the street type go separately and together; of each of these keys, a leading article goes where 4 or more
    letters are there. The words count in any order, and the last one alone from 4 letters on. Keys have 2 letters or more;
    one that comes twice has its stronger kind. Null without a name.
    """
    base, bare = norm(name), norm(no_parens(name))
    words = F.transform(F.regexp_extract_all(no_parens(name), F.lit("[0-9A-Za-zא-ת]+"), F.lit(0)), lambda w: F.lower(w))
    last = F.try_element_at(words, F.lit(-1))
    keys = [base, bare, strip_type_key(base, types), strip_type_key(bare, types)]
    rungs = list(zip(("official", "no_paren", "no_type", "no_type"), keys, strict=True))
    rungs += [("no_article", F.when(k.startswith("ה") & (F.length(k) >= 4), F.substring(k, F.lit(2), F.length(k)))) for k in keys]
    rungs += [("token_set", F.when(F.size(words) > 1, F.array_join(F.array_sort(words), ""))), ("last_token", F.when((F.size(words) > 1) & (F.length(last) >= 4), last))]
    every = F.array(*(F.struct(k.alias("variant"), F.lit(kind).alias("kind"), F.lit(STREET_WEIGHTS[kind]).alias("weight")) for kind, k in rungs))
    known = F.filter(every, lambda x: F.length(x["variant"]) > 1)
    return F.filter(known, lambda x, i: F.array_position(known["variant"], x["variant"]) == i + 1)


def street_aliases(streets: DataFrame, town: str, key: str, name: str, types: tuple[str, ...] = STREET_TYPES) -> DataFrame:
    """variant, town, key, kind, weight of each street: the ladders of its names, the strongest kind of each variant."""
    flat = streets.select(F.col(town).alias("town"), F.col(key).alias("key"), F.explode(street_ladder(F.col(name), types)).alias("a")).select("a.variant", "town", "key", "a.kind", "a.weight")
    return best_alias(flat, ["variant", "town", "key"])


def published_aliases(streets: DataFrame, official: DataFrame) -> DataFrame:
    """variant, town, key, kind, weight of an official file's spellings (town, code, name, status) of streets (town, code, key).

    A status that starts with "official" stands like a street's own name, any other is a synonym. A code of no street gives none.
    """
    kind = F.when(F.lower(F.trim("status")).startswith("official"), "official_file").otherwise("official_synonym")
    rows = official.join(streets.filter("code is not null").groupBy("town", "code").agg(F.min("key").alias("key")), ["town", "code"])
    weights = F.create_map(*(F.lit(x) for pair in PUBLISHED_WEIGHTS.items() for x in pair))
    return best_alias(rows.select(norm(F.col("name")).alias("variant"), "town", "key", kind.alias("kind")).withColumn("weight", weights[F.col("kind")]), ["variant", "town", "key"])


def _strongest(aliases: DataFrame) -> DataFrame:
    """One row for each (town, variant): the key of the highest weight, null where two keys have it."""
    each = aliases.groupBy("town", "variant", "weight").agg(F.countDistinct("key").alias("_n"), F.min("key").alias("key"))
    best = each.groupBy("town", "variant").agg(F.max_by(F.struct("key", "_n"), "weight").alias("_b"), F.max("weight").alias("weight"))
    return best.select("town", "variant", F.when(F.col("_b._n") == 1, F.col("_b.key")).alias("key"), "weight")


def settled_streets(aliases: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """town, variant, key, weight: the one street that a spelling stands for in a town. A tie of two streets stands for none.

    synonyms (town, name, synonym) have no code: both spellings name the street that `name` stands for, or where nothing has that
    spelling, `synonym`. A spelling that stands for two streets passes nothing on.
    """
    aliases = aliases.select("town", "variant", "key", "weight")
    best = _strongest(aliases)
    if synonyms is not None:
        pairs = synonyms.select("town", norm(F.col("name")).alias("n"), norm(F.col("synonym")).alias("s")).filter("n <> '' and s <> '' and n <> s").distinct()
        known = best.select("town", "variant", F.struct("key").alias("hit"))
        of = pairs.join(known.withColumnsRenamed({"variant": "n", "hit": "_n"}), ["town", "n"], "left").join(known.withColumnsRenamed({"variant": "s", "hit": "_s"}), ["town", "s"], "left")
        more = of.select("town", F.explode(F.array("n", "s")).alias("variant"), F.coalesce("_n", "_s")["key"].alias("key")).filter("key is not null")
        best = _strongest(aliases.unionByName(more.withColumn("weight", F.lit(PUBLISHED_WEIGHTS["postal_synonym"]))))
    return best.filter("key is not null")


def matched_streets(names: DataFrame, settled: DataFrame, types: tuple[str, ...] = STREET_TYPES) -> DataFrame:
    """The distinct (town, name) pairs with the `key` and `kind` of the strongest rung of a name's ladder that stands for a street."""
    own = names.select("town", "name").distinct()
    tries = own.select("town", "name", F.posexplode(street_ladder(F.col("name"), types)).alias("at", "a")).select("town", "name", "at", "a.variant", "a.kind")
    hit = tries.join(settled.select("town", "variant", "key"), ["town", "variant"]).groupBy("town", "name").agg(F.min(F.struct("at", "key", "kind")).alias("b"))
    return own.join(hit, ["town", "name"], "left").select("town", "name", "b.key", "b.kind")


def best_alias(aliases: DataFrame, key: list[str]) -> DataFrame:
    """The highest weight of each key, ties by the remaining columns."""
    rest = [c for c in aliases.columns if c not in (*key, "weight")]
    best = aliases.filter("variant <> ''").groupBy(*key).agg(F.min(F.struct((-F.col("weight")).alias("_w"), *rest)).alias("_b"))
    return best.select(*key, *(F.col(f"_b.{c}").alias(c) for c in rest), (-F.col("_b._w")).alias("weight"))


def unambiguous(aliases: DataFrame, scope: list[str], target: str) -> DataFrame:
    """One target for each variant of a scope: the strictly strongest. Two targets at the highest weight give none."""
    top = aliases.groupBy(*scope).agg(F.max("weight").alias("weight"))
    held = aliases.join(top, [*scope, "weight"]).groupBy(*scope, "weight").agg(F.countDistinct(target).alias("_n"), F.min(target).alias(target))
    return held.filter("_n = 1").drop("_n")


def spelling_swaps(aliases: DataFrame, a: str = "ת", b: str = "ט", weight: int = 30) -> DataFrame:
    """variant, code, weight with one letter taken for another once or twice; real and ambiguous variants are left out."""

    def swapped(text: Column, at: Column) -> Column:
        letter = F.translate(F.substring(text, at, F.lit(1)), a + b, b + a)
        return F.concat(F.substring(text, F.lit(1), at - 1), letter, F.substring(text, at + 1, F.length(text)))

    variant = F.col("variant")
    at = F.filter(F.sequence(F.lit(1), F.length(variant)), lambda i: F.substring(variant, i, F.lit(1)).isin(a, b))
    once = F.transform("_at", lambda i: swapped(variant, i))
    twice = F.flatten(F.transform("_at", lambda i: F.transform(F.filter("_at", lambda j: j > i), lambda j: swapped(swapped(variant, i), j))))
    made = aliases.filter("variant <> ''").withColumn("_at", at).select("code", F.explode(F.array_distinct(F.concat(once, twice))).alias("variant")).distinct()
    single = made.groupBy("variant").agg(F.min("code").alias("code"), F.countDistinct("code").alias("_n")).filter("_n = 1").drop("_n")
    return single.join(aliases.select("variant").distinct(), "variant", "left_anti").withColumn("weight", F.lit(weight))


def resolved(names: DataFrame, name: str, *ladders: tuple[str, DataFrame]) -> DataFrame:
    """The rows with `code` and `matched` by the first of some alias tables (variant, code) that has the name.

    Distinct names are resolved once and joined back.
    """
    keys = names.select(norm(F.col(name)).alias("variant")).distinct()
    for label, aliases in ladders:
        keys = keys.join(aliases.select("variant", F.col("code").alias(f"_{label}")), "variant", "left")
    code = F.coalesce(*(F.col(f"_{label}") for label, _ in ladders))
    label = F.coalesce(*(F.when(F.col(f"_{label}").isNotNull(), label) for label, _ in ladders), F.lit("unmatched"))
    keys = keys.select("variant", code.alias("code"), label.alias("matched"))
    return names.withColumn("variant", norm(F.col(name))).join(keys, "variant", "left").drop("variant")


def genuine_column(counts: DataFrame, known: DataFrame, share: float = 0.4, least: int = 3) -> DataFrame:
    """column, values, resolved, genuine: of (column, value) pairs, whether enough of a column's values are known variants."""
    rows = counts.filter(F.trim("value") != "").select("column", norm(F.col("value")).alias("variant")).distinct()
    hit = rows.join(known.select("variant").distinct().withColumn("_hit", F.lit(1)), "variant", "left")
    out = hit.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.count("_hit").alias("resolved"))
    return out.withColumn("genuine", (F.col("resolved") >= least) & (F.col("resolved") >= share * F.col("values")))


def blocked_pairs(names: DataFrame, ident: str, name: str, least: float = 0.85, block: Column | None = None, organisation: bool = False) -> DataFrame:
    """a, b, score of alike names of a block, a below b.

    Names with equal tokens are collapsed to the least id before, and linked to it. Others need a share of equal tokens to
    reach `least`, which must be above 0.6: they meet by their rarest tokens, and no block is compared in full.
    """
    if least <= 0.6:
        raise ValueError("names without a common token can be alike below 0.6: least must be above it")
    rows = names.select(F.col(ident).alias("id"), F.col(name).alias("name"), name_tokens(F.col(name), organisation).alias("tokens"), (block if block is not None else F.lit(0)).alias("scope"))
    rows = rows.withColumn("k", block_key(F.col("tokens"))).filter("size(tokens) > 0")
    same = rows.groupBy("scope", "k", "tokens").agg(F.min("id").alias("id"), F.min_by("name", "id").alias("name"))
    members = rows.join(same.select(F.col("scope").alias("_scope"), "k", "tokens", F.col("id").alias("_least"), F.col("name").alias("_name")), ["k", "tokens"])
    members = members.filter(F.col("scope").eqNullSafe(F.col("_scope"))).filter("id <> _least")
    inner = members.select(F.col("_least").alias("a"), F.col("id").alias("b"), similarity(F.col("_name"), F.col("name"), F.col("tokens"), F.col("tokens"), organisation).alias("score"))
    share = (least - 0.6) / 0.4
    if organisation is not False:  # an organisation's tokens may be half of the other's
        share = min(share, 0.5)
    score = similarity(F.col("x.name"), F.col("y.name"), F.col("x.tokens"), F.col("y.tokens"), organisation)
    outer = word_pairs(same, ["scope", "k"], "tokens", share).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), score.alias("score"))
    return inner.unionByName(outer).filter(F.col("score") >= least)


def duplicate_clusters(pairs: DataFrame, least: float = 0.85) -> DataFrame:
    return clusters(pairs.filter(F.col("score") >= least))


def two_pass_registry(names: DataFrame, registry: DataFrame, ident: str, name: str, number: str, least: float = 0.85, prefix: int = 3, clean: Callable[[Column], Column] = plain_name) -> DataFrame:
    """id, number, score, how: the registry entry with the equal normal name, else the one of the highest registry score of
    `least` or more with the same first letters; ties by the least number.

    clean: the normal form. Entries without a number and names of less than two characters match nothing.
    """
    left = names.select(F.col(ident).alias("id"), clean(F.col(name)).alias("plain")).filter("length(plain) > 1")
    right = registry.select(F.col(number).alias("number"), clean(F.col(name)).alias("plain")).filter("number is not null").groupBy("plain").agg(F.min("number").alias("number"))
    right = written(right, "known")
    # all joins are by merging: a file of names is far smaller than its rows, which the driver would hold to broadcast them
    seen = written(left.hint("merge").join(right, "plain", "left"), "registry")
    exact = seen.filter("number is not null").select("id", "number", F.lit(1.0).alias("score"), F.lit("exact").alias("how"))
    rest = seen.filter("number is null").select("id", "plain")
    pairs = registry_pairs(rest, right, least, prefix=prefix).hint("merge").join(right.withColumnRenamed("plain", "b"), "b")
    best = pairs.groupBy(F.col("a").alias("plain")).agg(F.min(F.struct((-F.round("score", 6)).alias("s"), "number")).alias("b")).select("plain", "b.number", (-F.col("b.s")).alias("score"))
    return exact.unionByName(rest.hint("merge").join(best, "plain").select("id", "number", "score", F.lit("fuzzy").alias("how")))


def same_day_matches(events: DataFrame, ident: str, source: str, day: str, title: str, least: float = 0.65) -> DataFrame:
    """a, b, score: for each event the most alike title of other sources on the same day.

    Events with the same day, source and tokens are one title, with the least of their ids. Titles meet if they
    share one of their rarest tokens (as many as must hold one that both have, at `least`), not for being of a day.
    """
    rows = events.select(F.col(ident).alias("id"), F.col(source).alias("source"), F.col(day).alias("day"), F.array_sort(F.array_distinct(F.split(plain_name(F.col(title)), " "))).alias("tokens"))
    titles = written(rows.groupBy("day", "source", "tokens").agg(F.min("id").alias("id")), "titles")
    often = titles.select("day", F.explode("tokens").alias("token")).groupBy("day", "token").agg(F.count(F.lit(1)).alias("n"))
    ranked = titles.select("id", "day", F.explode("tokens").alias("token")).join(often, ["day", "token"]).groupBy("id", "day").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("rare"))
    own = titles.join(ranked, ["id", "day"])
    keep = F.size("rare") - F.ceil(F.size("rare") * least - 1e-9).cast("int") + 1
    own = own.withColumn("token", F.explode(F.slice(F.col("rare")["token"], F.lit(1), keep))).drop("rare")
    x, y = own.alias("x"), own.alias("y")
    score = F.round(jaccard(F.col("x.tokens"), F.col("y.tokens"), 1.0), 6)
    pairs = x.join(y, (F.col("x.day") == F.col("y.day")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.source") != F.col("y.source")))
    best = pairs.select(F.struct("x.day", "x.source", "x.tokens").alias("t"), F.col("y.id").alias("b"), score.alias("score")).filter(F.col("score") >= least)
    best = best.groupBy("t").agg(F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("m")).select("t.*", "m")
    return rows.join(best, ["day", "source", "tokens"]).select(F.col("id").alias("a"), "m.b", (-F.col("m.s")).alias("score"))


def within_span(events: DataFrame, spans: DataFrame, person: str, day: str, first: str, last: str) -> DataFrame:
    """Events of a person joined with that person's spans that hold the day: an equi-join and a filter."""
    return events.join(spans, (events[person] == spans[person]) & events[day].between(spans[first], spans[last])).drop(spans[person])


def inherit_unique(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Null values filled with the only value of their group, where it has just one."""
    only = rows.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.min(value).alias("_v"), F.countDistinct(value).alias("_n")).filter("_n = 1").drop("_n")
    return rows.join(only, group, "left").withColumn(value, F.coalesce(value, "_v")).drop("_v")


def ambiguous(rows: DataFrame, key: str, target: str) -> DataFrame:
    """Keys that stand for more than one target."""
    return rows.groupBy(key).agg(F.countDistinct(target).alias("targets")).filter("targets > 1")


def rank_in(partition: list[str], *orders: Column) -> Column:
    return F.rank().over(Window.partitionBy(*partition).orderBy(*orders))


def event_groups(matches: DataFrame, least: float = 0.65) -> DataFrame:
    """id, cluster, size of events joined by matches: components, so that the order of events doesn't matter."""
    return clusters(matches.filter(F.col("score") >= least))


def cross_referenced(candidates: DataFrame, groups: DataFrame, ident: str) -> DataFrame:
    """The candidates with status confirmed where the event is in a match group, else unconfirmed."""
    own = groups.select(F.col("id").alias(ident), F.lit(True).alias("_hit"))
    return candidates.join(own, ident, "left").withColumn("status", F.when(F.col("_hit"), "confirmed").otherwise("unconfirmed")).drop("_hit")


def doorway_key(street: Column, postcode: Column, lon: Column, lat: Column, raw: Column) -> Column:
    """A key for a door: its street where it is known, else its postcode, its place to about 10 m, or the text."""
    place = F.concat_ws(",", F.round(lon, 4).cast("string"), F.round(lat, 4).cast("string"))
    return F.coalesce(F.concat(F.lit("street:"), street.cast("string")), F.concat(F.lit("zip:"), postcode.cast("string")), F.when(lon.isNotNull() & lat.isNotNull(), F.concat(F.lit("xy:"), place)), F.concat(F.lit("raw:"), norm(raw)))
