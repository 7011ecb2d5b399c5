r"""Personal data: formal entities by pattern, then terms that disclose them by information content.

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers: leftmost, not
overlapping per kind, matches that fail their check dropped. The patterns here take the same
matches as the plain ones of PLAIN in linear time: possessive loops that start only where a run starts (or
where the last match ended), and card lengths inside the pattern.

Then corpus statistics: IC(e) = log(N / df(e)) is the information of an entity, PMI(e; t) =
log(N df(e, t) / (df(e) df(t))) what a term t tells of it, with df counted over all documents. A
term whose PMI is GENERALISE of the IC or more discloses the entity. Its uses are spans of kind
"term" in every document, whether the entity is named there or not, replaced by their class, or removed from
REMOVE of the IC on. Entities and pairs count if at least SUPPORT different texts have them, so that copies
prove nothing. Words are counted by a 64-bit hash.

DataFrame functions only. Document frequencies are partial sums before the shuffle; the pairs of
an entity are never gathered, only counted. Entities that occur in the same texts tell the same of a word, and words of
the same texts and frequency are told the same, so that pairs are made of such classes (known by 128 bits of
hash over their texts), not of all entities and words of a text. Terms are found by a join of each text's
words with the disclosing ones; their places are looked up in the text's own row.

Nulls and edges: a null text is empty and has no spans; repeated rows are judged alike and count
as documents; null ids are kept. Terms shorter than MIN_LETTERS are no terms, and a term inside a
base span is part of that. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silthouse.llm import common

KINDS = ("email", "ip", "card", "phone")
#: What each kind is, before its check.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": PLAIN["phone"],
}
#: A character that every match has, where one is telling.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SUPPORT = 3
GENERALISE = 0.9
REMOVE = 0.98
MIN_LETTERS = 3
_WORD = r"[\p{L}\p{N}]++"
_CHUNK = 256
_SPANS = "array<struct<kind:string,start:int,stop:int,value:string>>"
_TERMS = "array<struct<start:int,stop:int,ratio:double>>"


def _add_up(numbers: Column) -> Column:
    return F.aggregate(numbers, F.array().cast("array<int>"), lambda out, x: F.array_append(out, F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + x))


def _running(numbers: Column) -> Column:
    """Running sums of an array<int>, in chunks so that a long one takes about linear time."""
    last = F.greatest(F.floor((F.size(numbers) - 1) / _CHUNK), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda k: k * _CHUNK + 1)
    chunks = F.transform(starts, lambda a: F.slice(numbers, a, F.lit(_CHUNK)))
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
    before = _add_up(F.concat(F.array(F.lit(0)), F.slice(sums, F.lit(1), F.size(sums) - 1)))
    # each argument of zip_with is evaluated once; inside the functions only their elements are used
    return F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(_add_up(c), lambda x: x + b)))


def _ends(text: Column, pattern: str, matches: Column) -> Column:
    """Where each match of a pattern ends, in code points."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    # an array of one binds the lengths, so that they are computed once
    return F.element_at(F.transform(F.array(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m))), _running), 1)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n + 1 - i, F.lit(1)).cast("int") * (1 + (i + 1) % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return _luhn(F.regexp_replace(match, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _entity(kind: str, match: Column) -> Column:
    """One spelling for each entity."""
    return F.concat(F.lit(f"{kind}:"), F.lower(match) if kind in ("email", "ip") else F.regexp_replace(match, "[^0-9]", ""))


def _spans_of(kind: str) -> Column:
    """The valid matches in the column `_<kind>`, with their places in `_text`."""
    own = F.col(f"_{kind}")
    span = F.zip_with(own, _ends(F.col("_text"), LINEAR[kind], own), lambda m, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("start"), e.alias("stop"), m.alias("value")))
    return F.when(F.size(own) > 0, F.filter(span, lambda s: _valid(kind, s["value"]))).otherwise(F.array().cast(_SPANS))


def _count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _named(docs: DataFrame, text: str) -> DataFrame:
    """The rows with _text, and its hashes _t1 and _t2."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select("*", F.xxhash64(body).alias("_t1"), F.xxhash64(F.lit("text"), body).alias("_t2"), body.alias("_text"))


def _words(text: Column) -> Column:
    """Hashes of the different words of a text that may be terms."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower)
    return F.array_distinct(F.transform(F.filter(plain, lambda w: F.length(w) >= MIN_LETTERS), lambda w: F.xxhash64(w)))


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, _t1, _t2 (of the text), base (spans by kind and place), entities; hashes of the words where there are entities."""
    rows = _named(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_body")), "_body")
    for kind in KINDS:
        matches = F.regexp_extract_all("_text", F.lit(LINEAR[kind]), F.lit(0))
        rows = rows.withColumn(f"_{kind}", F.when(F.contains("_text", F.lit(NEEDS[kind])), matches) if kind in NEEDS else matches)
    rows = rows.withColumn("base", F.concat(*(_spans_of(kind) for kind in KINDS)))
    entity = lambda s: F.coalesce(*(F.when(s["kind"] == kind, _entity(kind, s["value"])) for kind in KINDS))
    rows = rows.withColumn("entities", F.array_distinct(F.transform("base", entity)))
    return rows.select(F.col("_key").alias(key), "_t1", "_t2", "base", "entities", F.when(F.size("entities") > 0, _words(F.col("_text"))).alias("words"))


def _class(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, c1, c2: a hash of the ids of each group, which is the same for groups of the same ids."""
    return rows.groupBy(*by).agg(F.bit_xor(F.xxhash64("id")).alias("c1"), F.bit_xor(F.xxhash64(F.lit("class"), "id")).alias("c2"))


def disclosing(rows: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """word (a hash), ratio: the most that PMI is of an entity's IC, for every word with GENERALISE or more. rows: of found(), written.

    PMI reaches that share of IC only if df(t) <= df(e) (N / df(e)) ** (1 - GENERALISE). So the words of
    texts with an entity that recurs meet their document frequencies first, in rows of a few bytes,
    and only those rare enough for one of their text's entities are paired and counted.
    """
    n = float(max(docs.count(), 1))
    own = rows.filter(F.size("entities") > 0).groupBy("_t1", "_t2").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("words").alias("words"))
    own = common.written(own.select(F.monotonically_increasing_id().alias("id"), "copies", "entities", "words"), "entities")
    each = own.select("id", "copies", F.explode("entities").alias("entity"))
    known = each.groupBy("entity").agg(F.sum("copies").alias("e"), F.count(F.lit(1)).alias("texts")).filter((F.col("texts") >= SUPPORT) & (F.col("e") < n)).drop("texts")
    most = F.floor(F.col("e") * F.pow(n / F.col("e"), 1 - GENERALISE) + 1e-6)
    alike = known.join(_class(each, ["entity"]), "entity").groupBy("c1", "c2", "e").agg(F.min("entity").alias("entity"))  # one entity of each class
    told = common.written(each.join(alike, "entity").select("id", "copies", F.struct("entity", "e", most.alias("most")).alias("x")), "told")
    counts = docs.select(F.explode(_words(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("t")).filter(F.col("t") >= SUPPORT)
    bounds = told.groupBy("id").agg(F.max("x.most").alias("bound"))
    rare = own.join(bounds, "id").select("id", "bound", F.explode("words").alias("word")).join(counts, "word").filter(F.col("t") <= F.col("bound"))
    rare = common.written(rare.select("id", "word", "t"), "rare")
    words = common.written(_class(rare, ["word", "t"]), "words")
    first = words.groupBy("c1", "c2", "t").agg(F.min("word").alias("word"))  # one word of each class
    pairs = rare.join(first.select("word"), "word", "left_semi").join(told, "id").filter(F.col("t") <= F.col("x.most"))
    counted = pairs.groupBy("x.entity", "x.e", "word", "t").agg(F.sum("copies").alias("both"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= SUPPORT)
    ratio = F.log(n * F.col("both") / (F.col("e") * F.col("t"))) / F.log(n / F.col("e"))
    best = counted.groupBy("word").agg(F.max(ratio).alias("ratio")).filter(F.col("ratio") >= GENERALISE)
    classes = best.join(first, "word").select("c1", "c2", "t", "ratio")
    return words.join(classes, ["c1", "c2", "t"]).select("word", "ratio")


def _terms(docs: DataFrame, told: DataFrame, text: str) -> DataFrame:
    """_t1, _t2, terms (struct start, stop, ratio; by place) of each text with disclosing words."""
    named = _named(docs.select(F.col(f"`{text}`").alias("_body")), "_body")
    hit = named.select("_t1", "_t2", F.explode(_words(F.col("_text"))).alias("word")).join(told, "word").groupBy("_t1", "_t2", "word").agg(F.first("ratio").alias("ratio"))
    hit = common.written(hit.groupBy("_t1", "_t2").agg(F.map_from_entries(F.collect_list(F.struct("word", "ratio"))).alias("_told")), "disclosed")
    texts = named.join(hit, ["_t1", "_t2"]).groupBy("_t1", "_t2").agg(F.first("_text").alias("_text"), F.first("_told").alias("_told"))
    texts = texts.withColumn("_all", F.regexp_extract_all("_text", F.lit(_WORD), F.lit(0)))
    token = F.zip_with("_all", _ends(F.col("_text"), _WORD, F.col("_all")), lambda w, e: F.struct((e - F.length(w)).alias("start"), e.alias("stop"), F.try_element_at("_told", F.xxhash64(F.lower(w))).alias("ratio")))
    return texts.select("_t1", "_t2", F.filter(token, lambda t: t["ratio"].isNotNull()).alias("terms"))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, _t1, _t2, base, terms (struct start, stop, ratio; by place): one row per document."""
    rows = common.written(found(docs, key, text), "found")
    told = common.written(disclosing(rows, docs.select(f"`{text}`"), text), "disclosing")
    joined = rows.join(_terms(docs, told, text), ["_t1", "_t2"], "left")
    apart = lambda t: ~F.exists("base", lambda b: (t["start"] < b["stop"]) & (b["start"] < t["stop"]))
    return joined.select(key, "_t1", "_t2", "base", F.coalesce(F.filter("terms", apart), F.array().cast(_TERMS)).alias("terms"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    place = lambda kind, s: F.concat_ws(":", kind, s["start"], s["stop"])
    base = F.transform("base", lambda s: place(s["kind"], s))
    terms = F.transform("terms", lambda s: place(F.lit("term"), s))
    counts = [_count_of(kind) for kind in KINDS]
    return spans(docs, key, text).select(key, *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with entities and disclosing terms generalised to their class, or removed; all columns stay."""
    rows = common.set_aside(docs, key, text)
    body = F.coalesce(F.col("_body"), F.lit(""))
    own = spans(rows, "_id", "_body").select("_t1", "_t2", "base", "terms").groupBy("_t1", "_t2").agg(F.first("base").alias("_base"), F.first("terms").alias("_terms"))
    named = rows.withColumn("_t1", F.xxhash64(body)).withColumn("_t2", F.xxhash64(F.lit("text"), body)).join(own, ["_t1", "_t2"])
    cut = lambda s, put: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), put.alias("put"))
    edits = F.concat(
        F.transform("_base", lambda s: cut(s, F.concat(F.lit("["), s["kind"], F.lit("]")))),
        F.transform("_terms", lambda s: cut(s, F.when(s["ratio"] >= REMOVE, "").otherwise(F.when(F.substring(body, s["start"] + 1, s["stop"] - s["start"]).rlike("^[0-9]+$"), "[number]").otherwise("[term]")))),
    )
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, e: Column) -> Column:
        kept = F.substring(body, acc["at"] + 1, F.greatest(e["start"] - acc["at"], F.lit(0)))
        new = F.concat(acc["out"], kept, F.when(e["start"] >= acc["at"], e["put"]).otherwise(""))  # of spans that overlap the first is named
        return F.struct(F.greatest(acc["at"], e["stop"]).alias("at"), new.alias("out"))

    clean = F.aggregate(F.sort_array(edits), empty, put, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    return common.restored(named, docs, key, text, F.when(F.size("_base") + F.size("_terms") > 0, clean).otherwise(F.col("_body")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.read(spark, sf_dir, "documents"))
