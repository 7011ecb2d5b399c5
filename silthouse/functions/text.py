"""Text parsing and normal forms, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles that say nothing of a person, and company forms.
HONORIFICS = ("mr", "mrs", "ms", "dr", "prof", "adv", "ד\"ר", "דר", "פרופ", "עו\"ד", "מר", "גב", "השר", "השרה", "חה\"כ")
COMPANY_WORDS = ("ltd", "inc", "llc", "corp", "co", "company", "בע\"מ", "בעמ", "חברה", "עמותה")
#: Words that a company's name in a registry is compared without.
COMPANY_FORMS = ("בע\"מ", "בע״מ", "בע'מ", "חברה ל", "חברת", "מפעלי", "קבוצת", "תעשיות", "הולדינגס", "ישראל", "לישראל", "בית השקעות")
#: Letters that Hebrew writes together with the next word.
CLITICS = ("ב", "ל", "מ", "ו", "ש", "כ", "ה")


def norm(c: Column) -> Column:
    """Aggressive key: Hebrew letters, Latin letters and digits, in lower case."""
    return F.lower(F.regexp_replace(c, "[^0-9A-Za-zא-ת]+", ""))


def no_parens(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\([^)]*\)\s*", " "))


def as_int(c: Column) -> Column:
    """'3287.0' and '00043' as numbers; anything else is null."""
    found = F.regexp_extract(c, r"^\s*([0-9]+)(?:\.0*)?\s*$", 1)
    return F.when(found != "", found).try_cast("bigint")


def number(c: Column) -> Column:
    """A number out of text: everything but digits, points and minus signs is dropped; null if none is left."""
    return F.nullif(F.regexp_replace(c.cast("string"), "[^0-9.-]", ""), F.lit("")).try_cast("decimal(38,10)")


def strip_type_key(key: Column, types: tuple[str, ...]) -> Column:
    """A normal key without the street type it starts with, the longest first, where at least 3 characters are left."""
    ladder = "|".join(sorted(types, key=len, reverse=True))
    return F.regexp_replace(key, rf"^(?:{ladder})(?=.{{3}})", "")


def parcel_key(block: Column, suffix: Column, parcel: Column) -> Column:
    """block-suffix-parcel, the suffix 0 where there is none; null without a block or parcel."""
    parts = [as_int(block), F.coalesce(as_int(suffix), F.lit(0)), as_int(parcel)]
    return F.when(parts[0].isNotNull() & parts[2].isNotNull(), F.concat_ws("-", *parts))


def parcel_parts(key: Column) -> Column:
    """The three numbers of a parcel key; null if it isn't one."""
    parts = F.transform(F.split(key, "-"), lambda x: x.try_cast("bigint"))
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("block"), parts[1].alias("suffix"), parts[2].alias("parcel")))


def house_number(c: Column) -> Column:
    """The first run of digits where the text starts with one, else the last run."""
    first, last = F.regexp_extract(c, r"^\s*([0-9]+)", 1), F.regexp_extract(c, r"([0-9]+)[^0-9]*$", 1)
    return F.nullif(F.coalesce(F.nullif(first, F.lit("")), last), F.lit("")).try_cast("int")


def house_suffix(c: Column) -> Column:
    """The letter right after the number of a text that starts with one."""
    return F.nullif(F.regexp_extract(c, r"^\s*[0-9]+\s*([A-Za-zא-ת])(?![A-Za-zא-ת])", 1), F.lit(""))


def strip_type(c: Column, types: list[str]) -> Column:
    """Without a leading street type, the longest first, where at least 3 characters are left."""
    ladder = "|".join(sorted(types, key=len, reverse=True))
    left = F.trim(F.regexp_replace(c, rf"^(?:{ladder})\s+", ""))
    return F.when(F.length(left) >= 3, left).otherwise(c)


def plain_name(c: Column) -> Column:
    """Name in lower case without quotes, dashes as spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "[\"'`׳״]", ""), "[-–—־/]", " "), r"\s+", " "))


def company_name(c: Column) -> Column:
    """Name without company forms as whole words and the empty brackets they leave, spaces collapsed; letters keep their case."""
    bare = F.regexp_replace(c, rf"(?U)\b(?:{'|'.join(COMPANY_FORMS)})\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\(\s*\)", " "), r"(?U)\s+", " "))


def name_tokens(c: Column, organisation: bool = False) -> Column:
    """Sorted tokens without titles (and company words, for organisations) and single characters."""
    skip = [F.lit(x) for x in HONORIFICS + (COMPANY_WORDS if organisation else ())]
    return F.array_sort(F.filter(F.split(plain_name(c), " "), lambda t: (F.length(t) > 1) & ~t.isin(skip)))


def block_key(tokens: Column) -> Column:
    """The first two characters of the longest token, the first in order among equals; null without tokens."""
    best = F.array_max(F.transform(tokens, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("at"), t.alias("t"))))
    return F.substring(best["t"], 1, 2)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Share of common tokens; two empty lists have `empty`."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / both)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance of the joined sorted tokens over the longer length."""
    x, y = F.array_join(a, " "), F.array_join(b, " ")
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def similarity(a: Column, b: Column, a_tokens: Column, b_tokens: Column, organisation: Column | bool = False) -> Column:
    """Likeness of two names: 1 if equal, 0.97 with the same tokens; an organisation's two or more tokens that are half or
    more of the other's count 0.88 or more; else 0.6 of the likeness of the sorted tokens and 0.4 of their share."""
    x, y = F.array_distinct(a_tokens), F.array_distinct(b_tokens)
    shared, least, most = F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    company = organisation if isinstance(organisation, Column) else F.lit(organisation)
    return (
        F.when(plain_name(a) == plain_name(b), F.lit(1.0))
        .when(least == 0, F.lit(0.0))
        .when((shared == least) & (least == most), F.lit(0.97))
        .when(company & (shared == least) & (least >= 2) & (2 * least >= most), F.greatest(F.lit(0.88), 0.7 + 0.25 * least / most))
        .otherwise(F.least(F.lit(1.0), 0.6 * token_sort_ratio(a_tokens, b_tokens) + 0.4 * jaccard(a_tokens, b_tokens)))
    )


def sheet_date(c: Column) -> Column:
    """A date out of a cell: spreadsheet serial, ISO, D.M.Y, D.M.YY, or D/M/Y inside other text."""
    text = F.trim(c)
    serial = F.when(text.rlike(r"^[0-9]{1,5}(\.[0-9]+)?$"), text.cast("double").cast("int"))
    found = F.regexp_extract(text, r"(?<![0-9])([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4}|[0-9]{2})(?![0-9])", 0)
    parts = F.split(found, "[./-]")
    year = F.try_element_at(parts, F.lit(3)).try_cast("int")
    full = F.when(year < 100, year + 2000).otherwise(year)
    day = F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(F.try_element_at(parts, F.lit(2)), 2, "0"), F.lpad(F.try_element_at(parts, F.lit(1)), 2, "0")).try_cast("date")
    iso = F.regexp_extract(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).try_cast("date")
    return F.coalesce(F.when(serial.between(1, 73050), F.date_add(F.lit("1970-01-01").cast("date"), serial - 25569)), iso, F.when(found != "", day))


def sheet_time(c: Column) -> Column:
    """HH:MM out of a cell: a spreadsheet fraction rounded to the minute, HH:MM[:SS], or a bare hour."""
    text = F.trim(c)
    minutes = F.when(text.rlike(r"^0?\.[0-9]+$"), F.round(text.cast("double") * 1440).cast("int") % 1440)
    clock = F.regexp_extract(text, r"^([0-9]{1,2}):([0-9]{2})(?::[0-9]{2})?$", 0)
    hour = F.regexp_extract(text, r"^([0-9]{1,2})$", 1)
    made = F.coalesce(minutes, F.when(clock != "", F.split_part(clock, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(clock, F.lit(":"), F.lit(2)).try_cast("int")), F.when(hour != "", hour.try_cast("int") * 60))
    return F.when(made.between(0, 1439), F.concat(F.lpad((made / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((made % 60).cast("string"), 2, "0")))


def url_identity(url: Column) -> Column:
    """Host without www, path without slash at the end, sorted query without tracking parameters."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "^www\\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|fbclid|gclid|ref)(=|$)")))
    route = F.regexp_extract(url, r"(#[!/].*)$", 1)
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), route)


def path_key(url: Column) -> Column:
    """The looser identity: host and path only."""
    return F.split_part(F.split_part(url_identity(url), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))


def clitic_tokens(c: Column) -> Column:
    """Words in lower case, each also without its first letter where 3 or more are left."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(F.length(w) > 3, F.array(w, F.substring(w, F.lit(2), F.length(w)))).otherwise(F.array(w)))))


def decoded_list(c: Column) -> Column:
    """A JSON array kept as text; [] where it is none."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def skeleton(c: Column) -> Column:
    """The consonants of a Hebrew word without the prefixes and endings of its forms; the first letter stays what it is.

    Fixed values: the prefixes go where 3 letters are left, the endings, longest first, where 2 are.
    """
    bare = F.regexp_replace(c, "^(?:(?:הת|מת)(?=.{3})|[מנתה](?=.{3}))", "")
    return F.regexp_replace(F.regexp_replace(bare, "(?<=.{2})(?:יות|ות|ים|ין|י|ו|ה|ם|ן)$", ""), "(?<=.)[יו]", "")


def prefix_hits(words: Column, title: Column, least: int = 4, consonants: int = 3) -> Column:
    """The title's words that may be another form of a question's word: a different word with the same first `least` letters, or
    with the same skeleton of `consonants` or more. The title's words count with and without one of CLITICS before them; both words have
    `least` letters or more."""
    own = F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    bare = F.transform(F.filter(own, lambda w: (F.length(w) >= 3) & F.substring(w, 1, 1).isin(*CLITICS)), lambda w: F.substring(w, F.lit(2), F.length(w)))
    forms = F.transform(F.array_distinct(F.concat(own, bare)), lambda w: F.struct(w.alias("w"), skeleton(w).alias("s")))
    asked = F.transform(F.filter(words, lambda q: F.length(q) >= least), lambda q: F.struct(q.alias("w"), skeleton(q).alias("s")))
    same = lambda w, q: (F.substring(w["w"], 1, least) == F.substring(q["w"], 1, least)) | ((w["s"] == q["s"]) & (F.length(w["s"]) >= consonants))
    return F.array_sort(F.transform(F.filter(forms, lambda w: (F.length(w["w"]) >= least) & F.exists(asked, lambda q: (w["w"] != q["w"]) & same(w, q))), lambda w: w["w"]))
