"""Text search: operators, prefix and boolean predicates, ranks, snippets, federated cards."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silthouse.storage import written


@dataclass
class Terms:
    """What a query line asks for: phrases and words, words to leave out, whether one is enough."""

    wanted: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    any: bool = False


def parse_terms(line: str) -> Terms:
    """'"a phrase" word -not OR other': quotes make phrases, a dash excludes, OR makes one enough, parentheses are dropped."""
    out = Terms()
    for dash, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"()]+))', line.replace("(", " ").replace(")", " ")):
        text = (phrase or word).strip().lower()
        if word == "OR" and not dash:
            out.any = True
        elif text and text != "-":
            (out.excluded if dash else out.wanted).append(text)
    return out


def matches(hay: Column, terms: Terms) -> Column:
    """All (or any) wanted texts are there and no excluded one, in any case."""
    low = F.lower(F.coalesce(hay, F.lit("")))
    tests = [F.contains(low, F.lit(t)) for t in terms.wanted]
    test = reduce(or_ if terms.any else and_, tests) if tests else F.lit(True)
    return reduce(and_, [~F.contains(low, F.lit(t)) for t in terms.excluded], test)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


_WORD = r"[\p{L}\p{N}]"


def _pattern(word: str, whole: bool = False) -> str | None:
    """What finds a word, or the beginning of one, in a text in lower case; None for what no word can have in it.

    The first letter comes before the look behind it, so that most places are left at once.
    """
    own = word.lower()
    if any(unicodedata.category(c)[0] not in "LN" for c in own):
        return None
    return (f"{own[0]}(?<!{_WORD}{own[0]}){own[1:]}" if own else _WORD) + (f"(?!{_WORD})" if whole else "")


def has_word(text: Column, word: str, whole: bool = False) -> Column:
    """Whether some word of a text begins with the given one, or is it. The search ends at the first hit."""
    found = _pattern(word, whole)
    return F.lower(text).rlike(found) if found else F.when(text.isNotNull(), F.lit(False))


def boolean(text: Column, query: list) -> Column:
    """A nested query ['and', a, b], ['or', ...], ['not', a] over a text's words; a word with a quote mark matches whole, others by their beginning."""
    if isinstance(query, str):
        whole = query.strip("'\"")
        return has_word(text, whole if re.search("['\"]", query) else query, query != whole)
    op, *parts = query
    own = [boolean(text, p) for p in parts]
    return ~own[0] if op == "not" else reduce(and_ if op == "and" else or_, own)


def _beginning_with(text: Column, prefix: str) -> Column:
    """How many words of a text begin so."""
    found = _pattern(prefix)
    return F.regexp_count(F.lower(text), F.lit(found)) if found else F.when(text.isNotNull(), F.lit(0))


def ranked(df: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """key, hits, score: BM25 over words by their beginnings; rows without a hit are left out.

    Texts are read once: their lengths and hits are written, for the one row of corpus figures and the scores.
    """
    body = F.col(text)
    hits = [_beginning_with(body, p).alias(f"h{k}") for k, p in enumerate(words)]
    rows = written(df.select(key, F.size(tokens(body)).alias("_n"), *hits), "hits")
    total = rows.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_mean"), *(F.count_if(F.col(f"h{k}") > 0).alias(f"d{k}") for k in range(len(words))))
    joined = rows.filter(reduce(or_, [F.col(f"h{k}") > 0 for k in range(len(words))])).join(F.broadcast(total))
    idf = lambda k: F.log(1 + (F.col("_docs") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5))
    part = lambda k: idf(k) * F.col(f"h{k}") * 2.2 / (F.col(f"h{k}") + 1.2 * (0.25 + 0.75 * F.col("_n") / F.col("_mean")))
    score = reduce(lambda a, b: a + b, [part(k) for k in range(len(words))])
    return joined.select(key, reduce(lambda a, b: a + b, [F.col(f"h{k}") for k in range(len(words))]).cast("long").alias("hits"), F.round(score, 3).alias("score"))


def snippet(text: Column, terms: list[str], width: int = 220) -> Column:
    """A window of a text around its first hit, marked with ellipses; hits of 2 letters or more in **stars**, the longest first."""
    low = F.lower(text)
    places = F.filter(F.array(*(F.instr(low, t.lower()) for t in terms)), lambda p: p > 0)
    first = F.coalesce(F.array_min(places), F.lit(1))
    start = F.greatest(F.lit(1), F.least(first - width // 2, F.length(text) - width + 1))
    cut = F.substring(text, start, F.lit(width))
    marked = sorted({t for t in terms if len(t) >= 2}, key=lambda t: (-len(t), t))
    if marked:
        cut = F.regexp_replace(cut, "(?i)(" + "|".join(map(re.escape, marked)) + ")", "**$1**")
    return F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + width - 1 < F.length(text), "…").otherwise(""))


def tiered(df: DataFrame, intent: Column, catch_all: Column, score: Column, vintage: Column, key: str) -> DataFrame:
    """Relevance order: rows of the intent first, catch-alls last, then rank in steps of 0.001, newest, key."""
    return df.orderBy(F.coalesce(intent, F.lit(False)).desc(), F.coalesce(catch_all, F.lit(False)).asc(), F.round(score, 3).desc_nulls_last(), vintage.desc_nulls_last(), F.col(key).desc())


def suggested(df: DataFrame, name: str, prefix: str, weight: str | None = None, n: int = 20) -> DataFrame:
    """Autocomplete: names with the beginning first, then by weight, length and name."""
    starts = F.startswith(F.lower(F.col(name)), F.lit(prefix.lower()))
    rows = df.filter(F.contains(F.lower(F.col(name)), F.lit(prefix.lower())))
    return rows.orderBy(starts.desc(), *([F.col(weight).desc_nulls_last()] if weight else []), F.length(name), F.col(name)).limit(n)


def federated(sources: dict[str, tuple[DataFrame, dict[str, Column]]], line: str, n: int = 20) -> DataFrame:
    """Cards (source, id, title, body) of several tables for one query line: at most n of each source, in one plan."""
    terms, parts = parse_terms(line), []
    for name, (df, card) in sources.items():
        own = df.select(F.lit(name).alias("source"), *(card[c].cast("string").alias(c) for c in ("id", "title", "body")))
        parts.append(own.filter(matches(F.concat_ws(" ", "title", "body"), terms)).orderBy("id").limit(n))
    return reduce(DataFrame.unionByName, parts)


def relevance(question: Column, subject: Column, attribute: Column) -> Column:
    """Lexical score of an entity for a question's words: subject hits thrice, attribute hits no more than those, scaled by the share of words found."""
    s, a = F.size(F.array_intersect(question, subject)), F.size(F.array_intersect(question, attribute))
    found = F.size(F.array_intersect(question, F.array_union(subject, attribute)))
    return F.round((3.0 * s + F.least(a.cast("double"), 3.0 * s)) * found / F.greatest(F.size(question), F.lit(1)), 6)
