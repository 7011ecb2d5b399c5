"""Row identities. NULL and '' are the same value in each of them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that never belong to an identity.
HIDDEN = ("row_hash", "first_seen")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def content_hash(columns: list[str]) -> Column:
    """MD5 of the values in column order, a unit separator between them."""
    return F.md5(F.concat_ws("\x1f", *(_text(c) for c in columns)))


def row_hash(columns: list[str], stamp: str | None = None) -> Column:
    """SHA-256 of the values by column name, whatever their order; a sampling stamp can be left out."""
    own = sorted(c for c in columns if c != stamp and c not in HIDDEN)
    return F.sha2(F.to_json(F.struct(*(_text(c).alias(c) for c in own))), 256)


def repair_hash(columns: list[str]) -> Column:
    """Content hash that takes '180.0' for '180'."""
    return F.md5(F.concat_ws("\x1f", *(F.regexp_replace(_text(c), r"^(-?[0-9]+)\.0$", "$1") for c in columns)))


def table_signature(df: DataFrame, rows: int) -> str:
    """Sixteen digits for the row count and the ordered names and types."""
    plain = f"{rows}|" + "|".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    return hashlib.sha256(plain.encode()).hexdigest()[:16]


def clean_headers(names: list[str], budget: int = 63) -> list[str]:
    """Unique names of at most `budget` bytes: blanks are col_N, repeats (in any case) get a suffix."""
    out: list[str] = []
    taken: set[str] = set()
    for k, raw in enumerate(names, 1):
        name = _fit((raw or "").replace('"', "").strip() or f"col_{k}", budget)
        base, n = name, 0
        while name.lower() in taken:
            n += 1
            name = _fit(base, budget - len(f"_{n}")) + f"_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def _fit(name: str, budget: int) -> str:
    return name.encode()[:budget].decode(errors="ignore")
