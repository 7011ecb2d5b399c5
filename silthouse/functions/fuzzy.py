"""Likeness of registry names by longest common subsequences: what no built-in function computes, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: How much the looser likenesses count.
PARTIAL, SORTED = 0.9, 0.95


def common_length(a: str, b: str) -> int:
    """Characters of the longest common subsequence, a bit of a number for each character of a."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common characters over both lengths; two empty texts are alike."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str, above: float = 0.0) -> float:
    """The best ratio of the shorter text with a stretch of the longer one that is no longer than it.

    A best ratio that is not above `above` may come out as any number up to it. A stretch that is moved by a letter shares
    at most one letter more, so stretches that cannot get there are passed over.
    """
    short, long = sorted((a, b), key=len)
    m, n, best = len(short), len(long), above
    if not short:
        return float(not long)
    k = 0
    while k <= n - m:
        common = common_length(short, long[k : k + m])
        best = max(best, common / m)
        k += max(1, int(best * m - 1e-9) + 1 - common)
    w = m - 1  # stretches that the ends of the longer text cut off
    while w > 0 and 2 * w / (m + w) > best:
        best = max(best, ratio(short, long[:w]), ratio(short, long[n - w :]))
        w -= 1
    return best


def score(a: str, b: str) -> float:
    """The best of the plain ratio, nine tenths of the partial one, and nearly all of that of sorted words."""
    common = common_length(a, b)
    best = 2 * common / (len(a) + len(b)) if a or b else 1.0
    if best < SORTED:
        best = max(best, SORTED * ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
    # a stretch shares no more than the whole text does, and is at least as long as what it shares
    if common and best < PARTIAL * 2 * common / (min(len(a), len(b)) + common):
        best = max(best, PARTIAL * partial_ratio(a, b, best / PARTIAL - 1e-9))
    return best


@F.pandas_udf(DoubleType())
def registry_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """score() of two columns; null where one is null."""
    return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
