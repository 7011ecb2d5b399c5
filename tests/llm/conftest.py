import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

LONG = " ".join(f"w{i % 977}" for i in range(9000))
#: Texts that each operator must take: null, empty, white space, ties, copies, long ones, odd characters.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "a b"), (7, LONG), (8, LONG + " tail"), (9, "Ünïcödé — x y \U0001f600 z"),
    (10, "\n\n\n"), (11, "The quick brown fox jumps over the lazy dog and runs far away from here today."), (12, "the QUICK brown fox jumps over the lazy dog and runs far away from here today!"),
    (13, "x" * 1500), (14, "ab" * 900), (15, "mail me a.b@c.example.com or call +1 (555) 555-1234 at 10.0.0.1 card 4539 1488 0343 6467"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with a column whose name clashes with what operators add."""
    rows = [(i, t, "en", "src", len(t or ""), "extra") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
