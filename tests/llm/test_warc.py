import base64
import hashlib
import zlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silthouse.llm import warc as W

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def brute(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        body, least = (html or "").encode(), first.get(html or "")
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == least else "revisit", None if i == least else least))
    return sorted(out, key=str)


def check(pages):
    got = W.captures(pages).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == brute([tuple(r)[:3] for r in pages.collect()])
    ordered = sorted(got, key=lambda r: r.history_at)
    keys = [(r.url_key, r.ts) for r in ordered]
    assert keys == sorted(keys) and [r.history_at for r in ordered] == list(range(len(ordered)))
    return got


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    check(pages.union(pages.selectExpr("page_id + 1000", "url", "html")))


def test_edges(spark):
    rows = [(5, "http://b.example.com/", "<p>x</p>", 1), (3, "http://b.example.com/", "<p>x</p>", 1), (3, None, None, 1), (4, "", "", 1), (None, "http://a\r\n.org/Ü", "", 1), (None, "x", "only"), (6, "http://z/", "\r\n\r\nWARC/1.1 é" * 3000, 1), (6, "http://z/", "y", 1)]
    pages = spark.createDataFrame([(*r[:3], 1) for r in rows], "page_id long, url string, html string, ts int")
    check(pages)
    check(pages.limit(0))


def test_any_64_bit_id_and_timestamps(spark):
    rows = [(i, "http://a.org/x", f"p{i % 3}", f"200{k}-01-01 00:00:00") for k, i in enumerate([-(2**62), 2**62, 10**15, 0, -1, 2**63 - 1])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, day string").withColumn("day", F.to_timestamp("day"))
    check(pages)
    timed = W.captures(pages, when="day").orderBy("history_at").collect()
    assert [r.page_id for r in timed] == [r[0] for r in rows] and timed[1].ts == "2001-01-01T00:00:00Z"


def test_ranges_and_chunks(spark, sf, monkeypatch):
    monkeypatch.setattr(W, "MERGE_ROWS", 7)
    monkeypatch.setattr(W, "CHUNK_ROWS", 3)
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(90).withColumn("url", F.when(F.col("page_id") % 3 > 0, F.lit("http://hot.org/")).otherwise(F.col("url")))
    check(pages.repartition(5))


def test_a_bad_record_is_a_row(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(5)
    stored = W.archives(pages).withColumn("member", F.when(F.col("page_id") == 2, F.lit(b"no gzip")).when(F.col("page_id") != 3, F.col("member")))
    got = {r.page_id: r for r in W.histories(W.index(stored)).collect()}
    assert len(got) == 5 and [got[i].error is None for i in range(5)] == [True, True, False, False, True]


def test_order_with_bad_records_old_and_far_times(spark):
    rows = [(k, "http://a.org/x" if k < 9 else "http://b.org/", f"p{k}", day) for k, day in enumerate(["0900-01-01", "2001-01-01", "0001-01-01", "9999-12-31", "+12000-01-01", "1500-06-01", None, "2001-01-01", "1969-12-31", "+12000-01-01", "2000-01-01"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, day string").withColumn("day", F.to_timestamp(F.when(F.col("day").startswith("+"), "1970-01-01").otherwise(F.col("day"))) + F.when(F.col("day").startswith("+"), F.expr("INTERVAL '10030' YEAR")).otherwise(F.expr("INTERVAL '0' YEAR")))
    stored = W.archives(pages, when="day").withColumn("member", F.when(F.col("page_id").isin(1, 3), F.lit(b"bad")).otherwise(F.col("member")))
    got = W.histories(W.index(stored)).orderBy("history_at").collect()
    assert [r.page_id for r in got] == [1, 3, 4, 2, 0, 5, 8, 7, 6, 9, 10] and [r.history_at for r in got] == list(range(11))
    assert [r.page_id for r in got if r.error] == [1, 3, 4, 9] and got[3].ts == "0001-01-01T00:00:00Z"


def test_archives_are_gzip_members(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(7)
    rows = sorted(W.archives(pages).filter("archive = 0").collect(), key=lambda r: r.offset)
    whole = b"".join(r.member for r in rows)
    for r in rows:
        assert zlib.decompress(whole[r.offset : r.offset + r.length], 31).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


@given(st.lists(st.lists(st.integers()).map(sorted), max_size=9))
def test_loser_tree(runs):
    assert list(W.merged([[(x,) for x in r] for r in runs])) == sorted((x,) for r in runs for x in r)
