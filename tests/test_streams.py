"""Streams that stop and resume, key sets whose reads stay flat, and state that forgets."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from silthouse.sources.paged import PagedSource
from silthouse.streaming import generations as G
from silthouse.streaming import ingest as N
from silthouse.streaming.seen import SeenKeys, bloom, may_hold


@pytest.fixture
def api():
    """A paged API with two resources; it breaks off a page once when told to, and counts its answers."""
    state = {"rows": {"a": [{"id": k, "v": f"a{k}", "x": None if k % 3 else 1.5} for k in range(-5, 2300, 2)], "b": []}, "break": 0, "answers": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query, keep_blank_values=True).items()}
            rows = state["rows"][q["resource"]]
            rows = rows[-1:] if "newest" in q else [r for r in rows if not q["after"] or r["id"] > int(q["after"])][: int(q["limit"])]
            body = json.dumps({"result": {"records": rows}}).encode()
            state["answers"] += 1
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if "newest" not in q and state["break"] and q["after"] and int(q["after"]) > 500:
                state["break"] -= 1
                body = body[: len(body) // 2]
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}/?resource={{resource}}"
    yield state
    server.shutdown()


def paged(spark, reader, api, **more):
    spark.dataSource.register(PagedSource)
    own = {"url": api["url"] + "&after={after}&limit={limit}", "newest": api["url"] + "&newest=1", "resources": "a,b", "key": "id", "limit": "100", "width": "700"}
    return reader.format("paged").schema("resource string, id long, v string, x double, absent string").options(**own | more).load()


def until_now(stream, root):
    run = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()


def test_paged_stream_resumes(spark, api, tmp_path):
    stored = lambda: sorted((r.resource, r.id, r.v, r.x) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    there = lambda: sorted((n, r["id"], r["v"], r["x"]) for n, rows in api["rows"].items() for r in rows)
    api["break"] = 1  # a page that breaks off is asked for again
    until_now(paged(spark, spark.readStream, api), tmp_path)
    assert stored() == there()
    api["rows"]["a"] += [{"id": k, "v": "late", "x": 2} for k in range(3000, 3400)]
    api["rows"]["b"] += [{"id": k, "v": None, "x": "none"} for k in range(40)]
    api["break"] = 10_000  # every page breaks off in the middle: the run stops
    with pytest.raises(Exception):
        until_now(paged(spark, spark.readStream, api), tmp_path)
    api["break"] = 0
    api["rows"]["a"].append({"id": 9000, "v": "newest", "x": 0})
    until_now(paged(spark, spark.readStream, api), tmp_path)  # the stopped batch, with the keys that it was to have
    assert len(stored()) == len(there()) - 1
    until_now(paged(spark, spark.readStream, api), tmp_path)
    want = [(n, k, v, None if x == "none" else x) for n, k, v, x in there()]
    assert set(stored()) ^ set(want) == set() and stored() == want
    answers = api["answers"]
    until_now(paged(spark, spark.readStream, api), tmp_path)  # nothing new: no page is read
    assert stored() == want and api["answers"] - answers <= 6
    batch = paged(spark, spark.read, api).collect()
    assert sorted((r.resource, r.id, r.v, r.x) for r in batch) == want and all(r.absent is None for r in batch)
    empty = paged(spark, spark.read, api | {"rows": None}, resources="b", limit="7", width="3")
    assert empty.count() == 40


def test_saved_pages_with_text_keys(spark, tmp_path):
    for resource, after, keys in (("r", "", ["a", "b"]), ("r", "b", ["c"]), ("s", "", [])):
        folder = tmp_path / f"resource={resource}" / f"after={after}"
        folder.mkdir(parents=True)
        (folder / "p.txt").write_text(json.dumps({"result": {"records": [{"k": k} for k in keys]}}))
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").schema("k string, resource string").options(url=str(tmp_path), resources="r,s,none", key="k").load()
    assert sorted(map(tuple, rows.collect())) == [("a", "r"), ("b", "r"), ("c", "r")]


def test_filters_forget_nothing():
    rng = np.random.default_rng(1)
    own, other = rng.integers(0, 1 << 63, (2, 20_000)).astype(np.uint64)
    bits = bloom(own)
    assert may_hold(bits, own).all() and may_hold(bits, other).mean() < 0.02 and not may_hold(bloom(own[:0]), own).any()


def test_reads_of_a_batch_do_not_grow_with_the_keys(spark, tmp_path):
    seen, read, total = SeenKeys(spark, str(tmp_path), ["k", "j"], per_bucket=25, buckets=64), [], 0
    for number, size in enumerate([1600, 10, 3200, 10]):
        rows = spark.range(max(0, total - 3), total + size).select(F.concat(F.lit("k"), "id").alias("k"), F.when(F.col("id") % 2 == 0, 1).alias("j"), "id")
        fresh = seen.unseen(rows.union(rows), number)
        got = sorted(r.id for r in fresh.collect())
        assert got == list(range(total, total + size))
        read.append(seen.read)
        seen.add(spark.createDataFrame([(f"k{i}", 1 if i % 2 == 0 else None, i) for i in got], "k string, j int, id long"), number)
        total += size
    assert read[3] < 1.3 * read[1], read
    again = spark.createDataFrame([("k7", None, 7), ("new", None, 0)], "k string, j int, id long")
    assert [r.k for r in seen.unseen(again, 4).collect()] == ["new"]
    assert seen.unseen(spark.createDataFrame([("k4819", None, 0)], "k string, j int, id long"), 3).count() == 1  # a replay leaves its own traces out


def test_ingest_replays_a_batch(spark, tmp_path):
    spark.createDataFrame([(k % 30, k) for k in range(90)], "k long, v long").repartition(3).write.parquet(str(tmp_path / "in"))
    run = lambda checkpoint: N.ingest(N.file_stream(spark, str(tmp_path / "in"), "k long, v long", 1), str(tmp_path / "out"), str(tmp_path / checkpoint), ["k"], per_bucket=5, buckets=4).awaitTermination()
    for checkpoint in ("c1", "c2"):  # a lost checkpoint replays all batches under the same numbers
        run(checkpoint)
        assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(30))


def test_state_forgets_and_rows_are_the_batch_form(spark, tmp_path):
    """1,000 generations, 100 to a file: state stays flat, rows are those of the batch form."""
    rows = [(f"new{g}", 1, g) for g in range(1000)] + [("steady", 1, g) for g in range(0, 1000, 3)] + [("seldom", 1, g) for g in range(0, 1000, 11)] + [(f"twice{g % 90}", 2, g) for g in range(0, 1000, 7)]
    rows = sorted(rows, key=lambda r: r[2])
    for part in range(10):
        own = [r for r in rows if r[2] // 100 == part]
        spark.createDataFrame(own, "id string, kind int, gen long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set(*G.STORE)
    try:
        stream = G.generation_window_stream(N.file_stream(spark, str(tmp_path / "in"), "id string, kind int, gen long", 1), ["id", "kind"], "gen", 10)
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset(G.STORE[0])
    with pytest.raises(ValueError):
        G.generation_window_stream(stream, ["id"], "gen", 10)
    batch = N.generation_window(spark.createDataFrame(rows, "id string, kind int, gen long"), ["id", "kind"], "gen", 10)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, batch.collect()))
    held = [p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators]
    assert len(held) >= 10 and max(held[3:]) <= 1.2 * held[2] < 1000, held
