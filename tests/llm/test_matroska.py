import hashlib
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from silthouse.llm import matroska as M


def check(docs):
    got = M.digests(M.media(docs)).collect()
    want = []
    for r in docs.collect():
        text = (r.text or "").encode()
        payload = text + b" " * (-len(text) % 192 if text else 192)
        want.append((r.doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted(tuple(r[:5]) for r in got) == sorted(want)
    return got


def test_round_trip(docs):
    got = check(docs)
    assert len({r.media_sha256 for r in got}) == len({r.payload_sha256 for r in got})


def test_edges(odd, empty):
    check(odd)
    assert check(empty) == []


def test_packets_and_cues(spark):
    docs = spark.createDataFrame([(1, "x" * 192 * 1100), (2, None)], "doc_id long, text string")
    files = M.media(docs)
    packets = M.packets(files).collect()
    whole = {r.doc_id: r.media for r in files.collect()}
    own = [r for r in packets if r.doc_id == 1]
    assert [r.timestamp_ns for r in own] == [k * 24_000_000 for k in range(1100)]
    assert b"".join(whole[1][r.offset : r.offset + r.size] for r in own) == b"x" * 192 * 1100
    assert {r.lacing for r in packets} == {0, 1, 2, 3}
    cues = [r for r in M.cues(files).collect() if r.doc_id == 1]
    assert [r.timestamp_ns for r in cues] == [0, 512 * 24_000_000, 1024 * 24_000_000]
    assert all(whole[1][r.offset : r.offset + 4] == M.CLUSTER.to_bytes(4, "big") for r in cues)
    nothing = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert M.packets(nothing).count() == M.cues(nothing).count() == 0


@given(st.lists(st.binary(max_size=600), min_size=1, max_size=30), st.sampled_from([M.XIPH, M.EBML_LACING]))
def test_lacing(frames, lacing):
    data = M.element(M.SEGMENT, M.element(M.CLUSTER, M.element(M.TIMESTAMP, b"\x05") + M.element(M.SIMPLE_BLOCK, M.block(3, -2, frames, lacing, False))))
    found = M.parse(data)["packets"]
    assert [data[o : o + n] for *_, o, n, _ in found] == frames
    assert all(x[:4] == (3, 3_000_000, False, lacing) for x in found)


def test_unknown_sizes_groups_and_voids():
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, M.block(1, 7, [b"abc"], 0, False)) + M.element(M.REFERENCE_BLOCK, b"\xff"))
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + M.element(M.TIMESTAMP, b"\x01") + M.element(0xEC, b"\0" * 9)
    data = M.element(M.EBML, b"") + M.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster + group + cluster + M.element(M.SIMPLE_BLOCK, M.block(1, 0, [b"d"], 0))
    found = M.parse(data)
    assert [(data[x[5] : x[5] + x[6]], x[1], x[2], x[4]) for x in found["packets"]] == [(b"abc", 8_000_000, False, 0), (b"d", 1_000_000, True, 1)]
    for broken in (data[:-1], data + b"\xa3", M.element(M.SIMPLE_BLOCK, M.block(1, 0, [b"abc", b"de"], M.FIXED))):
        with pytest.raises(ValueError):
            M.parse(broken)


def test_null_files(spark):
    files = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    r = M.digests(files).collect()[0]
    assert (r.payload_bytes, r.media_bytes, r.tail_crc32) == (0, 0, 0) and M.packets(files).count() == M.cues(files).count() == 0
