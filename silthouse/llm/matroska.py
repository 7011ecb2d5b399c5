"""Matroska media columns: files written from samples, and read back as tables of packets and cues.

A reader walks the EBML elements once: it steps into master elements, whose ends it need not
know (so clusters and segments of unknown size are read too), takes cluster timestamps, tracks,
blocks with any lacing and cues, and skips everything else, voids and checksums included.
Each packet is a byte range of the file, so no frame is copied to list them.

Files are columns of a table in the shared folder; a task writes or reads its own rows in slices
of a few MB, and a longer single file is a slice of its own. Nothing is shuffled.

Nulls and edges: a null text is empty and becomes one frame of padding; a null file is an empty one and has no
packets; ids may repeat or be null; a file that breaks off or has a length that leads outside
it raises ValueError. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from silthouse.llm import common

FRAME_BYTES = 192
RATE = 8000
BLOCK_FRAMES = 8
CLUSTER_BLOCKS = 64
SLICE_BYTES = 4 << 20
FRAME_MS = FRAME_BYTES * 1000 // RATE

# Element ids of EBML and Matroska.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, DEFAULT_DURATION, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x23E383, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset((SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS))
NO_LACING, XIPH, FIXED, EBML_LACING = range(4)


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length integer: a marker bit after width - 1 zeros, then the value; all ones is reserved."""
    width = width or max(1, -(-(value + 1).bit_length() // 7))
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def _uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, relative: int, frames: list[bytes], lacing: int, keyframe: bool = True) -> bytes:
    """The body of a SimpleBlock."""
    out = [vint(track), struct.pack(">hB", relative, (0x80 if keyframe else 0) | lacing << 1)]
    if lacing != NO_LACING:
        sizes = [len(f) for f in frames]
        out.append(bytes([len(frames) - 1]))
        if lacing == XIPH:
            out += [b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]]
        elif lacing == EBML_LACING and len(sizes) > 1:
            out.append(vint(sizes[0]))
            for a, b in zip(sizes, sizes[1:-1], strict=False):
                width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1))
                out.append(vint(b - a + (1 << 7 * width - 1) - 1, width))
    return b"".join(out + frames)


def mux(payload: bytes) -> bytes:
    """8-bit samples, a positive multiple of FRAME_BYTES, as a file with laced blocks and a cue for each cluster."""
    frames = [payload[a : a + FRAME_BYTES] for a in range(0, len(payload), FRAME_BYTES)]
    head = element(EBML, element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", FRAME_MS * len(frames))) + element(MUXING_APP, b"silthouse") + element(WRITING_APP, b"silthouse"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    track = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT")
    body, cues = [info + element(TRACKS, element(TRACK_ENTRY, track + audio))], []
    at, span = len(body[0]), BLOCK_FRAMES * CLUSTER_BLOCKS
    for c in range(0, len(frames), span):
        parts = [_uint(TIMESTAMP, FRAME_MS * c)]
        for b in range(c, min(c + span, len(frames)), BLOCK_FRAMES):
            own = frames[b : b + BLOCK_FRAMES]
            lacing = 1 + b // BLOCK_FRAMES % 3 if len(own) > 1 else NO_LACING
            parts.append(element(SIMPLE_BLOCK, block(1, FRAME_MS * (b - c), own, lacing)))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, FRAME_MS * c) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def _vint_at(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """Value (with its marker, if kept), end and width of the variable-length integer at a place."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"the file breaks off at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    return raw if keep else raw ^ 1 << 7 * width, at + width, width


def _laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges (offset, size) of the frames of a block whose lacing starts at a place."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError(f"{end - at} bytes are not {count} equal frames")
        sizes = [(end - at) // count] * count
    elif lacing == XIPH:
        while len(sizes) < count - 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:
        while len(sizes) < count - 1:
            n, at, width = _vint_at(data, at)
            sizes.append(sizes[-1] + n - ((1 << 7 * width - 1) - 1) if sizes else n)
    if lacing != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"frames are longer than their block, which ends at byte {end}")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def parse(data: bytes) -> dict:
    """tracks, packets (track, timestamp in ns, keyframe, lacing, cluster, offset, size, block), cues (time in ns, track, cluster position)."""
    out: dict = {"tracks": [], "packets": [], "cues": [], "clusters": 0, "blocks": [0, 0, 0, 0], "scale": 1_000_000, "duration": 0.0, "segment": 0}
    at, stamp, group = 0, 0, None
    while at < len(data):
        begin = at
        ident, at, _ = _vint_at(data, at, keep=True)
        size, at, width = _vint_at(data, at)
        if ident in MASTERS:
            if ident == SEGMENT:
                out["segment"] = at
            elif ident == CLUSTER:
                out["clusters"] += 1
                out["at"] = begin
            elif ident == TRACK_ENTRY:
                out["tracks"].append({})
            elif ident == CUE_POINT:
                cue = {}
                out["cues"].append(cue)
            elif ident == BLOCK_GROUP:
                group = len(out["packets"])
            continue
        end = at + size
        if size == (1 << 7 * width) - 1 or end > len(data):
            raise ValueError(f"element {ident:x} at byte {begin} leads outside the file")
        number = lambda a=at, b=end: int.from_bytes(data[a:b], "big")
        if ident in (SIMPLE_BLOCK, BLOCK):
            track, p, _ = _vint_at(data, at)
            relative, flags = struct.unpack_from(">hB", data, p)
            lacing = flags >> 1 & 3
            step = next((t.get("frame", 0) for t in out["tracks"] if t.get("number") == track), 0)
            for k, (offset, n) in enumerate(_laced(data, p + 3, end, lacing)):
                out["packets"].append((track, (stamp + relative) * out["scale"] + k * step, bool(flags & 0x80) or ident == BLOCK, lacing, out["clusters"] - 1, offset, n, sum(out["blocks"])))
            out["blocks"][lacing] += 1
        elif ident == TIMESTAMP:
            stamp = number()
        elif ident == REFERENCE_BLOCK and group is not None:  # a block that refers to others is no keyframe
            out["packets"][group:] = [(*x[:2], False, *x[3:]) for x in out["packets"][group:]]
        elif ident in (TRACK_NUMBER, DEFAULT_DURATION) and out["tracks"]:
            out["tracks"][-1]["number" if ident == TRACK_NUMBER else "frame"] = number()
        elif ident == CODEC_ID and out["tracks"]:
            out["tracks"][-1]["codec"] = data[at:end].decode()
        elif ident == TIMESTAMP_SCALE:
            out["scale"] = number()
        elif ident == DURATION:
            out["duration"] = struct.unpack(">d" if size == 8 else ">f", data[at:end])[0]
        elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION) and out["cues"]:
            cue[ident] = number()
        at = end
    out["cues"] = [(x.get(CUE_TIME, 0) * out["scale"], x.get(CUE_TRACK, 0), out["segment"] + x.get(CUE_CLUSTER_POSITION, 0)) for x in out["cues"]]
    return out


def media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table key, n_bytes, media: each whole text, padded with spaces to whole frames, as a file."""

    def write(batches):
        for batch in common.slices(batches, text, SLICE_BYTES):
            texts = common.strings(batch.column(text))
            files = [mux(t + b" " * (max(-(-len(t) // FRAME_BYTES), 1) * FRAME_BYTES - len(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=[key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return common.written(docs.select(key, text).mapInArrow(write, f"`{key}` {kind}, n_bytes long, media binary"), "media", compression="zstd")


def _files(batches, column: str):
    for batch in batches:
        yield from common.parts(batch, column, SLICE_BYTES)


def packets(files: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet: key, packet, track, timestamp_ns, keyframe, lacing, cluster, block, offset, size."""

    def read(batches):
        for batch in _files(batches, column):
            rows = [(i, k, *p) for i, data in enumerate(batch.column(column).to_pylist()) if data for k, p in enumerate(parse(data)["packets"])]
            if rows:
                of, *columns = zip(*rows, strict=True)
                number, track, stamp, keyframe, lacing, cluster, offset, size, block = columns
                kinds = ((number, pa.int64()), (track, pa.int64()), (stamp, pa.int64()), (keyframe, pa.bool_()), (lacing, pa.int32()), (cluster, pa.int64()), (block, pa.int64()), (offset, pa.int64()), (size, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(of)), *(pa.array(x, kind) for x, kind in kinds)], names=[key, "packet", "track", "timestamp_ns", "keyframe", "lacing", "cluster", "block", "offset", "size"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, column).mapInArrow(read, f"`{key}` {kind}, packet long, track long, timestamp_ns long, keyframe boolean, lacing int, cluster long, block long, offset long, size long")


def cues(files: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per cue: key, timestamp_ns, track, offset (of the cluster in the file)."""

    def read(batches):
        for batch in _files(batches, column):
            rows = [(i, *c) for i, data in enumerate(batch.column(column).to_pylist()) if data for c in parse(data)["cues"]]
            if rows:
                of, stamp, track, at = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(of)), *(pa.array(x, pa.int64()) for x in (stamp, track, at))], names=[key, "timestamp_ns", "track", "offset"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, column).mapInArrow(read, f"`{key}` {kind}, timestamp_ns long, track long, offset long")


def describe(data: bytes) -> tuple[bytes, str]:
    """The samples of a file, packet by packet, and what they and the container show."""
    found = parse(data)
    payload = b"".join([data[o : o + n] for *_, o, n, _ in found["packets"]])
    levels = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    steps = levels * np.arange(256)
    last = found["packets"][-1][1] if found["packets"] else 0
    parts = {
        "codec": found["tracks"][0].get("codec", "") if found["tracks"] else "", "tracks": len(found["tracks"]), "clusters": found["clusters"], "lacing": ":".join(map(str, found["blocks"])),
        "packets": len(found["packets"]), "cues": len(found["cues"]), "ms": round(found["duration"]), "last_ns": last, "levels": int((levels > 0).sum()), "peak": int(np.flatnonzero(levels)[-1]) if payload else 0, "sum": int(steps.sum()), "energy": int((steps * np.arange(256)).sum()),
    }
    return payload, ";".join(f"{k}={v}" for k, v in parts.items())


def digests(files: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per file of media(): sizes, checks of the samples read back and of the file, feature."""

    def read(batches):
        for batch in _files(batches, column):
            rows = []
            for data in (x or b"" for x in batch.column(column).to_pylist()):
                payload, feature = describe(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            size, sha, tail, total, whole, feature = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("n_bytes"), pa.array(size, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), pa.array(total, pa.int64()), pa.array(whole), pa.array(feature)],
                names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "n_bytes", column).mapInArrow(read, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(media(common.read(spark, sf_dir, "documents")))
