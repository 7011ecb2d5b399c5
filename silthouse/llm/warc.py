"""WARC archives of page captures, and their index by an external merge.

1. Digest every payload; the smallest id of a digest is the response, the others revisit it.
2. Each task writes its captures, sorted by URL key, timestamp and id, as one archive: a gzip member
   for each record, kept as rows (archive, offset, member) whose concatenation is the file.
3. The archives are read back: every record is parsed again. The index rows are written, archive by
   archive, which keeps a sorted run of each in storage.
4. The runs are cut by ranges of (URL key, timestamp, id, place), as many that a range has about
   MERGE_ROWS rows, and each task merges the parts of all runs that lie in its range with a loser tree.
   Parts are Arrow columns; the tree takes CHUNK_ROWS rows of each part at a time and gives
   out a batch whenever it has as many. A range holds index rows only, never payloads, and the place
   in an archive makes every row's rank its own, so a URL with very many captures is split as well.
5. Ranges are numbered on from each other, which numbers the histories without gaps.

Timestamps: captures carry no time of their own unless a column is named; without one, times are seconds
from EPOCH on by the id, modulo SPAN seconds, so every 64-bit id has one.

Nulls and edges: a null payload is empty; payloads below MIN_BYTES are all responses. Of rows
with equal payload and the same smallest id, each is a response. A null id is a revisit, or a
response where its payload has no other id. A null url is an empty one; control characters in a
url are escaped. A record that can't be read is an index row with its `error` and no digest, and comes
first in its URL's history, such rows by id; so does a capture whose time is beyond the years 1 to 9999, as no
record can name it. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from itertools import islice, pairwise
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silthouse.llm import common, urls

MIN_BYTES = 0
BATCH_BYTES = 4 << 20
#: Rows of a range that one task merges, and rows that the loser tree takes or gives at a time.
MERGE_ROWS, CHUNK_ROWS = 1 << 18, 1 << 12
EPOCH, SPAN = datetime(2024, 1, 1, tzinfo=UTC), 1 << 31
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Sort-friendly key: the host's labels from the last to the first, then the path."""
    labels = F.reverse(F.split(urls.host(url), r"\."))
    return F.concat(F.array_join(labels, ","), F.lit(")"), F.lower(urls.path(url)))


def _head(name: str, fields: list[tuple[str, str]]) -> bytes:
    return (name + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(name: str, url: str, when: datetime, payload: bytes, refers_to: str | None) -> bytes:
    """A WARC/1.1 response record, or a revisit record without the payload, as a gzip member."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:capture:{quote(name)}>"), ("WARC-Date", when.replace(tzinfo=None).isoformat(timespec="seconds") + "Z")]
    fields += [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)), ("WARC-Payload-Digest", digest)]
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:capture:{quote(refers_to)}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(_head("WARC/1.1", fields) + block + b"\r\n\r\n") + pack.flush()


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def parse(member: bytes) -> dict:
    """Type, date, digest, payload size and reference of one record; a response's payload is digested again."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if not head.startswith(b"WARC/1.") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_fields(http)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} has digest {found}, not {digest}")
    return {"record_type": fields["warc-type"], "ts": fields["warc-date"], "payload_bytes": size, "payload_digest": digest, "refers_to": fields.get("warc-refers-to"), "error": None}


def _moment(at: int) -> datetime | None:
    """The time of so many seconds since 1970; none beyond the years 1 to 9999."""
    try:
        return datetime.fromtimestamp(at, UTC)
    except (ValueError, OverflowError, OSError):
        return None


def _read(member: bytes | None) -> dict:
    if member is None:
        return {"error": "no record: it is missing, or its time is beyond the years 1 to 9999"}
    try:
        return parse(member)
    except (ValueError, KeyError, zlib.error) as e:
        return {"error": f"{type(e).__name__}: {e}"}


def archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES, when: str | None = None) -> DataFrame:
    """Written archives: archive, offset, length, key, url_key, member; archive by archive in sorted order. `when` names a timestamp column."""
    body = F.coalesce(F.col(payload), F.lit(""))
    start = F.lit(int(EPOCH.timestamp()))
    at = F.coalesce(F.unix_timestamp(when), start) if when else start + F.pmod(F.coalesce(F.expr(f"try_cast(`{key}` AS bigint)"), F.lit(0)), F.lit(SPAN))
    own = pages.select(F.col(key), F.coalesce(F.col(url), F.lit("")).alias("_url"), url_key(F.col(url)).alias("url_key"), at.alias("_at"), F.encode(body, "utf-8").alias("_payload"), F.sha1(F.encode(body, "utf-8")).alias("_digest"))
    first = own.groupBy("_digest").agg(F.min(key).alias("_first"))
    kept = own[key].eqNullSafe(F.col("_first")) | (F.length("_payload") < min_bytes)
    typed = own.join(first, "_digest").withColumn("_first", F.when(~kept, F.col("_first").cast("string")))
    ready = typed.select(key, F.col(key).cast("string").alias("_name"), "_url", "url_key", "_at", "_first", "_payload").sortWithinPartitions("url_key", "_at", key)

    def write(batches):
        archive, offset = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in common.parts(batch, "_payload", BATCH_BYTES):
                rows = []
                columns = [part.column(c).to_pylist() for c in ("_name", "_url", "_at", "_payload", "_first")]
                for name, link, at, body, refers in zip(*columns, strict=True):
                    moment = _moment(at)
                    member = moment and record(name or "", link, moment, body, refers)
                    rows.append((offset, len(member or b""), member))
                    offset += len(member or b"")
                at, length, member = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive] * len(rows), pa.int32()), pa.array(at, pa.int64()), pa.array(length, pa.int64()), part.column(key), part.column("url_key"), pa.array(member, pa.binary())],
                    names=["archive", "offset", "length", key, "url_key", "member"],
                )

    kind = pages.schema[key].dataType.simpleString()
    return common.written(ready.mapInArrow(write, f"archive int, offset long, length long, `{key}` {kind}, url_key string, member binary"), "archives")


_READ = (("ts", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("error", pa.string()))


def index(stored: DataFrame, key: str = "page_id") -> DataFrame:
    """Written index rows of the archives' records, parsed from the stored bytes: a sorted run for each archive."""

    def read(batches):
        for batch in batches:
            for part in common.parts(batch, "member", BATCH_BYTES):
                found = [_read(m) for m in part.column("member").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("archive", "offset", "length", key, "url_key")), *(pa.array([x.get(c) for x in found], kind) for c, kind in _READ)],
                    names=["archive", "offset", "length", key, "url_key", *(c for c, _ in _READ)],
                )

    kind = stored.schema[key].dataType.simpleString()
    rows = stored.mapInArrow(read, f"archive int, offset long, length long, `{key}` {kind}, url_key string, ts string, record_type string, payload_bytes long, payload_digest string, refers_to string, error string")
    return common.written(rows, "runs")


def merged(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """The rows of sorted runs in one order, by a tree of losers: one comparison for each level and row."""
    sources = [iter(r) for r in runs]
    heads = [next(s, None) for s in sources]
    k = len(sources)
    tree = [-1] * k  # node n plays its children's winners; its loser stays, 0 has the winner

    def beats(a: int, b: int) -> bool:
        return heads[a] is not None and (heads[b] is None or heads[a] <= heads[b])

    def settle(run: int) -> None:
        node = (run + k) // 2
        while node > 0:
            if tree[node] < 0:  # at the start: wait here for the other child's winner
                tree[node] = run
                return
            if beats(tree[node], run):
                tree[node], run = run, tree[node]
            node //= 2
        tree[0] = run

    for run in range(k):
        settle(run)
    while k and heads[tree[0]] is not None:
        run = tree[0]
        yield heads[run]
        heads[run] = next(sources[run], None)
        settle(run)


def _ranked(part: pa.Table, key: str, start: int) -> Iterator[tuple]:
    """(rank, row number, counted from start) of a sorted part, from a few rows at a time."""
    for a in range(0, len(part), CHUNK_ROWS):
        chunk = part.slice(a, CHUNK_ROWS)
        columns = [chunk.column(c).to_pylist() for c in ("url_key", "ts", key, "archive", "offset")]
        for k, (link, ts, own, archive, offset) in enumerate(zip(*columns, strict=True)):
            yield (link, ts or "", own is not None, own if own is not None else 0, archive, offset), start + a + k


def _parts(batches: Iterable[pa.RecordBatch], key: str) -> list[pa.Table]:
    """The rows that arrive, as few parts that are each in order: rows of an archive that follow each other are.

    Rows with an error have lost the time that placed them in their archive; they are sorted as a part of their own.
    """
    bad: list[pa.RecordBatch] = []
    held: dict[tuple[int, int], list[pa.RecordBatch]] = {}
    last: dict[int, tuple[int, int]] = {}  # of each archive, its open part and the offset it has come to
    for whole in batches:
        failed = whole.column("error").is_valid()
        bad.append(whole.filter(failed))
        batch = whole.filter(pc.invert(failed))
        archive, offset = batch.column("archive").to_numpy(), batch.column("offset").to_numpy()
        cuts = np.flatnonzero((archive[1:] != archive[:-1]) | (offset[1:] <= offset[:-1])) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            run = int(archive[a])
            part, come = last.get(run, (0, -1))
            part += come >= int(offset[a])
            last[run] = part, int(offset[b - 1])
            held.setdefault((run, part), []).append(batch.slice(a, b - a))
    parts = [pa.Table.from_batches(x) for x in held.values()]
    lost = pa.Table.from_batches(bad) if bad else None
    if lost is not None and len(lost):
        order = [(c, "ascending") for c in ("url_key", key, "archive", "offset")]
        parts.append(lost.take(pc.sort_indices(lost, order, null_placement="at_start")))
    return parts


def histories(runs: DataFrame, key: str = "page_id") -> DataFrame:
    """The index rows in one global order by URL key, timestamp and id; `history_at` numbers them in it, from 0 without gaps."""

    def merge(batches):
        number, at = TaskContext.get().partitionId(), 0
        parts = _parts(batches, key)
        if not parts:
            return
        whole = pa.concat_tables(parts)
        starts = np.cumsum([0, *map(len, parts)]).tolist()
        order = merged([_ranked(part, key, start) for part, start in zip(parts, starts, strict=False)])
        while taken := [k for _, k in islice(order, CHUNK_ROWS)]:
            rows = whole.take(pa.array(taken)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([number] * len(taken), pa.int32()), pa.array(range(at, at + len(taken)), pa.int64())], names=[*rows.schema.names, "_range", "_at"])
            at += len(taken)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    n = max(common.partitions(runs.sparkSession), -(-runs.count() // MERGE_ROWS))
    order = [F.col("url_key"), F.coalesce("ts", F.lit("")), F.col(key), F.col("archive"), F.col("offset")]
    ranged = common.written(runs.repartitionByRange(n, *order).mapInArrow(merge, f"{kind}, _range int, _at long"), "histories")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return ranged.join(before, "_range").withColumn("history_at", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES, when: str | None = None) -> DataFrame:
    """Archives written, read back and merged: one index row per page; `history_at` is its place in the global order."""
    found = histories(index(archives(pages, key, url, payload, min_bytes, when), key), key)
    back = F.url_decode(F.regexp_extract("refers_to", "^<urn:capture:(.*)>$", 1))
    return found.withColumn("refers_to", F.when(F.col("refers_to").isNotNull(), back).cast(pages.schema[key].dataType))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(common.read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "history_at")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex,
         array_to_string(list_reverse(string_split(translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.')), ',')
           || ')' || lower(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '')) AS url_key,
         TIMESTAMP '2024-01-01' + to_seconds(page_id % 2147483648) AS taken
  FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT p.page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((('0x' || substr(p.hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to,
       url_key, strftime(taken, '%Y-%m-%dT%H:%M:%SZ') AS ts, row_number() OVER (ORDER BY url_key, taken, page_id) - 1 AS history_at
FROM p JOIN f USING (hex)
"""
