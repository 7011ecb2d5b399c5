"""Resources behind a paged API as a Spark source, in batch and as a stream that resumes where it stopped.

    spark.dataSource.register(PagedSource)
    spark.readStream.format("paged").schema("id long, name string").options(
        url="https://host/api?resource={resource}&after={after}&limit={limit}",
        newest="https://host/api?resource={resource}&order=desc&limit=1",
        resources="a,b", key="id", limit="1000", records="result.records").load()

A page is a JSON document with records in rising order of an integer or text key, all of them beyond `after`. The offset of the
stream is the last key of each resource: a batch is, for each, the keys beyond the one before up to the newest there is, which
Spark's checkpoint names before anything is read. A task that stops in the middle of a page is run
again over the same keys and its rows are dropped, so a resumed stream neither loses nor repeats rows.
Integer keys are cut in ranges of `width`, which tasks read side by side, page by page.

`url` may be a folder of saved pages instead, on any file system that pyarrow opens: `<url>/resource=<name>/after=<key>/`
with one document a line, each folder holding the records from its key on to that of the next folder; `newest` isn't needed.
Rows have the key in `key`, their resource in `resource` if the schema names one, and null for what a record lacks.
"""

from __future__ import annotations

import datetime
import http.client
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import BinaryType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType, StructType, TimestampType

Key = int | str | None
TRIES = 4


class Span(InputPartition):
    """Keys of a resource beyond `after`, up to `end`."""

    def __init__(self, resource: str, after: Key, end: Key):
        self.resource, self.after, self.end = resource, after, end


def _value(x: Any, kind: DataType) -> Any:
    """A JSON value as a Spark value of a type; null where it isn't one."""
    if x is None:
        return None
    try:
        if isinstance(kind, StringType):
            return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        if isinstance(kind, TimestampType):
            return datetime.datetime.fromisoformat(x)
        if isinstance(kind, DateType):
            return datetime.date.fromisoformat(x[:10])
        if isinstance(kind, DecimalType):
            return Decimal(str(x))
        if isinstance(kind, (DoubleType, FloatType)):
            return float(x)
        if isinstance(kind, IntegralType):
            return int(x)
        if isinstance(kind, BinaryType):
            return str(x).encode()
    except (ValueError, TypeError, ArithmeticError):
        return None
    return x


class Pages:
    """Fetches pages; small enough to go to each task."""

    def __init__(self, options: dict[str, str]):
        self.url, self.newest_url = options["url"], options.get("newest")
        self.key, self.records = options["key"], options.get("records", "result.records").split(".")
        self.limit = int(options.get("limit", "1000"))
        self.saved = not self.url.startswith(("http://", "https://"))

    def _parsed(self, text: bytes | str) -> list[dict]:
        found = json.loads(text)
        for name in self.records:
            found = found[name]
        return found

    def _asked(self, template: str, resource: str, after: Key) -> list[dict]:
        values = {"resource": resource, "after": "" if after is None else after, "limit": self.limit}
        url = template.format(**{k: urllib.parse.quote(str(v), safe="") for k, v in values.items()})
        for left in reversed(range(TRIES)):
            try:
                with urllib.request.urlopen(url, timeout=60) as answer:
                    return self._parsed(answer.read())
            except (OSError, ValueError, http.client.HTTPException):
                if not left:
                    raise
                time.sleep(0.2 * 2 ** (TRIES - left))
        raise AssertionError

    def _folder(self, resource: str):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.url) if "://" in self.url else (fs.LocalFileSystem(), self.url)
        path = f"{root.rstrip('/')}/resource={resource}"
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return system, []
        own = [(x.path.rpartition("after=")[2], x.path) for x in system.get_file_info(fs.FileSelector(path)) if "after=" in x.base_name]
        numbers = all(k.lstrip("-").isdigit() for k, _ in own)
        return system, sorted((int(k) if numbers else urllib.parse.unquote(k), p) for k, p in own)

    def _stored(self, system, path: str) -> list[dict]:
        from pyarrow import fs

        out = []
        for file in system.get_file_info(fs.FileSelector(path)):
            if file.is_file and not file.base_name.startswith(("_", ".")):
                with system.open_input_stream(file.path) as f:
                    out += [r for line in f.read().splitlines() if line.strip() for r in self._parsed(line)]
        return sorted(out, key=lambda r: r[self.key])

    def newest(self, resource: str) -> Key:
        """The last key of a resource, or none."""
        if self.saved:
            system, own = self._folder(resource)
            rows = self._stored(system, own[-1][1]) if own else []
        elif self.newest_url:
            rows = self._asked(self.newest_url, resource, None)
        else:
            rows = [{self.key: after} for after in (r[self.key] for page in self.pages(resource, None, None) for r in page[-1:])]
        return max((r[self.key] for r in rows), default=None)

    def first(self, resource: str) -> Key:
        return next((page[0][self.key] for page in self.pages(resource, None, None) if page), None)

    def pages(self, resource: str, after: Key, end: Key) -> Iterator[list[dict]]:
        """Pages with the records beyond `after`, up to `end` if there is one."""
        if self.saved:
            system, own = self._folder(resource)
            for k, (start, path) in enumerate(own):
                over = after is not None and k + 1 < len(own) and own[k + 1][0] <= after
                if not over and (end is None or start < end):
                    yield [r for r in self._stored(system, path) if (after is None or r[self.key] > after) and (end is None or r[self.key] <= end)]
            return
        while True:
            page = self._asked(self.url, resource, after)
            yield [r for r in page if end is None or r[self.key] <= end]
            if not page or end is not None and page[-1][self.key] >= end:
                return
            after = page[-1][self.key]


class _Spans:
    """What both readers share."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.source = schema, Pages(options)
        self.resources = [r.strip() for r in options["resources"].split(",") if r.strip()]
        self.width = int(options.get("width", "100000"))

    def spans(self, resource: str, after: Key, end: Key) -> list[Span]:
        if end is None or after is not None and after >= end:
            return []
        if not isinstance(end, int):
            return [Span(resource, after, end)]
        start = after if after is not None else self.source.first(resource) - 1
        return [Span(resource, k, min(k + self.width, end)) for k in range(start, end, self.width)]

    def rows(self, span: Span) -> Iterator[tuple]:
        fields = [(f.name, f.dataType) for f in self.schema.fields]
        for page in self.source.pages(span.resource, span.after, span.end):
            for record in page:
                own = {"resource": span.resource, **record}
                yield tuple(_value(own.get(name), kind) for name, kind in fields)


class PagedReader(_Spans, DataSourceReader):
    def partitions(self) -> list[Span]:
        return [s for r in self.resources for s in self.spans(r, None, self.source.newest(r))] or [Span("", None, None)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.rows(partition) if partition.resource else iter(())


class PagedStream(_Spans, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return dict.fromkeys(self.resources)

    def latestOffset(self) -> dict:
        return {r: self.source.newest(r) for r in self.resources}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [s for r in self.resources for s in self.spans(r, start.get(r), end.get(r))]

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.rows(partition)


class PagedSource(DataSource):
    """See the module. Options: url, resources, key; newest, records, limit, width."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStream(schema, dict(self.options))
