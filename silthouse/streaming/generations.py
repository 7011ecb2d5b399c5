"""Identities within a moving window of generations, as a stream whose state forgets."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State with timers needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Generations are this many seconds of event time later, as a stream's first watermark is 1970 and drops what is not after it.
SHIFT = 1 << 33


class LastSeen(StatefulProcessor):
    """The last generation of an identity, renewed at each sighting and dropped when it is out of the window."""

    def __init__(self, identity: list[str], generation: str, window: int):
        self.identity, self.generation, self.window = identity, generation, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "generation long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        last, fresh = before, []
        for g in sorted({int(g) for frame in rows for g in frame[self.generation]}):
            if last is None or g - last >= self.window:
                fresh.append(g)
            last = g if last is None else max(last, g)
        if last != before:
            if before is not None:
                self.handle.deleteTimer((before + self.window + SHIFT) * 1000)
            self.last.update((last,))
            self.handle.registerTimer((last + self.window + SHIFT) * 1000)
        yield pd.DataFrame({**dict(zip(self.identity, ([k] * len(fresh) for k in key))), self.generation: fresh}, dtype=object)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def generation_window_stream(stream: DataFrame, identity: list[str], generation: str, window: int, late: int = 0) -> DataFrame:
    """Identities unseen for `window` generations, as they come: the rows of ingest.generation_window over the same input.

    Generations are the stream's event time, one second each: state of an identity goes when all of them up to `late` behind the
    newest are past its window, so the state holds the identities of about window + late generations. Rows more than `late`
    generations behind earlier batches are left out. Needs the session's state store to be STORE.
    """
    spark = stream.sparkSession
    if not spark.conf.get(STORE[0], "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {STORE[0]} to {STORE[1]}")
    kinds = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in identity)
    rows = stream.select(*identity, F.col(generation).cast("long").alias(generation), F.timestamp_seconds(F.col(generation) + SHIFT).alias("_at"))
    grouped = rows.withWatermark("_at", f"{late + 1} seconds").groupBy(*identity)
    return grouped.transformWithStateInPandas(LastSeen(list(identity), generation, window), f"{kinds}, `{generation}` long", "append", "eventTime")
