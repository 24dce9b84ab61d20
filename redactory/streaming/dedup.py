"""The dedup window over streams: one time a key, kept in Spark's state store.

Time is the finding's own where ``time`` names a column (tests, replays), else the
time of processing. The window begins with each finding let through. State of a key
ends a window after the last that passed, so that keys that never come back take
no room.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..operators.dedup import KEY


class Passing(StatefulProcessor):
    def __init__(self, window_ms: int, order: list[str], time: str | None):
        self.window_ms, self.order, self.time = window_ms, order, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch.sort_values([*([self.time] if self.time else []), *self.order], kind="stable")
        last, keep = self.last.get()[0] if self.last.exists() else None, []
        now = None if self.time else timerValues.getCurrentProcessingTimeInMs()
        for t in batch[self.time] if self.time else [now] * len(batch):
            go = last is None or t - last >= self.window_ms
            last = int(t) if go else last
            keep.append(go)
        self.last.update((last,))
        if not self.time:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.window_ms)
        yield batch[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def passing(findings: DataFrame, window_ms: int = 300_000, order: tuple[str, ...] = ("lsn",), time: str | None = None, key: list[str] | None = None) -> DataFrame:
    """The findings of a stream that pass. Needs the RocksDB state store provider. A window of 0 lets all pass without state."""
    if window_ms <= 0:
        return findings
    return findings.groupBy(*(key or KEY)).transformWithStateInPandas(Passing(window_ms, list(order), time), findings.schema, "append", "none" if time else "processingTime")


def first_within(findings: DataFrame, time: str, delay: str, key: list[str] | None = None) -> DataFrame:
    """A faster mode by event time: the first of each key within a watermark's delay; later windows begin with any finding."""
    return findings.withWatermark(time, delay).dropDuplicatesWithinWatermark(key or KEY)




class Once(StatefulProcessor):
    """Lets a key pass once in a window of processing time. All that is kept of it is a value that Spark drops when the window ends."""

    def __init__(self, window_ms: int, order: list[str]):
        self.window_ms, self.order = window_ms, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]), self.window_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, n = None, 0
        for r in rows:
            n += r["n"]
            if first is None or [r[c] for c in self.order] < [first[c] for c in self.order]:
                first = r
        fresh = not self.last.exists()
        if fresh:
            self.last.update((timerValues.getCurrentProcessingTimeInMs(),))
        yield Row(**{k: v for k, v in first.asDict(recursive=False).items() if k != "n"}, n=n, fresh=fresh)

    def close(self) -> None:
        pass


def merged(findings: DataFrame, order: list[str], key: list[str]) -> DataFrame:
    """The first finding of a key in each Arrow batch, and ``n``, how many there were: a value that is everywhere is not shuffled row by row."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: dict[tuple, int] = {}
            n: dict[tuple, int] = {}
            places = list(zip(*[b.column(c).to_pylist() for c in order], strict=True))
            for i, k in enumerate(zip(*[b.column(c).to_pylist() for c in key], strict=True)):
                n[k] = n.get(k, 0) + 1
                if k not in at or places[i] < places[at[k]]:
                    at[k] = i
            kept = pa.array(at.values(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(kept) for c in b.columns), pa.array([n[k] for k in at], pa.int64())], [*b.schema.names, "n"])

    return findings.mapInArrow(first, StructType([*findings.schema.fields, StructField("n", LongType())]))


def once(findings: DataFrame, window_ms: int, order: tuple[str, ...] = ("lsn", "place"), key: list[str] | None = None) -> DataFrame:
    """A row for each key of a micro-batch, its first finding, with ``n``, how many findings it stands for, and ``fresh``, whether it passes the window.

    The window is kept in the state store by key alone, so that it goes on when what makes the findings changes between
    restarts. Needs the RocksDB state store provider. A window of 0 lets all pass without state.
    """
    if window_ms <= 0:
        return findings.withColumns({"n": F.lit(1).cast("long"), "fresh": F.lit(True)})
    key = key or KEY
    rows = merged(findings, list(order), key)
    out = StructType([*rows.schema.fields, StructField("fresh", BooleanType())])
    return rows.groupBy(*key).transformWithState(Once(window_ms, list(order)), out, "append", "processingTime")
