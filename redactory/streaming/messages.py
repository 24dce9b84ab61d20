"""Chat messages over streams: findings are held until enough are together or the first has waited long enough.

What is held is list state of a channel's shard, and the wait is a timer of processing time: both outlive micro-batches,
partitions and restarts. A message that is closed by its size leaves the rest to a new wait.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "shard int, bodies array<string>"


class Together(StatefulProcessor):
    def __init__(self, size: int, age_ms: int):
        self.size, self.age_ms = size, age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "body string")
        self.since = handle.getValueState("since", "at long")

    def _close(self, key, bodies: list[str]) -> Row:
        return Row(shard=key[0], bodies=bodies)

    def _timers(self, since: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if since is not None:
            self.handle.registerTimer(since + self.age_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = [r[0] for r in self.held.get()] if self.since.exists() else []
        since, out = self.since.get()[0] if self.since.exists() else now, []
        for r in rows:
            held.append(r.body)
            if len(held) == self.size:
                out.append(self._close(key, held))
                held, since = [], now
        if held:
            self.held.put([(b,) for b in held])
            self.since.update((since,))
            self._timers(since)
        else:
            self._clear()
        return iter(out)

    def _clear(self) -> None:
        self.held.clear()
        self.since.clear()
        self._timers(None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.since.exists():
            return iter([])
        held = [r[0] for r in self.held.get()]
        self.held.clear()
        self.since.clear()
        return iter([self._close(key, held)])

    def close(self) -> None:
        pass


def together(bodies: DataFrame, size: int = 8, age_ms: int = 2000, shards: int = 1) -> DataFrame:
    """``(shard, bodies)``: messages of the column ``body`` of a stream, closed at ``size`` or ``age_ms`` after the first.

    ``shards`` divides a stream of very many findings, whose messages then close apart. Needs the RocksDB state store provider.
    """
    rows = bodies.select(F.pmod(F.xxhash64("body"), F.lit(shards)).cast("int").alias("shard"), "body")
    return rows.groupBy("shard").transformWithState(Together(size, age_ms), OUT, "append", "processingTime")
