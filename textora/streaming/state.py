"""Keyed state on streams: stages that never end, and duplicates known for ever.

Both keep their state in RocksDB, so it may outgrow memory, and go on from the checkpoint after a restart. The session must
name the provider: spark.conf.set(*PROVIDER).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Stages(StatefulProcessor):
    """Begin and end of each stage; a timer ends the wait."""

    def __init__(self, wait_ms: int) -> None:
        self.wait = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.begun = handle.getValueState("begun", "at timestamp")
        self.ended = handle.getValueState("ended", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            state, pick = (self.begun, min) if r.kind == "start" else (self.ended, max)
            state.update((pick(state.get()[0], r.ts) if state.exists() else r.ts,))
        if self.begun.exists() and self.ended.exists():
            yield self._told(key, True)
        else:
            self._forget()
            at = (self.begun if self.begun.exists() else self.ended).get()[0]
            self.handle.registerTimer(int(at.timestamp() * 1000) + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.begun.exists() or self.ended.exists():
            yield self._told(key, False)

    def _told(self, key, finished: bool) -> Row:
        begun, ended = (s.get()[0] if s.exists() else None for s in (self.begun, self.ended))
        seconds = (ended - begun).total_seconds() if finished else None
        self.begun.clear()
        self.ended.clear()
        if finished:
            self._forget()
        return Row(span=key[0], started=begun, seconds=seconds, finished=finished)

    def _forget(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def close(self) -> None:
        pass


def stage_times(rows: DataFrame, wait_ms: int = 3_600_000, late: str = "2 hours") -> DataFrame:
    """(span, started, seconds, finished) of a stream of (span, kind: start or end, ts).

    A stage is told once both of its rows have come, in whatever order and however far apart in batches; one whose other
    row has not come when the watermark is wait_ms past the first is told unfinished, with null seconds. Of several rows of a kind the
    first start and the last end of a batch count. A null span is a span like others.
    """
    timed = rows.withColumn("ts", rows["ts"].cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("span").transformWithState(_Stages(wait_ms), "span string, started timestamp, seconds double, finished boolean", "append", "eventTime")


class _First(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "times long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.seen.get()[0] if self.seen.exists() else 0
        n, first = 0, None
        for r in rows:
            n += 1
            first = r.item if first is None or r.item < first else first
        self.seen.update((known + n,))
        if not known:
            yield Row(key=key[0], item=first)

    def close(self) -> None:
        pass


def first_ever(rows: DataFrame) -> DataFrame:
    """(key, item) of a stream of (key, item): the first item of each key that has ever come; of one batch the least.

    Keys are never forgotten: pass digests, not texts.
    """
    return rows.groupBy("key").transformWithState(_First(), "key string, item long", "append", "none")
