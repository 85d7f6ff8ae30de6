"""Debounced change sessions: many events of a path, one scan.

A session fires once nothing has come for ``quiet`` (at least), or ``max_delay`` after its first event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

NAMES = ["key", "first", "last", "n"]


def relevant(events: DataFrame) -> DataFrame:
    """Drops accesses, everything in a ``.git`` folder, and database files."""
    path = F.col("path")
    return events.where((F.col("kind") != "access") & ~path.rlike(r"(^|/)\.git(/|$)") & ~path.endswith(".db"))


def sessions(events: DataFrame, *, key: str, time: str, quiet: int, max_delay: int) -> DataFrame:
    """(key, first, last, n_events, fired_at, reason) in seconds, of events (key, time in seconds).

    Rows of a key stream by in order, with its open session as the only state: a gap of ``quiet``, or ``max_delay`` since the
    session's first event, begins another. Equal times are one moment; null times are left out.
    """
    rows = events.select(key, F.col(time).cast("long").alias("t"), F.lit(1).cast("long").alias("n")).where("t is not null")
    kind = rows.schema[key].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # key, first, last, n
        for b in batches:
            done = []
            for k, t, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now and now[0] == k and (t == now[2] or t - now[2] < quiet and t - now[1] < max_delay):
                    now = (k, now[1], t, now[3] + n)
                else:
                    done += [now] if now else []
                    now = (k, t, t, n)
            yield pa.RecordBatch.from_arrays([pa.array(x, c.type) for x, c in zip(zip(*done, strict=True), (b.column(0), b.column(1), b.column(1), b.column(2)), strict=True)] if done else [b.column(j).slice(0, 0) for j in (0, 1, 1, 2)], NAMES)
            types = [b.column(j).type for j in (0, 1, 1, 2)]
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], c) for x, c in zip(now, types, strict=True)], NAMES)

    cut = rows.repartition(F.col(key)).sortWithinPartitions(key, "t").mapInArrow(cut_up, f"key {kind}, first long, last long, n long").withColumnRenamed("key", key)
    fired = F.least(F.col("last") + quiet, F.col("first") + max_delay)
    reason = F.when(F.col("first") + max_delay < F.col("last") + quiet, "max_delay").otherwise("quiet")
    return cut.select(key, "first", "last", F.col("n").alias("n_events"), fired.alias("fired_at"), reason.alias("reason"))


class Debounce(StatefulProcessor):
    """Per key: first and last processing time of the open session and its events; a timer stands where it fires."""

    def __init__(self, quiet_ms: int, max_delay_ms: int):
        self.quiet, self.max_delay = quiet_ms, max_delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField(c, LongType()) for c in ("first", "last", "n")]
        self.handle, self.open = handle, handle.getValueState("open", StructType(fields))

    def _due(self, first: int, last: int) -> int:
        return min(last + self.quiet, first + self.max_delay)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, now = sum(len(x) for x in rows), timerValues.getCurrentProcessingTimeInMs()
        first, seen = now, 0
        if self.open.exists():
            first, last, seen = self.open.get()
            self.handle.deleteTimer(self._due(first, last))
        self.open.update((first, now, seen + n))
        self.handle.registerTimer(self._due(first, now))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            first, last, n = self.open.get()
            self.open.clear()
            yield pd.DataFrame({"key": [key[0]], "n_events": [n], "waited_ms": [self._due(first, last) - first]})

    def close(self) -> None:
        pass


def debounced(stream: DataFrame, *, key: str, quiet_ms: int = 60_000, max_delay_ms: int = 600_000) -> DataFrame:
    """(key, n_events, waited_ms) whenever a session of the stream fires, by processing time."""
    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).transformWithStateInPandas(Debounce(quiet_ms, max_delay_ms), f"key {kind}, n_events bigint, waited_ms bigint", "Append", "ProcessingTime")
