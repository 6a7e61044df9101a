"""Stateful operators with value state and event-time timers, so that state ends when it no longer matters.

State lives in RocksDB; start such a stream with ``jobs.run_to_table(...,
stateful=True)`` or set the session's state store provider. Rows of one key in
one micro-batch are ordered by time in the task, eight bytes each. Times are
read to the microsecond; rows without a time are left out. Rows behind the
watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _times(rows: Iterator[pd.DataFrame], column: str) -> list[int]:
    parts = [pdf[column].dropna().to_numpy("int64") for pdf in rows]
    return np.sort(np.concatenate(parts)).tolist() if parts else []


class _Timed(StatefulProcessor):
    """One value state ``at`` in microseconds, and one timer that ends it."""

    def __init__(self, names: Sequence[str], kept: int):
        self.names, self.kept = list(names), kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "at bigint")

    def held(self) -> int | None:
        return int(self.at.get()[0]) if self.at.exists() else None

    def hold(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(timer[0] if isinstance(timer, tuple) else timer))
        self.at.update((at,))
        self.handle.registerTimer(-(-(at + self.kept) // 1000))

    def frame(self, key: tuple, rows: list[tuple], columns: Sequence[str]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=list(columns))
        for i, name in enumerate(self.names):
            out.insert(i, name, key[i])
        return out

    def close(self) -> None:
        pass


class Spaced(_Timed):
    """The first row of a key, and after it every first row that is at least ``kept`` later than the last one let through."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, out = self.held(), []
        for t in _times(rows, "at_us"):
            if last is None or t >= last + self.kept:
                out.append((t,))
                last = t
        if out:
            self.hold(last)
            yield self.frame(key, out, ["at_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.at.clear()
        return iter(())


class Presence(_Timed):
    """``online`` at the first touch and ``offline`` once a key was not touched for ``kept``."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, out = self.held(), []
        times = _times(rows, "at_us")
        for t in times:
            if last is None or t > last + self.kept:
                out += [] if last is None else [("offline", last + self.kept)]
                out.append(("online", t))
            last = t if last is None else max(last, t)
        if times:
            self.hold(last)
        if out:
            yield self.frame(key, out, ["state", "at_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if (last := self.held()) is not None:
            self.at.clear()
            yield self.frame(key, [("offline", last + self.kept)], ["state", "at_us"])


def _run(rows: DataFrame, keys: Sequence[str], ts: str, late: str, processor: _Timed, extra: str = "") -> DataFrame:
    named = rows.select(*[F.col(k).cast(StringType()).alias(k) for k in keys], F.col(ts).alias("at_time"), F.unix_micros(ts).alias("at_us"))
    schema = ", ".join([f"`{k}` string" for k in keys] + ([extra] if extra else []) + ["at_us bigint"])
    out = named.withWatermark("at_time", late).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return out.withColumn(ts, F.timestamp_micros("at_us")).drop("at_us")


def spaced(rows: DataFrame, keys: Sequence[str], seconds: int, ts: str = "created_at", late: str = "0 seconds") -> DataFrame:
    """``keys, ts`` of the rows let through: the first of a key and then none for so many seconds.

    Used for the cooldown of alerts and for exposures that count anew after a
    while. A key's state ends with its wait.
    """
    return _run(rows, keys, ts, late, Spaced(keys, seconds * 1_000_000))


def presence(rows: DataFrame, keys: Sequence[str], seconds: int = 600, ts: str = "created_at", late: str = "0 seconds") -> DataFrame:
    """``keys, state, ts``: when each key comes online and, after so many seconds without a touch, goes offline."""
    return _run(rows, keys, ts, late, Presence(keys, seconds * 1_000_000), "state string")
