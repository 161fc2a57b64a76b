"""Sources that fall silent: gaps between the rows of a source, as a table and by event-time timers over a stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidemill.functions.ordered import with_next

# Task code travels with its functions, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = StructType([StructField("newest", LongType()), StructField("reported", BooleanType())])


def stalls(rows: DataFrame, source: str, time: str, tie: str, seconds: int, until: Column) -> DataFrame:
    """(source, last_at) of each row after which its source was silent for more than ``seconds``, up to ``until``."""
    ahead = with_next(rows.filter(F.col(source).isNotNull() & F.col(time).isNotNull()).select(source, time, tie),
                      [source], time, tie, {"next_at": time})
    silent = F.unix_micros(F.coalesce("next_at", until).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
    return ahead.filter(silent > seconds * 1_000_000).select(source, F.col(time).alias("last_at"))


class StallWatch(StatefulProcessor):
    """Newest event time per source, with a timer that goes off when the watermark has passed it by more than allowed."""

    def __init__(self, micros: int):
        self.micros = micros

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("newest", STATE)

    def _timer(self, newest: int) -> int:
        return (newest + self.micros) // 1000 + 1

    def _report(self, key, times: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"source": pd.Series([key[0]] * len(times), dtype=object), "last_us": np.array(times, np.int64)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.unique(np.concatenate([r["us"].to_numpy(np.int64) for r in rows]))
        newest, reported = self.state.get() if self.state.exists() else (None, False)
        if newest is not None:
            times = times[times > newest]
        if len(times):
            chain = times if newest is None else np.concatenate([[newest], times])
            silent = chain[:-1][np.diff(chain) > self.micros].tolist()
            if newest is not None:
                self.handle.deleteTimer(self._timer(newest))
                silent = silent[1:] if reported and silent[:1] == [newest] else silent
            self.state.update((int(times[-1]), False))
            self.handle.registerTimer(self._timer(int(times[-1])))
            yield self._report(key, silent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, reported = self.state.get()
        if not reported and self._timer(newest) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((newest, True))
            yield self._report(key, [newest])

    def close(self) -> None:
        pass


def watch(rows: DataFrame, source: str, time: str, seconds: int, lateness: str) -> DataFrame:
    """``stalls`` of a stream: each is reported once, as soon as the watermark or the source's next row proves it."""
    slim = rows.select(F.col(source).cast("string").alias("source"), F.col(time).cast("timestamp").alias("at")).dropna()
    timed = slim.withColumn("us", F.unix_micros("at")).withWatermark("at", lateness)
    found = timed.groupBy("source").transformWithStateInPandas(StallWatch(seconds * 1_000_000), "source string, last_us bigint", "Append", "EventTime")
    return found.select(F.col("source").alias(source), F.timestamp_micros("last_us").alias("last_at"))


def start_stall_watch(rows: DataFrame, source: str, time: str, seconds: int, lateness: str, target: str, checkpoint: str) -> StreamingQuery:
    """Write the stalls of all rows that are there, then stop; timers and newest times stay with the checkpoint."""
    from tidemill.streaming.jobs import available, state_store

    with state_store(rows.sparkSession):
        return available(watch(rows, source, time, seconds, lateness), checkpoint).format("parquet").outputMode("append").start(target)
