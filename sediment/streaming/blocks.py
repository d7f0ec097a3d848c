"""Blocks that grow with every strike and are forgotten in time, as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Inside, streams start with the state store that timers and lists need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Strikes(StatefulProcessor):
    """Keeps the strikes of a key for as long as they count, as a list of times in microseconds; a timer at the end of the last
    one's memory empties the list."""

    def __init__(self, memory: int, first: float, most: float):
        self.memory, self.first, self.most = memory, first, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("strikes", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "event_id"])
        times = [r[0] for r in self.held.get()] if self.held.exists() else []
        now = timerValues.getCurrentWatermarkInMs() * 1000
        out = []
        for at in new["at"]:
            times.append(int(at))
        times.sort()
        for at, event in zip(new["at"].tolist(), new["event_id"].tolist()):
            strikes = sum(at - self.memory <= t <= at for t in times)
            out.append((key[0], event, strikes, int(at + min(self.most, self.first * 2.0 ** (strikes - 1)) * 1_000_000)))
        live = [t for t in times if t + self.memory >= max(now, 0)]
        if live:
            self.held.put([(t,) for t in live])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((live[-1] + self.memory) // 1000 + 1)
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=["key", "event_id", "strikes", "until"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "event_id": pd.Series([], dtype="int64"), "strikes": pd.Series([], dtype="int64"), "until": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def streamed_blocks(events: DataFrame, by: str, ts: str, strike: F.Column, memory: int = 86_400, first: float = 3600, most: float = 86_400) -> DataFrame:
    """(by, event_id, strikes, blocked_until) for every strike of a stream (``by`` and event_id whole numbers, a watermark on
    ``ts``): what ``windows.escalated`` gives for a table, as long as strikes come within the watermark and no
    strike comes in a later batch than one of its key with a later time. A key's state is the times of its strikes
    within ``memory`` seconds; it is empty when the watermark has passed the last one by that much. Rows without a
    key or time are left out. To be started inside ``stateful``."""
    rows = events.where(strike).where(F.col(by).isNotNull() & F.col(ts).isNotNull()).select(F.col(by).cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros(ts).alias("at"), ts)
    made = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Strikes(memory * 1_000_000, first, most), outputStructType="key long, event_id long, strikes long, until long", outputMode="Append", timeMode="EventTime")
    return made.select(F.col("key").alias(by), "event_id", "strikes", F.timestamp_micros("until").alias("blocked_until"))
