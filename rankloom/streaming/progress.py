"""Running progress of keyed work, with timers: what readers poll while it goes on.

Each key has a state of its own (how many items came, how many are done, the latest
time), and every batch emits the keys that it touched.  A timer at the latest time
plus ``gap`` is put off by every new item; when the watermark passes it, the key is
emitted once more as closed.  Written by ``ledger.ResultTable``, the latest row of a
key is its progress, and any version can be polled while the stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = "key string, n long, done long, last_ms long, closed boolean, step long"


class _Progress(StatefulProcessor):
    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", "n long, done long, last_ms long, step long")

    def _row(self, key: tuple, state: tuple, closed: bool) -> pd.DataFrame:
        n, done, last, step = state
        return pd.DataFrame({"key": [key[0]], "n": [n], "done": [done], "last_ms": [last], "closed": [closed], "step": [step]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, done, last, step = self.state.get() if self.state.exists() else (0, 0, 0, 0)
        for x in rows:
            n, done, last = n + len(x), done + int(x["done"].sum()), max(last, int(x["ms"].max()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last + self.gap_ms > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(last + self.gap_ms)
        self.state.update((n, done, last, step + 1))
        yield self._row(key, (n, done, last, step + 1), False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, done, last, step = self.state.get()
        self.state.update((n, done, last, step + 1))
        yield self._row(key, (n, done, last, step + 1), True)

    def close(self) -> None:
        pass


def needs_state_store(spark: SparkSession) -> None:
    """Processors with timers keep their state in RocksDB; the session must say so before its first stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def progress(items: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """key, n, done, last_ms, closed, step for a stream (key, ts, done boolean); ``step`` numbers a key's rows.

    A key whose items come after it was closed opens again.
    """
    needs_state_store(items.sparkSession)
    spaced = items.sparkSession.sql(f"SELECT CAST(unix_millis(timestamp_seconds(0) + INTERVAL {gap}) AS BIGINT)").first()[0]
    of = items.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("done", F.lit(False)).cast("int").alias("done"))
    of = of.withColumn("ms", F.unix_millis("ts")).where("ts IS NOT NULL").withWatermark("ts", late)
    return of.groupBy("key").transformWithStateInPandas(_Progress(spaced), COLUMNS, "Update", "EventTime")
