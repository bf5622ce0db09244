"""Usefulness from use: state with timers for each record.

A search credits its first results, each record at most once within a day; a
read credits a record that a search of the same session showed at most half an
hour before, once for each showing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkloom.shipping import ship

MINUTE_MS = 60_000
SHOWN_MS, COOLDOWN_MS = 30 * MINUTE_MS, 24 * 60 * MINUTE_MS
TOP = 3
#: Rows older than this behind the newest one are dropped.
WATERMARK = "1 hour"
CREDITS = "memory_id long, event_id long, ts timestamp, reason string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """State of this kind needs the RocksDB store, which is chosen when a query starts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Credits(StatefulProcessor):
    """One record's state: when its last ranking was credited, and when each session last saw it in a search."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marked = handle.getValueState("marked", "ms long")
        self.shown = handle.getMapState("shown", "session string", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = pd.concat(list(rows))
        every["ms"] = every["ts"].astype("datetime64[ms]").astype("int64")
        every = every.sort_values(["ms", "event_id"])
        out = []
        last = self.marked.get()[0] if self.marked.exists() else None
        for row in every.itertuples():
            ms = int(row.ms)
            if row.shown:
                self.shown.updateValue((row.session,), (ms,))
                if row.top and (last is None or ms - last >= COOLDOWN_MS):
                    last = ms
                    out.append((key[0], row.event_id, row.ts, "ranked"))
            elif self.shown.containsKey((row.session,)) and ms - self.shown.getValue((row.session,))[0] <= SHOWN_MS:
                self.shown.removeKey((row.session,))
                out.append((key[0], row.event_id, row.ts, "read"))
        if last is not None:
            self.marked.update((last,))
        # Nothing of a record's state counts any more a day after its newest row.
        self.handle.registerTimer(int(every["ms"].max()) + COOLDOWN_MS)
        yield pd.DataFrame(out, columns=["memory_id", "event_id", "ts", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        for session, seen in list(self.shown.iterator()):
            if now - seen[0] > SHOWN_MS:
                self.shown.removeKey(session)
        if self.marked.exists() and now - self.marked.get()[0] >= COOLDOWN_MS:
            self.marked.clear()
        yield pd.DataFrame([], columns=["memory_id", "event_id", "ts", "reason"])

    def close(self) -> None:
        pass


def showings(searches: DataFrame, reads: DataFrame, top: int = TOP) -> DataFrame:
    """One stream of what ``credits`` takes: ``searches`` (event_id, ts, session, results), best first, and ``reads`` (event_id, ts, session, memory_id)."""
    each = searches.select("event_id", "ts", "session", F.posexplode(F.array_distinct("results")).alias("at", "memory_id"))
    shown = each.select("memory_id", "event_id", "ts", "session", F.lit(True).alias("shown"), (F.col("at") < top).alias("top"))
    return shown.unionByName(reads.select("memory_id", "event_id", "ts", "session", F.lit(False).alias("shown"), F.lit(False).alias("top")))


def credits(rows: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """(memory_id, event_id, ts, reason) of each time a record proved useful: 'ranked' or 'read'.

    Rows of one record are taken in order of time and event; to be started
    within ``rocksdb``.
    """
    ship(rows.sparkSession)
    return rows.withWatermark("ts", watermark).groupBy("memory_id").transformWithStateInPandas(
        statefulProcessor=Credits(), outputStructType=CREDITS, outputMode="Append", timeMode="EventTime"
    )


def with_credits(memories: DataFrame, found: DataFrame) -> DataFrame:
    """The records with ``useful_count`` raised by their credits."""
    n = found.groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("more"))
    return memories.join(n, "id", "left").withColumn("useful_count", F.col("useful_count") + F.coalesce("more", F.lit(0))).drop("more")
