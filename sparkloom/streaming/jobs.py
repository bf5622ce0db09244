"""Event-driven state with Structured Streaming.

The default watermark is one hour: later rows are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "1 hour"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of events (event_id, ts, user_id, event_type, value, props)."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str = "7 days", slide: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """Counts by kind over sliding windows, given out once a window is over."""
    return (
        events.withWatermark("ts", watermark).groupBy(F.window("ts", width, slide), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("window.start", "window.end", "event_type", "n", "value")
    )


def searches_per_minute(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Approximate distinct (query, minute) searches of each minute."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", "1 minute")).agg(F.approx_count_distinct("event_type").alias("searches")).select("window.start", "searches")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    return (
        events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count(F.lit(1)).alias("n")).select("session_window.start", "session_window.end", "user_id", "n")
    )


def cooled_down(events: DataFrame, key: str = "user_id", delay: str = "24 hours") -> DataFrame:
    """At most one row of each key within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def attributed(searches: DataFrame, gets: DataFrame, minutes: int = 30, watermark: str = WATERMARK) -> DataFrame:
    """Reads of a record that follow a search that showed it within some minutes (interval join of two streams).

    Both have user_id and ts.
    """
    s = searches.withWatermark("ts", watermark).select(F.col("user_id").alias("s_user"), F.col("ts").alias("searched_at"), F.col("event_id").alias("search_id"))
    g = gets.withWatermark("ts", watermark).select("user_id", "ts", F.col("event_id").alias("get_id"))
    inside = (F.col("s_user") == F.col("user_id")) & (F.col("ts") >= F.col("searched_at")) & (F.col("ts") <= F.col("searched_at") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return s.join(g, inside).select("user_id", "search_id", "get_id", "searched_at", "ts")


def last_seen(events: DataFrame, ttl_ms: int = 24 * 3600 * 1000, watermark: str = WATERMARK) -> DataFrame:
    """Running count and last time of each user, with state that is dropped when it is not used for a while."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, 0)
        for batch in batches:
            n += len(batch)
            last = max(last, int(batch["ts"].astype("datetime64[ms]").astype("int64").max()))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_ms": [last]})

    return events.withWatermark("ts", watermark).groupBy("user_id").applyInPandasWithState(
        step, "user_id long, n long, last_ms long", "n long, last_ms long", "update", GroupStateTimeout.EventTimeTimeout
    )


def every_n_rows(events: DataFrame, n: int, job: Callable[[DataFrame, int], None], folder: str):
    """Run a job over each micro-batch that brings the rows seen to another multiple of n.

    The rows of each batch are counted into a table under ``folder``, beside
    the stream's checkpoint, so that a restart goes on counting and a batch
    that is repeated counts once.
    """
    schema = "rows long, epoch long"

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.agg(F.count(F.lit(1)).alias("rows")).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/rows/batch={epoch}")
        seen = spark.read.schema(schema).parquet(f"{folder}/rows/batch=*")
        sums = seen.agg(F.sum(F.when(F.col("epoch") < epoch, F.col("rows")).otherwise(0)).alias("before"), F.sum(F.when(F.col("epoch") == epoch, F.col("rows"))).alias("now")).first()
        if (sums["before"] + sums["now"]) // n > sums["before"] // n:
            job(batch, epoch)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into the driver's memory: for streams that update a bounded number of rows."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append stream over what is there now into Parquet files; its checkpoint is the high-water mark of the next run."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
