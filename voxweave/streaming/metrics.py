"""Metrics over streams: states of micro-batches add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_dice(rows: DataFrame, name: str) -> StreamingQuery:
    """Running Dice sums by class of (class, y_true, y_pred) rows, in a memory table.

    A voxel adds to its class alone, so no state is kept by sample, and the order and number of batches don't matter. Unlike
    `dice_state`, which leaves out what `ignore_empty` names, all rows count, those of samples and classes without truth too.
    """
    state = rows.groupBy("class").agg(
        F.sum(F.col("y_true") * F.col("y_pred")).alias("intersection"),
        F.sum(F.col("y_true") + F.col("y_pred")).alias("total"),
        F.count(F.lit(1)).alias("valid"),
    )
    return state.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


def windowed_means(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean and count of `value` by event type and time window; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), "event_type", "mean", "n"
    )


def closed_windows(events: DataFrame, path: str, checkpoint: str, width: str = "1 hour", late: str = "2 hours") -> StreamingQuery:
    """windowed_means as a table: a window is written once, when the watermark has passed its end."""
    return windowed_means(events, width, late).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, path: str, checkpoint: str, gap: str = "30 minutes", late: str = "2 hours") -> StreamingQuery:
    """(user_id, start, end, n) of runs of events without a gap, as a table of closed ones."""
    runs = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("run"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    closed = runs.select("user_id", F.col("run.start").alias("start"), F.col("run.end").alias("end"), "n")
    return closed.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
