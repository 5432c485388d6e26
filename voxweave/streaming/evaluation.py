"""Evaluation of a stream of predictions, an epoch a micro-batch, into sinks that may see a batch twice.

History is a folder of one small table a batch: `batch_id`, `score`, `evaluated`, `saved`. A batch that is run again writes the same
folders anew, and compares itself with earlier batches only, so nothing is counted twice and no later score is looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

HISTORY = "batch_id long, score double, evaluated boolean, saved boolean"


def history(spark: SparkSession, path: str) -> DataFrame:
    """All batches so far; none if nothing was written yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(HISTORY).option("recursiveFileLookup", "true").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def evaluated(batch: DataFrame, batch_id: int, score: Callable[[DataFrame], DataFrame], history_path: str, weights_path: str | None = None, weights: Callable[[DataFrame], DataFrame] | None = None, interval: int = 1) -> None:
    """One batch: its score (one row, one column) every `interval` batches, 0 otherwise; weights are written where it is above all before.

    Weights go to a folder of their batch, before the history names it: a run that is cut short leaves none that are named.
    """
    spark = batch.sparkSession
    due = (batch_id + 1) % interval == 0
    value = float(score(batch).first()[0] or 0.0) if due else 0.0
    before = history(spark, history_path).where(F.col("evaluated") & (F.col("batch_id") < batch_id)).agg(F.max("score")).first()[0]
    better = due and (before is None or value > before)
    if better and weights is not None and weights_path is not None:
        weights(batch).write.mode("overwrite").parquet(f"{weights_path}/batch-{batch_id}")
    row = spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(value).alias("score"), F.lit(due).alias("evaluated"), F.lit(better).alias("saved"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{history_path}/batch-{batch_id}")


def evaluate(stream: DataFrame, checkpoint: str, score: Callable[[DataFrame], DataFrame], history_path: str, weights_path: str | None = None, weights: Callable[[DataFrame], DataFrame] | None = None, interval: int = 1) -> StreamingQuery:
    """Evaluate each micro-batch of what has arrived, then end; started again with the same checkpoint it goes on."""
    work = lambda batch, batch_id: evaluated(batch, batch_id, score, history_path, weights_path, weights, interval)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def best_weights(spark: SparkSession, history_path: str, weights_path: str) -> DataFrame | None:
    """The weights of the best batch so far, or None."""
    row = history(spark, history_path).where("saved").agg(F.max("batch_id")).first()
    return None if row[0] is None else spark.read.parquet(f"{weights_path}/batch-{row[0]}")
