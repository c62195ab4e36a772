"""Structured Streaming over event logs and incoming documents (event time is an extra beside the batch operators).

Defined results: events later than the watermark are dropped in append mode, never in complete mode (``drained_counts``);
a batch that is delivered again is written once, as its folder is named by the batch id or written over; null timestamps
are never in a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawlake.operators import search

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, schema: str = EVENT, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "2 hours", size: str = "1 day") -> DataFrame:
    """Events and their value per type and window; works on a stream and on a table alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if timed.isStreaming else timed
    g = marked.where("ts IS NOT NULL").groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("from_ts"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user by gaps between events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", gap) if timed.isStreaming else timed
    g = marked.where("ts IS NOT NULL").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), F.col("w.end").cast("timestamp_ntz").alias("ended"), "n")


def drain(spark: SparkSession, rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there once; progress survives in the checkpoint."""
    query = rows.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drained_counts(spark: SparkSession, folder: str, out: str, checkpoint: str, per_trigger: int = 100) -> DataFrame:
    """The windowed counts of all files of a folder, drained in any number of micro-batches and any order of events.

    In complete mode each micro-batch hands on the counts of all windows so far, open ones too, and no event is too late;
    the last batch's are the result. State and result are one row per window and type.
    """
    rows = windowed_counts(stream(spark, folder, per_trigger=per_trigger))
    drain(spark, rows, lambda batch, _: batch.write.mode("overwrite").parquet(out), checkpoint, "complete")
    return spark.read.schema(rows.schema).parquet(out)


def tokenising_sink(folder: str, id_col: str, text_col: str) -> Callable[[DataFrame, int], None]:
    """A sink that tokenises each micro-batch into the folder of its batch id (delivered again: overwritten)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(id_col, search.tokens(F.col(text_col)).alias("tokens")).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write
