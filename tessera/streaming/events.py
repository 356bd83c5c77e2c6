"""Windowed counts over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """A file stream of event tables; times as timestamps, so that watermarks apply."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their sum of values per window and type; what comes later than ``late`` is left out.

    The same on a stream and on a table.
    """
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = seen.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: start, end and events."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = seen.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_to_table(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is there now into Parquet files, resumable from its checkpoint."""
    return result.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_updates(result: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run a stream of updated aggregates over what is there now; the last state of each of ``keys``.

    Each batch appends what changed in it to Parquet files under its number, so nothing comes
    to the driver, and a batch that is repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    stored = result.sparkSession.read.option("basePath", path).parquet(f"{path}/batch=*")
    values = [c for c in result.columns if c not in keys]
    last = stored.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, *(F.col("last")[c].alias(c) for c in values))
