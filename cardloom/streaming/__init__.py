"""Streams: debounced turn ends, incremental consolidation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import logs


def debounced(events: DataFrame, gap: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """One row per burst of turn ends of a session, once ``gap`` has passed without another."""
    return events.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap)).agg(F.count("*").alias("n_events")).select("session", F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("fires_at"), "n_events")


def once_per_key(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def inbox_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(logs.INBOX).option("maxFilesPerTrigger", files_a_batch).json(folder)


def consolidate(inbox: DataFrame, checkpoint: str, run: Callable[[DataFrame], DataFrame], sink: str):
    """Consumes what is new and stops. The sink's folder is named by batch, so a replayed batch overwrites itself."""

    def batch(df: DataFrame, number: int) -> None:
        run(df).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return inbox.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
