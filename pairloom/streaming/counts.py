"""Streaming forms of the grouped counts: windowed label counts with late rows, and running group counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def label_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The label files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def labels_per_window(labels: DataFrame, lateness: str = "60 days", window: str = "30 days") -> DataFrame:
    """(window_start, label, n): labels by time of labelling; rows later than the watermark are left out, repeated label rows count once within it."""
    rows = labels.withWatermark("labeled_at", lateness).dropDuplicatesWithinWatermark(["label_row"])
    return rows.groupBy(F.window("labeled_at", window), "label").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "label", "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drives a stream over all files present to its end and returns the result table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def group_counts(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> None:
    """Adds each batch's counts by key to a table of partial counts, one folder per batch, so that a repeated batch replaces itself."""

    def add(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
