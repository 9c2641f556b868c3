"""Profiles of arriving data with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skemaforge.operators.profile import value_counts


def windowed_counts(events: DataFrame, time: str, label: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, label, n by tumbling window; rows later than the watermark are left out, so state stays bounded."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(label).alias("label")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "label", "n")


def append_value_counts(stream: DataFrame, fields: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's value counts to ``path/batch=<id>``; a batch that is tried again overwrites its own folder, so counts stay right."""

    def write(batch: DataFrame, number: int) -> None:
        value_counts(batch, fields).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_value_counts(counts: DataFrame) -> DataFrame:
    """The sum of all batches."""
    return counts.groupBy("field", "value").agg(F.sum("count").alias("count"))
