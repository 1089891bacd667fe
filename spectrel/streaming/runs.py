"""Streams of acquired data: islands of activity and sliding means, found as they arrive.

Tables are read as files appear in a folder; late rows within the watermark still count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder, as they are added."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def activity_islands(events: DataFrame, time: str, by: list[str], gap: str = "10 minutes", late: str = "10 minutes", value: str = "value") -> DataFrame:
    """Groups of events of one key with no pause longer than ``gap``: their span, number and mean value."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = marked.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"))
    return grouped.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_value")


def sliding_mean(events: DataFrame, time: str, by: list[str], width: str = "10 minutes", step: str = "5 minutes", late: str = "10 minutes", value: str = "value") -> DataFrame:
    """Mean values in overlapping windows of time."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = marked.groupBy(F.window(time, width, step).alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"))
    return grouped.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_value")


def run_to_end(result: DataFrame, path: str, checkpoint: str) -> None:
    """Work off what is there and stop; the checkpoint makes a second call go on where this one ended."""
    query = result.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
