"""An extension: events counted by sprint as they arrive, late ones within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 8).parquet(folder)


def sprint_counts(events: DataFrame, days: int = 14, late: str = "2 days") -> DataFrame:
    """(start, event_type, events, total): tumbling windows of a sprint's length."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days"), "event_type")
    return windows.agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "events", "total")
