"""Daily roll-up of the event log, the same in batch and in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_totals(events: DataFrame) -> DataFrame:
    """day, event_type, n, total; exact sums of decimals."""
    total = F.sum(F.col("value").cast("decimal(24,6)")).cast("double")
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), total.alias("total"))


def stream_daily_totals(spark: SparkSession, folder: str, schema, late: str = "2 days"):
    """A stream over a folder of event files: a day's window per event type, closed once the watermark has passed it."""
    events = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    total = F.sum(F.col("value").cast("decimal(24,6)")).cast("double")
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), total.alias("total"))
    return windows.select(F.to_date("window.start").alias("day"), "event_type", "n", "total")
