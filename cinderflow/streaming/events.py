"""Streams of events: late rows and repeats dropped, tumbling counts. The same operator runs over a batch."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the event files below a folder."""
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(path)


def counted(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """start, event_type, n, total of each window; a repeated event_id counts once."""
    once = events.withWatermark("ts", late)
    once = once.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else once.dropDuplicates(["event_id"])
    by = once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")
