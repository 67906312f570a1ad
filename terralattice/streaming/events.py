"""Our own extension: hourly counts of the event feed, as a batch or as a stream with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """hour, event_type, n, total; on a stream ``late`` is how long a window waits."""
    df = events.withWatermark("ts", late) if late else events
    return (
        df.groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("hour"), "event_type", "n", "total")
    )


def stream_hourly(spark: SparkSession, folder: str, late: str = "2 hours") -> DataFrame:
    """The same over a folder of Parquet files, each event once by id."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    feed = spark.readStream.schema(schema).parquet(folder)
    once = feed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return hourly(once)
