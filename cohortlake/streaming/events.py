"""The event table as a stream: windowed counts with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events from a folder of Parquet files; ``ts`` becomes TIMESTAMP, which watermarks need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """(begin, event_type, n, total) per window; the same plan over a table or a stream.

    Rows without ``ts`` are dropped; on a stream, rows later than ``late`` behind the newest are too.
    """
    e = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late and events.isStreaming else e
    g = e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("begin"), "event_type", "n", "total")


def event_windows(spark, sf_dir: str) -> DataFrame:
    from cohortlake.session import table

    w = windowed(table(spark, sf_dir, "events"))
    return w.select(F.date_format("begin", "yyyy-MM-dd HH:mm").alias("begin"), "event_type", "n", F.round("total", 4).alias("total"))
