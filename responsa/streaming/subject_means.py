"""Pass rates of a stream of responses: tumbling windows by benchmark, late events bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def clipped(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)))


def windowed(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """event_type, start, total, n; the same on a stream and on a table."""
    rows = clipped(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    g = rows.groupBy("event_type", F.window("ts", size).alias("w")).agg(F.sum("label").alias("total"), F.count("*").alias("n"))
    return g.select("event_type", F.col("w.start").alias("start"), "total", "n")


def stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def run_available(df: DataFrame, sink: str, checkpoint: str) -> None:
    """All input that is there, then an end; windows that the watermark has not passed are written too, as updates."""
    q = df.writeStream.outputMode("complete").format("memory").queryName(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
