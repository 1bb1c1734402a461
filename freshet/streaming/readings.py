"""Sub-daily readings as a stream: hourly means with a watermark, merged into a table of hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(readings: DataFrame, late: str = "2 hours", low: float = -1.0, high: float = 35.0) -> DataFrame:
    """station, hour, value, n, final of a stream of (station, ts, value, final). Readings later than the watermark are dropped; an
    hour is final only if every reading is. State is one row per station and open hour."""
    kept = readings.where(F.col("value").between(low, high)).withWatermark("ts", late)
    out = kept.groupBy("station", F.window("ts", "1 hour").alias("w")).agg(F.avg("value").alias("value"), F.count("*").alias("n"), F.min(F.coalesce("final", F.lit(False)).cast("int")).alias("final"))
    return out.select("station", F.col("w.start").alias("hour"), "value", "n", (F.col("final") == 1).alias("final"))


def start(hours: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed hours to Parquet by day, exactly once."""
    return hours.withColumn("day", F.to_date("hour")).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()
