"""Daily bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK = "1 hour"


def daily_bars(ticks: DataFrame, key: str, watermark: str = WATERMARK) -> DataFrame:
    """OHLC, sum and count per key and day; a day is emitted once the watermark has passed its end."""
    order = F.struct("ts", "event_id")
    return (
        ticks.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 day").alias("w"), key)
        .agg(
            F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("n"),
        )
        .select(key, F.to_date("w.start").alias("date"), "open", "high", "low", "close", "n")
    )


def run_daily_bars(spark: SparkSession, folder: str, name: str, out: str, checkpoint: str, key: str = "user_id") -> None:
    schema = spark.read.parquet(f"{folder}/{name}").schema
    ticks = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    query = (
        daily_bars(ticks, key).writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
