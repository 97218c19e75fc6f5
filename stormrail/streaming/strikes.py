"""STR1: hourly strike counts per station over a stream of landed files.

``readStream`` (one file per trigger, oldest first) -> the strike's hour
(tumbling one-hour windows) as the event-time column with a watermark ->
count per station and hour -> ``update`` output.
Each micro-batch appends its updated window counts with the batch id to a
result folder (``foreachBatch``); the current count of a window is the one
from the latest batch. State older than the watermark is dropped, so the
state store stays bounded on an endless stream. With files landing in time
order the result equals the batch roll-up (AGG1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def hourly_counts_stream(stream: DataFrame, station: str = "station", time: str = "time",
                         watermark: str = "1 hour") -> DataFrame:
    """The hour is cut on the wall clock of the TIMESTAMP_NTZ strike time
    (zone-free); the watermark column is that hour as a TIMESTAMP."""
    from stormrail.functions.scalar import hour_floor
    h = hour_floor(time).cast("timestamp")
    return stream.withColumn("_hour", h).withWatermark("_hour", watermark) \
                 .groupBy(F.col(station), F.col("_hour")) \
                 .agg(F.count(F.lit(1)).alias("count"))


def run_hourly_counts(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str,
                      station: str = "station", time: str = "time", watermark: str = "1 hour") -> DataFrame:
    """Process everything available in ``source`` and return the current
    counts (station, time = window start as TIMESTAMP_NTZ, count)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    agg = hourly_counts_stream(stream, station, time, watermark)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.select(station, F.col("_hour").cast("timestamp_ntz").alias(time), "count",
                     F.lit(batch_id).alias("batch_id")).write.mode("append").parquet(out)

    q = agg.writeStream.outputMode("update").foreachBatch(sink) \
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    res = spark.read.parquet(out)
    return res.groupBy(station, time).agg(F.max_by("count", "batch_id").cast("long").alias("count"))
