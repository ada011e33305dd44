"""Daily and hourly consumption rollups over a stream of readings.

The same aggregates as the batch daily summary / hourly extract, on event
time: a watermark bounds the state (a day is final once readings ``lateness``
past its end have arrived), so the state holds only the open days, and
``append`` mode emits each day once, when it is closed.

Watermarks need a zoned ``TIMESTAMP`` event time, so the wall-clock
``timestamp_ntz`` is cast to one; windows are aligned to UTC days, so the
session time zone must be UTC (``wattspark.session.get_session`` sets it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattspark.sources.readings import READINGS_SCHEMA

def kwh():
    return F.col("energy_consumption")




def read_readings_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                         max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(READINGS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.parquet(path)


def _event_time(readings: DataFrame) -> DataFrame:
    return readings.withColumn("event_time", F.col("timestamp").cast("timestamp"))


def daily_summary_stream(readings: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Per calendar day: total / avg / max / min kWh and day name, emitted when the day closes."""
    agg = (_event_time(readings).withWatermark("event_time", lateness)
           .groupBy(F.window("event_time", "1 day"))
           .agg(F.sum(kwh()).alias("total_kwh"), F.avg(kwh()).alias("avg_kwh"),
                F.max(kwh()).alias("max_kwh"), F.min(kwh()).alias("min_kwh")))
    day = F.to_date(F.col("window.start"))
    return agg.select(day.alias("date"), "total_kwh", "avg_kwh", "max_kwh", "min_kwh",
                      F.date_format(day, "EEEE").alias("day_name"))


def hourly_extract_stream(readings: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Per clock hour: total / avg / min / max kWh (the BI hourly extract), emitted when the hour closes."""
    agg = (_event_time(readings).withWatermark("event_time", lateness)
           .groupBy(F.window("event_time", "1 hour"))
           .agg(F.sum(kwh()).alias("total_kwh"), F.avg(kwh()).alias("avg_kwh"),
                F.min(kwh()).alias("min_kwh"), F.max(kwh()).alias("max_kwh")))
    start = F.col("window.start")
    return agg.select(F.to_date(start).alias("date"), F.date_format(start, "EEEE").alias("day_name"),
                      F.hour(start).alias("hour"), "total_kwh", "avg_kwh", "min_kwh", "max_kwh")


def start_to_parquet(stream: DataFrame, path: str, checkpoint: str, trigger_seconds: int | None = None
                     ) -> StreamingQuery:
    """Append closed rows to Parquet; the checkpoint (on shared storage) makes restarts exactly-once."""
    w = stream.writeStream.outputMode("append").format("parquet").option("path", path) \
        .option("checkpointLocation", checkpoint)
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
