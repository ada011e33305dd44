"""The ``readings`` fact table: schema and scans (CSV or Parquet)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READINGS_SCHEMA = T.StructType([
    T.StructField("household_id", T.StringType(), True),
    T.StructField("timestamp", T.TimestampNTZType(), True),
    T.StructField("energy_consumption", T.DoubleType(), True),
    T.StructField("load_shedding_stage", T.IntegerType(), True),
    T.StructField("backup_power", T.BooleanType(), True),
])
READING_COLUMNS = tuple(READINGS_SCHEMA.fieldNames())


#: Partition columns of the written layout; reserved names, dropped by the reader.
PARTITION_COLUMNS = ("part_year", "part_month")


def read_readings(spark: SparkSession, path: str, fmt: str | None = None, start_date: dt.date | str | None = None,
                  end_date: dt.date | str | None = None) -> DataFrame:
    """Scan readings with an explicit schema (no inference pass over the data).

    ``fmt`` is ``csv`` or ``parquet``; by default it is taken from the path
    suffix. A missing path raises ``AnalysisException`` (PATH_NOT_FOUND) when
    the plan is analysed, before any job runs. ``start_date`` and ``end_date``
    (inclusive) are pushed into the scan, and where the layout of
    ``write_readings`` is found they also leave out whole directories.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    reader = spark.read.schema(READINGS_SCHEMA)
    if fmt == "csv":
        df = reader.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd[ HH:mm:ss]").csv(path)
    else:
        df = reader.parquet(path)
    for day, earliest in ((start_date, True), (end_date, False)):
        if day is None:
            continue
        t, bound = F.col("timestamp"), F.to_timestamp_ntz(F.lit(str(day)))
        df = df.where(t >= bound if earliest else t < bound + F.expr("INTERVAL 1 DAY"))
        if set(PARTITION_COLUMNS) <= set(df.columns):
            month = F.col(PARTITION_COLUMNS[0]) * 12 + F.col(PARTITION_COLUMNS[1])
            day_month = int(str(day)[:4]) * 12 + int(str(day)[5:7])
            df = df.where(month >= day_month if earliest else month <= day_month)
    return with_reading_id(df.select(*READING_COLUMNS))


def with_reading_id(df: DataFrame) -> DataFrame:
    """Add a ``reading_id`` unless one exists: a hash of the reading itself.

    It depends on nothing but the row, so it is the same for every file
    layout, split size and cluster, and filters pass it on the way to the
    scan. Readings that are equal in every column share it; they are
    interchangeable, so ties between them change no result.
    """
    if "reading_id" in df.columns:
        return df
    return df.withColumn("reading_id", F.xxhash64(*READING_COLUMNS).bitwiseAND(F.lit((1 << 63) - 1)))


def readings_from(df: DataFrame) -> DataFrame:
    """Project any frame that already carries the reading columns onto the canonical schema."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in READINGS_SCHEMA.fields]
    if "reading_id" in df.columns:
        cols = [F.col("reading_id").cast("long").alias("reading_id")] + cols
    return with_reading_id(df.select(*cols))
