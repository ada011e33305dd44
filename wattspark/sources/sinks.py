"""Sinks (S3-S6): readings, BI extracts and the warehouse table.

Readings are written partitioned by year and month so date-range slicers
prune whole directories; extracts are small (one row per day or per
day-hour) and written as plain CSV with a header for BI tools.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.operators import rollups
from wattspark.operators.enrich import enrich
from wattspark.sources.readings import PARTITION_COLUMNS, READING_COLUMNS


def write_readings(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                   partitioned: bool = True) -> None:
    """Write the reading columns; with ``partitioned`` the layout is ``part_year=YYYY/part_month=M/``.

    Rows are range-partitioned by time first: a month is written by few tasks
    (and a hot month by several), so the number of files follows the data and
    not tasks x months. ``read_readings`` reads either layout back.
    """
    year, month = PARTITION_COLUMNS
    out = df.select(*READING_COLUMNS)
    if partitioned:
        out = out.withColumns({year: F.year("timestamp"), month: F.month("timestamp")}) \
            .repartitionByRange(year, month, "timestamp")
    w = out.write.mode(mode)
    if partitioned:
        w = w.partitionBy(year, month)
    if fmt == "csv":
        w.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    else:
        w.parquet(path)


def write_daily_extract(readings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The daily extract (date, day_name, day_of_week, total/avg/min/max kWh) as CSV."""
    rollups.daily_extract(enrich(readings)).write.mode(mode).option("header", True).csv(path)


def write_hourly_extract(readings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The hourly BI extract (date, day_name, hour, total/avg/min/max kWh) as CSV."""
    rollups.hourly_extract(enrich(readings)).write.mode(mode).option("header", True).csv(path)


def save_warehouse_table(readings: DataFrame, table: str, mode: str = "overwrite") -> None:
    """The three-column warehouse table (household_id, timestamp, energy_consumption FLOAT)."""
    rollups.warehouse_projection(readings).write.mode(mode).saveAsTable(table)
