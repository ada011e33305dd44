"""Slices answered from a stored rollup (F1-F3 with A10, A14, A15): no slice reads the readings again.

The dashboard slices by day, day name and hour, so one table of additive
measures per date, hour and household answers every slice: counts, sums, least
and largest values add up over whichever of its rows the slice keeps. It is
written by month (``part_year`` / ``part_month``, so a date range leaves out
whole folders) with the households of an hour as separate rows (a slice may
also name households).

A new day replaces its own rows only: ``replace_days``. A rollup is at most
24 x days x households rows; for readings that come hourly that is no smaller
than they are, only narrower and free of the fields that no view needs, while
readings of meters that report every minute shrink by sixty.

Readings without a timestamp are in no slice; a null household or kWh stays.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspark import constants as C
from wattspark.operators.rollups import kwh, outage, stage
from wattspark.sources.readings import PARTITION_COLUMNS

MEASURES = ("readings", "n", "total_kwh", "min_kwh", "max_kwh", "outage_readings", "max_stage", "cost")


def rollup(e: DataFrame) -> DataFrame:
    """(date, hour, household_id, measures) of enriched readings."""
    return e.where(F.col("timestamp").isNotNull()).groupBy("date", "hour", "household_id").agg(
        F.count(F.lit(1)).alias("readings"), F.count(kwh()).alias("n"), F.sum(kwh()).alias("total_kwh"), F.min(kwh()).alias("min_kwh"),
        F.max(kwh()).alias("max_kwh"), F.count_if(outage()).alias("outage_readings"), F.max(stage()).alias("max_stage"),
        F.sum("estimated_cost").alias("cost"))


def write(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a rollup by month; a month is written by few tasks."""
    year, month = PARTITION_COLUMNS
    table.withColumns({year: F.year("date"), month: F.month("date")}).repartitionByRange(year, month, "date", "hour").write.mode(
        mode).partitionBy(year, month).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_days(spark: SparkSession, path: str, new: DataFrame, to: str) -> DataFrame:
    """The stored rollup with the days of ``new`` in place of its own, written to ``to`` and read back."""
    old = read(spark, path).drop(*PARTITION_COLUMNS)
    days = new.select(F.col("date").alias("_d")).distinct()
    write(old.join(F.broadcast(days), F.col("date") == F.col("_d"), "left_anti").unionByName(new), to)
    return read(spark, to)


def sliced(table: DataFrame, start_date: dt.date | str | None = None, end_date: dt.date | str | None = None, day_names=C.DAY_NAMES,
           hour_range: tuple[int, int] = (0, 23), households: list[str] | None = None) -> DataFrame:
    """The rows of a slice (bounds inclusive, as ``filters.slicer_predicate``); date bounds also prune the folders."""
    cond, month = F.lit(True), None
    if set(PARTITION_COLUMNS) <= set(table.columns):
        month = F.col(PARTITION_COLUMNS[0]) * 12 + F.col(PARTITION_COLUMNS[1])
    for day, lower in ((start_date, True), (end_date, False)):
        if day is None:
            continue
        d = dt.date.fromisoformat(str(day))
        cond = cond & ((F.col("date") >= F.lit(d)) if lower else (F.col("date") <= F.lit(d)))
        if month is not None:
            cond = cond & ((month >= d.year * 12 + d.month) if lower else (month <= d.year * 12 + d.month))
    if tuple(day_names) != tuple(C.DAY_NAMES):
        cond = cond & F.date_format("date", "EEEE").isin(*day_names)
    if tuple(hour_range) != (0, 23):
        cond = cond & F.col("hour").between(*hour_range)
    if households is not None:
        cond = cond & F.col("household_id").isin(*households)
    return table.where(cond)


def with_fallback(table: DataFrame, **kwargs) -> DataFrame:
    """The slice, or everything when it is empty (F2)."""
    out = sliced(table, **kwargs)
    return table if out.limit(1).isEmpty() else out


def _total() -> Column:
    return F.sum("total_kwh")


def _mean() -> Column:
    return F.try_divide(_total(), F.sum("n").cast("double"))


def daily_summary(table: DataFrame) -> DataFrame:
    """As ``rollups.daily_summary`` (A10)."""
    return table.groupBy("date").agg(_total().alias("total_kwh"), _mean().alias("avg_kwh"), F.max("max_kwh").alias("max_kwh"),
                                     F.min("min_kwh").alias("min_kwh")).withColumn("day_name", F.date_format("date", "EEEE"))


def avg_by_hour(table: DataFrame) -> DataFrame:
    """As ``rollups.avg_by_hour``."""
    return table.groupBy("hour").agg(_mean().alias("avg_kwh")).orderBy("hour")


def day_hour_distribution(table: DataFrame) -> DataFrame:
    """As ``rollups.day_hour_distribution``."""
    return table.groupBy(F.date_format("date", "EEEE").alias("day_name"), "hour").agg(_mean().alias("avg_kwh"), _total().alias("total_kwh"))


def day_totals(table: DataFrame) -> DataFrame:
    """As ``rollups.day_totals``."""
    return table.groupBy(F.date_format("date", "EEEE").alias("day_name")).agg(_total().alias("total_kwh"))


def daily_cost_outage(table: DataFrame) -> DataFrame:
    """As ``rollups.daily_cost_outage``."""
    return table.groupBy("date").agg(F.sum("cost").alias("cost"), F.sum("outage_readings").alias("outage_hours"), _total().alias("consumption"))


def kpi_cards(table: DataFrame) -> DataFrame:
    """As ``rollups.kpi_cards`` (A3)."""
    return table.agg(_total().alias("total_kwh"), F.max("max_kwh").alias("peak_kwh"), _mean().alias("mean_kwh"),
                     F.coalesce(F.sum("outage_readings"), F.lit(0)).alias("outage_hours"),
                     (F.try_divide(F.sum("outage_readings").cast("double"), F.sum("readings").cast("double")) * 100.0).alias("outage_pct"),
                     F.sum("cost").alias("total_cost"))
