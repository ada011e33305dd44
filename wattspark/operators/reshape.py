"""Pivots and fixed-order reindexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspark.operators.rollups import grouped

from wattspark import constants as C

def kwh():
    return F.col("energy_consumption")




def day_dimension(spark: SparkSession) -> DataFrame:
    """Seven day names with their order (fixed size: safe to broadcast)."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(C.DAY_NAMES, start=1)],
                                 "day_name string, day_order int")


def heatmap_day_hour(e: DataFrame) -> DataFrame:
    """Mean kWh, one row per day name Monday..Sunday, one column per hour h00..h23.

    The pivot values are given, so Spark needs no extra job to discover them;
    the aggregate runs partial-then-final. Day names absent from the data still
    get a row (all null), through a right join from the broadcast day dimension.
    """
    pivoted = grouped(e, "day_name").pivot("hour", list(range(24))).agg(F.avg(kwh()))
    pivoted = pivoted.select("day_name", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])
    days = F.broadcast(day_dimension(e.sparkSession))
    return pivoted.join(days, "day_name", "right").orderBy("day_order")


def weekday_weekend_profile(e: DataFrame) -> DataFrame:
    """Mean kWh per hour for weekdays and weekends side by side."""
    return (grouped(e, "hour").pivot("is_weekend", [0, 1]).agg(F.avg(kwh()))
            .select("hour", F.col("0").alias("weekday_kwh"), F.col("1").alias("weekend_kwh"))
            .orderBy("hour"))


_PERIOD_COLUMNS = (("Off-Peak", "off_peak_cost"), ("Daytime", "daytime_cost"),
                   ("Morning Peak", "morning_peak_cost"), ("Evening Peak", "evening_peak_cost"))


def monthly_cost_by_period(e: DataFrame) -> DataFrame:
    """Estimated cost per month name and time-of-use period, calendar order.

    Grouped by month name, so the same month of different years is merged;
    only months present in the data appear.
    """
    pivoted = (grouped(e, "month_name", "month")
               .pivot("time_period", [p for p, _ in _PERIOD_COLUMNS]).agg(F.sum("estimated_cost")))
    return (pivoted.select("month_name", "month", *[F.col(p).alias(n) for p, n in _PERIOD_COLUMNS])
            .orderBy("month"))
