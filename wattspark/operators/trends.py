"""Moving averages, flat forecast, peak hour and cost trend.

W7 runs a window over the *daily* rollup: one row per calendar day, so the
single ordered partition it needs holds at most ~365 rows per year of data,
whatever the number of readings. Readings are never windowed globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspark.operators.rollups import grouped

from wattspark import constants as C


def moving_averages(e: DataFrame) -> DataFrame:
    """Daily total kWh with 7- and 30-row trailing means, null until the frame is full."""
    daily = grouped(e, "date").agg(F.sum("energy_consumption").alias("total_kwh"),
                                  F.max("load_shedding_stage").alias("max_stage"))
    w = Window.orderBy("date")
    out = daily
    for n in (7, 30):
        frame = w.rowsBetween(-(n - 1), 0)
        out = out.withColumn(f"ma{n}_kwh", F.when(F.count(F.lit(1)).over(frame) == n,
                                                   F.avg("total_kwh").over(frame)))
    return out


def forecast_7d(e: DataFrame, days: int = C.FORECAST_DAYS) -> DataFrame:
    """Flat forecast: the mean of the last 7 daily totals for each of the next 7 days.

    Needs at least 7 days of data, else no rows. The last 7 days come from a
    top-k (each task keeps its 7 latest days), not a sort of all days.
    """
    daily = grouped(e, "date").agg(F.sum("energy_consumption").alias("total_kwh"))
    last = daily.orderBy(F.desc("date")).limit(days)
    s = last.agg(F.avg("total_kwh").alias("baseline_kwh"), F.count(F.lit(1)).alias("_n"),
                 F.max("date").alias("_last"))
    s = s.where(F.col("_n") >= days)
    return s.select(F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", days))).alias("forecast_date"),
                    F.col("baseline_kwh").alias("forecast_kwh"))


def daily_peak_hour(e: DataFrame) -> DataFrame:
    """For each day name, the hour with the highest mean kWh; earliest hour on ties."""
    hourly = grouped(e, "day_name", "hour").agg(F.avg("energy_consumption").alias("avg_kwh"))
    # at most 7 x 24 rows after the aggregate: rank the hours of each day name
    w = Window.partitionBy("day_name").orderBy(F.desc("avg_kwh"), F.asc("hour"))
    return (hourly.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
            .select("day_name", F.col("hour").alias("peak_hour"), F.col("avg_kwh").alias("peak_avg_kwh")))


def cost_outage_trend(daily_cost: DataFrame, min_days: int = C.TREND_MIN_DAYS) -> DataFrame:
    """Least-squares line of daily cost on daily outage hours, when there are more than 10 days."""
    x, y = F.col("outage_hours").cast("double"), F.col("cost")
    out = daily_cost.agg(F.count(F.lit(1)).alias("days"), F.regr_slope(y, x).alias("slope"),
                         F.regr_intercept(y, x).alias("intercept"),
                         F.min(x).alias("min_outage_hours"), F.max(x).alias("max_outage_hours"))
    enough = F.col("days") > min_days
    return out.withColumns({"slope": F.when(enough, F.col("slope")),
                            "intercept": F.when(enough, F.col("intercept"))})
