"""Aggregations over (enriched) readings.

Every rollup is a single ``groupBy().agg()`` (or a global ``agg``), so Spark
runs a partial aggregate in each scan task and shuffles only one row per group
per task. Conditional statistics use ``avg(when(...))`` / ``count_if`` in the
same pass instead of separate filtered scans. Ratios use ``try_divide`` so a
zero denominator gives null instead of an ANSI error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark import constants as C
from wattspark.functions import labels as lab
from wattspark.functions.ordering import order_key

def kwh():
    return F.col("energy_consumption")


def stage():
    return F.col("load_shedding_stage")


def outage():
    return F.col("load_shedding_stage") > 0




def grouped(df: DataFrame, *keys):
    """``groupBy`` that leaves out rows whose grouping keys are null, as a pandas groupby does.

    ``keys`` are column names or (column, alias) pairs; the null filter is
    pushed below the aggregate (and into the scan where it can be).
    """
    cols = [F.col(k) if isinstance(k, str) else k[0].alias(k[1]) for k in keys]
    raw = [F.col(k) if isinstance(k, str) else k[0] for k in keys]
    cond = raw[0].isNotNull()
    for c in raw[1:]:
        cond = cond & c.isNotNull()
    return df.where(cond).groupBy(*cols)


def _pct(num, den):
    return F.try_divide(num.cast("double"), den.cast("double")) * 100.0


def dataset_overview(r: DataFrame) -> DataFrame:
    """Records, date range, distinct households, total / mean / min / max kWh."""
    return r.agg(
        F.count(F.lit(1)).alias("records"),
        F.to_date(F.min("timestamp")).alias("first_date"),
        F.to_date(F.max("timestamp")).alias("last_date"),
        F.count_distinct("household_id").alias("households"),
        F.sum(kwh()).alias("total_kwh"),
        F.avg(kwh()).alias("mean_kwh"),
        F.min(kwh()).alias("min_kwh"),
        F.max(kwh()).alias("max_kwh"),
    )


def quality_checks(r: DataFrame) -> DataFrame:
    """Negative readings, readings above 6 kWh and outage share."""
    n = F.count(F.lit(1))
    return r.agg(
        n.alias("records"),
        F.count_if(kwh() < 0).alias("negative_readings"),
        F.count_if(kwh() > C.HIGH_USAGE_KWH).alias("high_usage_readings"),
        _pct(F.count_if(kwh() > C.HIGH_USAGE_KWH), n).alias("high_usage_pct"),
        F.count_if(outage()).alias("outage_hours"),
        _pct(F.count_if(outage()), n).alias("outage_pct"),
    )


def kpi_cards(e: DataFrame) -> DataFrame:
    """Headline KPIs: total, peak, mean, outage hours and share, total estimated cost (A3)."""
    n = F.count(F.lit(1))
    return e.agg(
        F.sum(kwh()).alias("total_kwh"),
        F.max(kwh()).alias("peak_kwh"),
        F.avg(kwh()).alias("mean_kwh"),
        F.count_if(outage()).alias("outage_hours"),
        _pct(F.count_if(outage()), n).alias("outage_pct"),
        F.sum("estimated_cost").alias("total_cost"),
    )


def outage_split(r: DataFrame) -> DataFrame:
    """Mean kWh with and without an outage and the reduction %."""
    out = r.agg(F.avg(F.when(outage(), kwh())).alias("avg_during_outage"),
                F.avg(F.when(stage() == 0, kwh())).alias("avg_without_outage"))
    return out.withColumn("reduction_pct",
                          (F.lit(1.0) - F.try_divide(F.col("avg_during_outage"), F.col("avg_without_outage"))) * 100.0)


def backup_outage_split(r: DataFrame) -> DataFrame:
    """Mean kWh during outages with / without backup power and the uplift %."""
    b = F.col("backup_power")
    out = r.agg(F.avg(F.when(b & outage(), kwh())).alias("during_with_backup"),
                F.avg(F.when(~b & outage(), kwh())).alias("during_no_backup"))
    return out.withColumn("backup_uplift_pct",
                          (F.try_divide(F.col("during_with_backup"), F.col("during_no_backup")) - F.lit(1.0)) * 100.0)


def seasonal_stats(e: DataFrame) -> DataFrame:
    """Mean, sum, sample std by season, highest mean first."""
    return (grouped(e, "season")
            .agg(F.avg(kwh()).alias("mean_kwh"), F.sum(kwh()).alias("sum_kwh"), F.stddev_samp(kwh()).alias("std_kwh"))
            .orderBy(F.desc("mean_kwh")))


def evening_peak_by_season(e: DataFrame) -> DataFrame:
    """Winter and summer evening (18..21) means and winter's excess %."""
    evening = F.col("hour").between(*C.EVENING_HOURS)
    out = e.agg(F.avg(F.when((F.col("season") == "Winter") & evening, kwh())).alias("winter_evening_kwh"),
                F.avg(F.when((F.col("season") == "Summer") & evening, kwh())).alias("summer_evening_kwh"))
    return out.withColumn("winter_over_summer_pct",
                          (F.try_divide(F.col("winter_evening_kwh"), F.col("summer_evening_kwh")) - F.lit(1.0)) * 100.0)


def household_stats(r: DataFrame) -> DataFrame:
    """Per household mean / std / min / max and backup flag of its first reading."""
    first = F.min_by("backup_power", order_key("timestamp", "reading_id"))
    return (grouped(r, "household_id")
            .agg(F.avg(kwh()).alias("mean_kwh"), F.stddev_samp(kwh()).alias("std_kwh"),
                 F.min(kwh()).alias("min_kwh"), F.max(kwh()).alias("max_kwh"), first.alias("backup_power"))
            .orderBy("mean_kwh"))


def hourly_profile_by_season(e: DataFrame) -> DataFrame:
    """Mean kWh by season and hour."""
    return grouped(e, "season", "hour").agg(F.avg(kwh()).alias("avg_kwh")).orderBy("season", "hour")


def daily_summary(e: DataFrame) -> DataFrame:
    """Per calendar day: total, mean, max, min kWh and the day name (A10)."""
    return (grouped(e, "date")
            .agg(F.sum(kwh()).alias("total_kwh"), F.avg(kwh()).alias("avg_kwh"),
                 F.max(kwh()).alias("max_kwh"), F.min(kwh()).alias("min_kwh"))
            .withColumn("day_name", F.date_format("date", "EEEE")))


def daily_kpis(daily: DataFrame) -> DataFrame:
    """Cards over the daily summary: total, mean daily total, peak and minimum."""
    return daily.agg(F.sum("total_kwh").alias("total_kwh"), F.avg("total_kwh").alias("avg_daily_kwh"),
                     F.max("max_kwh").alias("peak_kwh"), F.min("min_kwh").alias("min_kwh"))


def stage_impact(r: DataFrame) -> DataFrame:
    """Per outage stage: label, mean, sample std and count of readings."""
    return (grouped(r, (stage(), "stage"))
            .agg(F.avg(kwh()).alias("mean_kwh"), F.stddev_samp(kwh()).alias("std_kwh"), F.count(F.lit(1)).alias("readings"))
            .withColumn("label", lab.stage_label("stage", "No Outage"))
            .orderBy("stage"))


def backup_effect(r: DataFrame) -> DataFrame:
    """Per stage: mean kWh without / with backup.

    A side that has no readings at all reads as 0 (the whole column is missing);
    a stage without readings on a side that exists elsewhere stays null.
    """
    b = F.col("backup_power")
    out = (r.groupBy(stage().alias("stage"))
           .agg(F.avg(F.when(~b, kwh())).alias("no"), F.avg(F.when(b, kwh())).alias("with"),
                F.count_if(~b).alias("n_no"), F.count_if(b).alias("n_with")))
    # at most eight rows (the stages and null) become one, which knows whether a side exists at all
    one = out.agg(F.collect_list(F.struct("stage", "no", "with")).alias("rows"),
                  (F.sum("n_no") > 0).alias("has_no"), (F.sum("n_with") > 0).alias("has_with"))
    rows = one.select("has_no", "has_with", F.inline("rows")).where("stage is not null")
    return (rows.select("stage", lab.stage_label("stage", "Normal").alias("label"),
                        F.when(F.col("has_no"), F.col("no")).otherwise(F.lit(0.0)).alias("no_backup_kwh"),
                        F.when(F.col("has_with"), F.col("with")).otherwise(F.lit(0.0)).alias("with_backup_kwh"))
            .orderBy("stage"))


def outage_by_hour(e: DataFrame) -> DataFrame:
    """Outage readings per hour of day; hours without outages are left out."""
    return (grouped(e.where(outage()), "hour").agg(F.count(F.lit(1)).alias("outage_hours"))
            .orderBy("hour"))


def avg_by_hour(e: DataFrame) -> DataFrame:
    """Mean kWh per hour of day."""
    return grouped(e, "hour").agg(F.avg(kwh()).alias("avg_kwh")).orderBy("hour")


def day_hour_distribution(e: DataFrame) -> DataFrame:
    """Mean and total kWh per (day name, hour)."""
    return grouped(e, "day_name", "hour").agg(F.avg(kwh()).alias("avg_kwh"), F.sum(kwh()).alias("total_kwh"))


def day_totals(e: DataFrame) -> DataFrame:
    """Total kWh per day name."""
    return grouped(e, "day_name").agg(F.sum(kwh()).alias("total_kwh"))


def peak_shift_savings(e: DataFrame, shift: float = C.PEAK_SHIFT_FRACTION) -> DataFrame:
    """Savings from moving a share of peak kWh to off-peak tariffs."""
    peak = lab.is_peak_period("time_period")
    out = e.agg(F.sum(F.when(peak, kwh()).otherwise(F.lit(0.0))).alias("peak_kwh"),
                F.sum(F.when(~peak, kwh()).otherwise(F.lit(0.0))).alias("offpeak_kwh"))
    current = F.col("peak_kwh") * C.TARIFF_PEAK + F.col("offpeak_kwh") * C.TARIFF_OFFPEAK
    potential = (F.col("peak_kwh") * (1 - shift) * C.TARIFF_PEAK
                 + (F.col("offpeak_kwh") + F.col("peak_kwh") * shift) * C.TARIFF_OFFPEAK)
    return out.withColumns({"current_cost": current, "potential_cost": potential}) \
        .withColumn("savings", F.col("current_cost") - F.col("potential_cost"))


def household_cost(e: DataFrame) -> DataFrame:
    """Per household: cost, kWh, backup flag of the first reading, cost per kWh."""
    first = F.min_by("backup_power", order_key("timestamp", "reading_id"))
    return (grouped(e, "household_id")
            .agg(F.sum("estimated_cost").alias("estimated_cost"), F.sum(kwh()).alias("energy_consumption"),
                 first.alias("backup_power"))
            .withColumn("cost_per_kwh", F.try_divide(F.col("estimated_cost"), F.col("energy_consumption"))))


def daily_cost_outage(e: DataFrame) -> DataFrame:
    """Per day: cost, outage hours and kWh."""
    return grouped(e, "date").agg(F.sum("estimated_cost").alias("cost"),
                                 F.count_if(outage()).alias("outage_hours"),
                                 F.sum(kwh()).alias("consumption"))


def daily_trend(e: DataFrame) -> DataFrame:
    """Per day: total kWh, highest stage, and whether any outage happened."""
    return (grouped(e, "date").agg(F.sum(kwh()).alias("total_kwh"), F.max(stage()).alias("max_stage"))
            .withColumn("is_outage_day", F.col("max_stage") > 0))


def hourly_extract(e: DataFrame) -> DataFrame:
    """BI hourly extract: date, day_name, hour, total / avg / min / max kWh."""
    return grouped(e, "date", "day_name", "hour").agg(
        F.sum(kwh()).alias("total_kwh"), F.avg(kwh()).alias("avg_kwh"),
        F.min(kwh()).alias("min_kwh"), F.max(kwh()).alias("max_kwh"))


def daily_extract(e: DataFrame) -> DataFrame:
    """BI daily extract: date, day_name, day_of_week, total / avg / min / max kWh."""
    return grouped(e, "date", "day_name", "day_of_week").agg(
        F.sum(kwh()).alias("total_kwh"), F.avg(kwh()).alias("avg_kwh"),
        F.min(kwh()).alias("min_kwh"), F.max(kwh()).alias("max_kwh"))


def categorize_bi(hourly: DataFrame) -> DataFrame:
    """BI consumption category of each hourly extract row (P20)."""
    return hourly.withColumn("category", lab.category_bi("avg_kwh"))


def bi_measures(e: DataFrame) -> DataFrame:
    """BI measures: mean of the days' mean kWh, and the highest mean of an hour of a day.

    Both come from one rollup of sum and count per day and hour: one scan.
    """
    hourly = grouped(e, "date", "hour").agg(F.sum(kwh()).alias("_s"), F.count(kwh()).alias("_n"))
    daily = hourly.groupBy("date").agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("_d"),
                                       F.max(F.try_divide(F.col("_s"), F.col("_n"))).alias("_p"))
    return daily.agg(F.avg("_d").alias("daily_average_kwh"), F.max("_p").alias("peak_hour_kwh"))


def weekend_vs_weekday_total(hourly: DataFrame) -> DataFrame:
    """Total kWh on weekend vs weekday names."""
    d = F.col("day_name")
    return hourly.agg(F.sum(F.when(d.isin(*C.WEEKEND_DAYS), F.col("total_kwh"))).alias("weekend_kwh"),
                      F.sum(F.when(d.isin(*C.WEEKDAY_DAYS), F.col("total_kwh"))).alias("weekday_kwh"))


def warehouse_projection(r: DataFrame) -> DataFrame:
    """The three-column warehouse table: household_id, timestamp, energy_consumption as FLOAT."""
    return r.select("household_id", "timestamp", kwh().cast("float").alias("energy_consumption"))
