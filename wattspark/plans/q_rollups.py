"""Registered rollups, slicers, pivots, extracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattspark.functions import calendar as cal
from wattspark.operators import filters, reshape, rollups
from wattspark.operators.enrich import enrich
from wattspark.operators.quantiles import season_box
from wattspark.plans.registry import events, orders, orders_enriched, register
from wattspark.sources.adapters import orders_between
from wattspark.plans.sql import ENRICH, EVENTS_READINGS, ORDERS_READINGS, R, with_ctes


def _orders(spark, sf):
    return orders_enriched(spark, sf)


def _osql(body: str) -> str:
    return with_ctes(ORDERS_READINGS, ENRICH, body=body)


def _esql(body: str) -> str:
    return with_ctes(EVENTS_READINGS, ENRICH, body=body)


# --- flagship: daily summary (A10) -----------------------------------------------------------
@register("daily_summary", _osql(f"""
SELECT date, {R('sum(energy_consumption)')} AS total_kwh, {R('avg(energy_consumption)')} AS avg_kwh,
       {R('max(energy_consumption)')} AS max_kwh, {R('min(energy_consumption)')} AS min_kwh,
       dayname(date) AS day_name
FROM e GROUP BY date"""))
def q_daily_summary(spark, sf):
    return rollups.daily_summary(_orders(spark, sf))


@register("daily_kpis", _osql(f"""
SELECT {R('sum(total_kwh)')} AS total_kwh, {R('avg(total_kwh)')} AS avg_daily_kwh,
       {R('max(max_kwh)')} AS peak_kwh, {R('min(min_kwh)')} AS min_kwh
FROM (SELECT date, sum(energy_consumption) AS total_kwh, max(energy_consumption) AS max_kwh,
             min(energy_consumption) AS min_kwh FROM e GROUP BY date)"""))
def q_daily_kpis(spark, sf):
    return rollups.daily_kpis(rollups.daily_summary(_orders(spark, sf)))


@register("dataset_overview", _osql(f"""
SELECT count(*) AS records, CAST(min("timestamp") AS DATE) AS first_date, CAST(max("timestamp") AS DATE) AS last_date,
       count(DISTINCT household_id) AS households, {R('sum(energy_consumption)')} AS total_kwh,
       {R('avg(energy_consumption)')} AS mean_kwh, {R('min(energy_consumption)')} AS min_kwh,
       {R('max(energy_consumption)')} AS max_kwh
FROM e"""))
def q_dataset_overview(spark, sf):
    return rollups.dataset_overview(orders(spark, sf))


@register("quality_checks", _esql(f"""
SELECT count(*) AS records, CAST(count_if(energy_consumption < 0) AS BIGINT) AS negative_readings,
       CAST(count_if(energy_consumption > 6) AS BIGINT) AS high_usage_readings,
       {R('count_if(energy_consumption > 6) * 100.0::DOUBLE / count(*)')} AS high_usage_pct,
       CAST(count_if(load_shedding_stage > 0) AS BIGINT) AS outage_hours,
       {R('count_if(load_shedding_stage > 0) * 100.0::DOUBLE / count(*)')} AS outage_pct
FROM e"""))
def q_quality_checks(spark, sf):
    return rollups.quality_checks(events(spark, sf))


@register("kpi_cards", _osql(f"""
SELECT {R('sum(energy_consumption)')} AS total_kwh, {R('max(energy_consumption)')} AS peak_kwh,
       {R('avg(energy_consumption)')} AS mean_kwh, CAST(count_if(load_shedding_stage > 0) AS BIGINT) AS outage_hours,
       {R('count_if(load_shedding_stage > 0) * 100.0::DOUBLE / count(*)')} AS outage_pct,
       {R('sum(estimated_cost)')} AS total_cost
FROM e"""))
def q_kpi_cards(spark, sf):
    return rollups.kpi_cards(_orders(spark, sf))


@register("outage_split", _osql(f"""
SELECT {R('d')} AS avg_during_outage, {R('w')} AS avg_without_outage, {R('(1 - d / w) * 100')} AS reduction_pct
FROM (SELECT avg(energy_consumption) FILTER (WHERE load_shedding_stage > 0) AS d,
             avg(energy_consumption) FILTER (WHERE load_shedding_stage = 0) AS w FROM e)"""))
def q_outage_split(spark, sf):
    return rollups.outage_split(orders(spark, sf))


@register("backup_outage_split", _osql(f"""
SELECT {R('wb')} AS during_with_backup, {R('nb')} AS during_no_backup, {R('(wb / nb - 1) * 100')} AS backup_uplift_pct
FROM (SELECT avg(energy_consumption) FILTER (WHERE backup_power AND load_shedding_stage > 0) AS wb,
             avg(energy_consumption) FILTER (WHERE NOT backup_power AND load_shedding_stage > 0) AS nb FROM e)"""))
def q_backup_outage_split(spark, sf):
    return rollups.backup_outage_split(orders(spark, sf))


@register("seasonal_stats", _osql(f"""
SELECT season, {R('avg(energy_consumption)')} AS mean_kwh, {R('sum(energy_consumption)')} AS sum_kwh,
       {R('stddev_samp(energy_consumption)')} AS std_kwh
FROM e GROUP BY season"""))
def q_seasonal_stats(spark, sf):
    return rollups.seasonal_stats(_orders(spark, sf))


@register("evening_peak_by_season", _osql(f"""
SELECT {R('w')} AS winter_evening_kwh, {R('s')} AS summer_evening_kwh, {R('(w / s - 1) * 100')} AS winter_over_summer_pct
FROM (SELECT avg(energy_consumption) FILTER (WHERE season = 'Winter' AND hour BETWEEN 18 AND 21) AS w,
             avg(energy_consumption) FILTER (WHERE season = 'Summer' AND hour BETWEEN 18 AND 21) AS s FROM e)"""))
def q_evening_peak_by_season(spark, sf):
    return rollups.evening_peak_by_season(_orders(spark, sf))


@register("household_stats", _osql(f"""
SELECT household_id, {R('avg(energy_consumption)')} AS mean_kwh, {R('stddev_samp(energy_consumption)')} AS std_kwh,
       {R('min(energy_consumption)')} AS min_kwh, {R('max(energy_consumption)')} AS max_kwh,
       arg_min(backup_power, ("timestamp", reading_id)) AS backup_power
FROM e WHERE household_id IS NOT NULL GROUP BY household_id"""))
def q_household_stats(spark, sf):
    return rollups.household_stats(orders(spark, sf))


@register("hourly_profile_by_season", _osql(f"""
SELECT season, hour, {R('avg(energy_consumption)')} AS avg_kwh FROM e GROUP BY season, hour"""))
def q_hourly_profile_by_season(spark, sf):
    return rollups.hourly_profile_by_season(_orders(spark, sf))


@register("stage_impact", _osql(f"""
SELECT load_shedding_stage AS stage, {R('avg(energy_consumption)')} AS mean_kwh,
       {R('stddev_samp(energy_consumption)')} AS std_kwh, count(*) AS readings,
       CASE WHEN load_shedding_stage > 0 THEN 'Stage ' || CAST(load_shedding_stage AS VARCHAR) ELSE 'No Outage' END AS label
FROM e GROUP BY load_shedding_stage"""))
def q_stage_impact(spark, sf):
    return rollups.stage_impact(orders(spark, sf))


@register("backup_effect", _osql(f"""
SELECT load_shedding_stage AS stage,
       CASE WHEN load_shedding_stage > 0 THEN 'Stage ' || CAST(load_shedding_stage AS VARCHAR) ELSE 'Normal' END AS label,
       CASE WHEN (SELECT count_if(NOT backup_power) FROM e) > 0
            THEN {R('avg(energy_consumption) FILTER (WHERE NOT backup_power)')} ELSE 0.0 END AS no_backup_kwh,
       CASE WHEN (SELECT count_if(backup_power) FROM e) > 0
            THEN {R('avg(energy_consumption) FILTER (WHERE backup_power)')} ELSE 0.0 END AS with_backup_kwh
FROM e GROUP BY load_shedding_stage"""))
def q_backup_effect(spark, sf):
    return rollups.backup_effect(orders(spark, sf))


@register("outage_by_hour", _osql("""
SELECT hour, count(*) AS outage_hours FROM e WHERE load_shedding_stage > 0 GROUP BY hour"""))
def q_outage_by_hour(spark, sf):
    return rollups.outage_by_hour(_orders(spark, sf))


@register("avg_by_hour", _osql(f"""
SELECT hour, {R('avg(energy_consumption)')} AS avg_kwh FROM e GROUP BY hour"""))
def q_avg_by_hour(spark, sf):
    return rollups.avg_by_hour(_orders(spark, sf))


@register("day_hour_distribution", _osql(f"""
SELECT day_name, hour, {R('avg(energy_consumption)')} AS avg_kwh, {R('sum(energy_consumption)')} AS total_kwh
FROM e GROUP BY day_name, hour"""))
def q_day_hour_distribution(spark, sf):
    return rollups.day_hour_distribution(_orders(spark, sf))


@register("day_totals", _osql(f"""
SELECT day_name, {R('sum(energy_consumption)')} AS total_kwh FROM e GROUP BY day_name"""))
def q_day_totals(spark, sf):
    return rollups.day_totals(_orders(spark, sf))


@register("peak_shift_savings", _osql(f"""
SELECT {R('p')} AS peak_kwh, {R('o')} AS offpeak_kwh,
       {R('p * 2.85::DOUBLE + o * 1.45::DOUBLE')} AS current_cost,
       {R('p * 0.8::DOUBLE * 2.85::DOUBLE + (o + p * 0.2::DOUBLE) * 1.45::DOUBLE')} AS potential_cost,
       {R('(p * 2.85::DOUBLE + o * 1.45::DOUBLE) - (p * 0.8::DOUBLE * 2.85::DOUBLE + (o + p * 0.2::DOUBLE) * 1.45::DOUBLE)')} AS savings
FROM (SELECT sum(CASE WHEN time_period IN ('Morning Peak', 'Evening Peak') THEN energy_consumption ELSE 0.0 END) AS p,
             sum(CASE WHEN time_period NOT IN ('Morning Peak', 'Evening Peak') THEN energy_consumption ELSE 0.0 END) AS o
      FROM e)"""))
def q_peak_shift_savings(spark, sf):
    return rollups.peak_shift_savings(_orders(spark, sf))


@register("household_cost", _osql(f"""
SELECT household_id, {R('sum(estimated_cost)')} AS estimated_cost, {R('sum(energy_consumption)')} AS energy_consumption,
       arg_min(backup_power, ("timestamp", reading_id)) AS backup_power,
       {R('sum(estimated_cost) / sum(energy_consumption)')} AS cost_per_kwh
FROM e WHERE household_id IS NOT NULL GROUP BY household_id"""))
def q_household_cost(spark, sf):
    return rollups.household_cost(_orders(spark, sf))


@register("daily_cost_outage", _osql(f"""
SELECT date, {R('sum(estimated_cost)')} AS cost, CAST(count_if(load_shedding_stage > 0) AS BIGINT) AS outage_hours,
       {R('sum(energy_consumption)')} AS consumption
FROM e GROUP BY date"""))
def q_daily_cost_outage(spark, sf):
    return rollups.daily_cost_outage(_orders(spark, sf))


@register("daily_trend", _osql(f"""
SELECT date, {R('sum(energy_consumption)')} AS total_kwh, max(load_shedding_stage) AS max_stage,
       max(load_shedding_stage) > 0 AS is_outage_day
FROM e GROUP BY date"""))
def q_daily_trend(spark, sf):
    return rollups.daily_trend(_orders(spark, sf))


_HOURLY = """h AS (SELECT date, day_name, hour, sum(energy_consumption) AS total_kwh, avg(energy_consumption) AS avg_kwh,
                  min(energy_consumption) AS min_kwh, max(energy_consumption) AS max_kwh
           FROM e GROUP BY date, day_name, hour)"""


@register("hourly_extract", _osql(f"""
SELECT date, day_name, hour, {R('sum(energy_consumption)')} AS total_kwh, {R('avg(energy_consumption)')} AS avg_kwh,
       {R('min(energy_consumption)')} AS min_kwh, {R('max(energy_consumption)')} AS max_kwh
FROM e GROUP BY date, day_name, hour"""))
def q_hourly_extract(spark, sf):
    return rollups.hourly_extract(_orders(spark, sf))


@register("daily_extract", _osql(f"""
SELECT date, day_name, day_of_week, {R('sum(energy_consumption)')} AS total_kwh,
       {R('avg(energy_consumption)')} AS avg_kwh, {R('min(energy_consumption)')} AS min_kwh,
       {R('max(energy_consumption)')} AS max_kwh
FROM e GROUP BY date, day_name, day_of_week"""))
def q_daily_extract(spark, sf):
    return rollups.daily_extract(_orders(spark, sf))


@register("categorize_bi", with_ctes(ORDERS_READINGS, ENRICH, _HOURLY, body=f"""
SELECT date, day_name, hour, {R('total_kwh')} AS total_kwh, {R('avg_kwh')} AS avg_kwh, {R('min_kwh')} AS min_kwh,
       {R('max_kwh')} AS max_kwh,
       CASE WHEN avg_kwh < 2.0 THEN 'Low' WHEN avg_kwh < 2.5 THEN 'Medium' ELSE 'High' END AS category
FROM h"""))
def q_categorize_bi(spark, sf):
    return rollups.categorize_bi(rollups.hourly_extract(_orders(spark, sf)))


@register("bi_measures", with_ctes(ORDERS_READINGS, ENRICH, _HOURLY, body=f"""
SELECT {R('(SELECT avg(avg_kwh) FROM (SELECT date, avg(energy_consumption) AS avg_kwh FROM e GROUP BY date))')}
         AS daily_average_kwh,
       {R('(SELECT max(avg_kwh) FROM h)')} AS peak_hour_kwh"""))
def q_bi_measures(spark, sf):
    e = _orders(spark, sf)
    return rollups.bi_measures(e)


@register("weekend_vs_weekday_total", with_ctes(ORDERS_READINGS, ENRICH, _HOURLY, body=f"""
SELECT {R("sum(total_kwh) FILTER (WHERE day_name IN ('Saturday', 'Sunday'))")} AS weekend_kwh,
       {R("sum(total_kwh) FILTER (WHERE day_name IN ('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'))")}
         AS weekday_kwh
FROM h"""))
def q_weekend_vs_weekday_total(spark, sf):
    return rollups.weekend_vs_weekday_total(rollups.hourly_extract(_orders(spark, sf)))


@register("warehouse_projection", with_ctes(ORDERS_READINGS, body="""
SELECT household_id, "timestamp", CAST(energy_consumption AS FLOAT) AS energy_consumption FROM r"""))
def q_warehouse_projection(spark, sf):
    return rollups.warehouse_projection(orders(spark, sf))


# --- per-row derivations (P1-P5, P14, P15) ---------------------------------------------------
@register("calendar_features", _osql("""
SELECT reading_id, hour, day_of_week, month, CAST(dayofyear("timestamp") AS INTEGER) AS day_of_year, date,
       day_name, month_name, week, is_weekend
FROM e"""))
def q_calendar_features(spark, sf):
    e = _orders(spark, sf)
    return e.select("reading_id", "hour", "day_of_week", "month", cal.day_of_year("timestamp").alias("day_of_year"),
                    "date", "day_name", "month_name", "week", "is_weekend")


@register("season_label", _osql("SELECT reading_id, month, season FROM e"))
def q_season_label(spark, sf):
    return _orders(spark, sf).select("reading_id", "month", "season")


@register("time_period", _osql("SELECT reading_id, hour, time_period FROM e"))
def q_time_period(spark, sf):
    return _orders(spark, sf).select("reading_id", "hour", "time_period")


@register("bi_peak_hours", _osql("""
SELECT reading_id, hour,
       CASE WHEN hour BETWEEN 17 AND 21 THEN 'Evening Peak' WHEN hour BETWEEN 7 AND 10 THEN 'Morning Peak'
            ELSE 'Off-Peak' END AS peak_label
FROM e"""))
def q_bi_peak_hours(spark, sf):
    e = _orders(spark, sf)
    return e.select("reading_id", "hour", cal.bi_peak_label("hour").alias("peak_label"))


@register("outage_severity", _osql("SELECT reading_id, load_shedding_stage, outage_severity FROM e"))
def q_outage_severity(spark, sf):
    return _orders(spark, sf).select("reading_id", "load_shedding_stage", "outage_severity")


@register("estimated_cost", _osql(f"SELECT reading_id, time_period, {R('estimated_cost')} AS estimated_cost FROM e"))
def q_estimated_cost(spark, sf):
    return _orders(spark, sf).select("reading_id", "time_period", "estimated_cost")


# --- slicer (F1-F3) --------------------------------------------------------------------------
_SLICE = dict(start_date="1996-03-01", end_date="1997-10-31",
              day_names=("Monday", "Tuesday", "Wednesday", "Thursday", "Friday"), hour_range=(6, 21))


@register("slicer_filter", _osql(f"""
SELECT reading_id, "timestamp", {R('energy_consumption')} AS energy_consumption FROM e
WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-10-31'
  AND day_name IN ('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday') AND hour BETWEEN 6 AND 21"""))
def q_slicer_filter(spark, sf):
    r = orders_between(spark, sf, _SLICE["start_date"], _SLICE["end_date"])
    return filters.slicer_filter(r, **_SLICE).select("reading_id", "timestamp", "energy_consumption")


@register("avg_by_hour_sliced", _osql(f"""
SELECT hour, {R('avg(energy_consumption)')} AS avg_kwh FROM e
WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-10-31'
  AND day_name IN ('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday') AND hour BETWEEN 6 AND 21
GROUP BY hour"""))
def q_avg_by_hour_sliced(spark, sf):
    r = orders_between(spark, sf, _SLICE["start_date"], _SLICE["end_date"])
    return rollups.avg_by_hour(enrich(filters.slicer_filter(r, **_SLICE)))


@register("slicer_fallback", _osql(f"""
SELECT date, {R('sum(energy_consumption)')} AS total_kwh, {R('avg(energy_consumption)')} AS avg_kwh,
       {R('max(energy_consumption)')} AS max_kwh, {R('min(energy_consumption)')} AS min_kwh, dayname(date) AS day_name
FROM e
WHERE (date BETWEEN DATE '1990-01-01' AND DATE '1990-12-31')
   OR (SELECT count(*) FROM e WHERE date BETWEEN DATE '1990-01-01' AND DATE '1990-12-31') = 0
GROUP BY date"""))
def q_slicer_fallback(spark, sf):
    start, end = "1990-01-01", "1990-12-31"
    sliced = filters.slicer_with_fallback(orders(spark, sf), start_date=start, end_date=end)
    return rollups.daily_summary(enrich(sliced))


# --- pivots (J2-J4, A17) and box summary (A26) ----------------------------------------------
@register("heatmap_day_hour", with_ctes(ORDERS_READINGS, ENRICH, body=f"""
SELECT d.day_name, {', '.join(R(f'avg(e.energy_consumption) FILTER (WHERE e.hour = {h})') + f' AS h{h:02d}' for h in range(24))}
FROM (VALUES ('Monday', 1), ('Tuesday', 2), ('Wednesday', 3), ('Thursday', 4), ('Friday', 5), ('Saturday', 6),
             ('Sunday', 7)) AS d(day_name, day_order)
LEFT JOIN e ON e.day_name = d.day_name
GROUP BY d.day_name, d.day_order"""))
def q_heatmap_day_hour(spark, sf):
    return reshape.heatmap_day_hour(_orders(spark, sf)).drop("day_order")


@register("weekday_weekend_profile", _osql(f"""
SELECT hour, {R('avg(energy_consumption) FILTER (WHERE is_weekend = 0)')} AS weekday_kwh,
       {R('avg(energy_consumption) FILTER (WHERE is_weekend = 1)')} AS weekend_kwh
FROM e GROUP BY hour"""))
def q_weekday_weekend_profile(spark, sf):
    return reshape.weekday_weekend_profile(_orders(spark, sf))


@register("monthly_cost_by_period", _osql(f"""
SELECT month_name, month,
       {R("sum(estimated_cost) FILTER (WHERE time_period = 'Off-Peak')")} AS off_peak_cost,
       {R("sum(estimated_cost) FILTER (WHERE time_period = 'Daytime')")} AS daytime_cost,
       {R("sum(estimated_cost) FILTER (WHERE time_period = 'Morning Peak')")} AS morning_peak_cost,
       {R("sum(estimated_cost) FILTER (WHERE time_period = 'Evening Peak')")} AS evening_peak_cost
FROM e GROUP BY month_name, month"""))
def q_monthly_cost_by_period(spark, sf):
    return reshape.monthly_cost_by_period(_orders(spark, sf))


@register("season_box", _osql(f"""
SELECT season, {R('min(energy_consumption)')} AS min_kwh, {R('max(energy_consumption)')} AS max_kwh,
       {R('avg(energy_consumption)')} AS mean_kwh, {R('stddev_samp(energy_consumption)')} AS sd_kwh,
       {R('quantile_cont(energy_consumption, 0.25)')} AS q1_kwh, {R('quantile_cont(energy_consumption, 0.5)')} AS median_kwh,
       {R('quantile_cont(energy_consumption, 0.75)')} AS q3_kwh
FROM e GROUP BY season"""))
def q_season_box(spark, sf):
    return season_box(_orders(spark, sf))
