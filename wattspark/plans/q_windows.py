"""Registered window, outage, anomaly, trend and error queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattspark.functions import labels as lab
from wattspark.operators import anomaly, errors, outages, trends
from wattspark.operators.baseline import with_expected_load
from wattspark.operators.enrich import enrich
from wattspark.operators.rollups import daily_cost_outage, household_stats
from wattspark.plans.registry import events, orders, orders_enriched, register
from wattspark.plans.sql import (ENRICH, EVENTS_BY_USER, EVENTS_READINGS, EXPECTED, NEIGHBOURS, ORDERS_OPEN, ORDERS_READINGS, R,
                                 with_ctes)
from wattspark.sources.adapters import events_by_user, events_outage_schedule, orders_open_households

N_OVER_R = NEIGHBOURS.format(src="r")


# --- neighbour flags and transitions (W1-W5) ---------------------------------------------------
@register("post_outage_flag", with_ctes(ORDERS_READINGS, N_OVER_R, body="""
SELECT reading_id, household_id, "timestamp", load_shedding_stage, prev_stage,
       CAST(load_shedding_stage = 0 AND prev_stage > 0 AS INTEGER) AS post_load_shedding
FROM n"""))
def q_post_outage_flag(spark, sf):
    f = outages.with_neighbour_stages(orders(spark, sf))
    return f.select("reading_id", "household_id", "timestamp", "load_shedding_stage", "prev_stage",
                    ((F.col("load_shedding_stage") == 0) & (F.col("prev_stage") > 0)).cast("int")
                    .alias("post_load_shedding"))


@register("outage_flags", with_ctes(ORDERS_READINGS, N_OVER_R, body="""
SELECT reading_id, CAST(load_shedding_stage > 0 AS INTEGER) AS is_outage,
       CAST(load_shedding_stage = 0 AND next_stage > 0 AS INTEGER) AS before_outage,
       CAST(load_shedding_stage = 0 AND prev_stage > 0 AS INTEGER) AS after_outage,
       prev_stage, next_stage
FROM n"""))
def q_outage_flags(spark, sf):
    f = outages.with_outage_flags(orders(spark, sf))
    return f.select("reading_id", "is_outage", "before_outage", "after_outage", "prev_stage", "next_stage")


@register("outage_transition", with_ctes(ORDERS_READINGS, N_OVER_R, body=f"""
SELECT {R('nm')} AS normal_kwh, {R('pre')} AS pre_outage_kwh, {R('dur')} AS during_outage_kwh,
       {R('post')} AS post_outage_kwh, {R('pre - nm')} AS pre_step, {R('dur - pre')} AS during_step,
       {R('post - dur')} AS post_step
FROM (SELECT avg(energy_consumption) FILTER (WHERE load_shedding_stage = 0 AND prev_stage = 0 AND next_stage = 0) AS nm,
             avg(energy_consumption) FILTER (WHERE load_shedding_stage = 0 AND next_stage > 0) AS pre,
             avg(energy_consumption) FILTER (WHERE load_shedding_stage > 0) AS dur,
             avg(energy_consumption) FILTER (WHERE load_shedding_stage = 0 AND prev_stage > 0) AS post
      FROM n)"""))
def q_outage_transition(spark, sf):
    return outages.outage_transition(orders(spark, sf))


@register("rebound_effect", with_ctes(ORDERS_READINGS, N_OVER_R, body=f"""
SELECT {R('b')} AS before_kwh, {R('d')} AS during_kwh, {R('a')} AS after_kwh, ah AS after_hours,
       CASE WHEN ah > 0 THEN {R('(a - b) / b * 100')} END AS rebound_pct
FROM (SELECT avg(energy_consumption) FILTER (WHERE load_shedding_stage = 0 AND next_stage > 0) AS b,
             avg(energy_consumption) FILTER (WHERE load_shedding_stage > 0) AS d,
             avg(energy_consumption) FILTER (WHERE load_shedding_stage = 0 AND prev_stage > 0) AS a,
             CAST(count_if(load_shedding_stage = 0 AND prev_stage > 0) AS BIGINT) AS ah
      FROM n)"""))
def q_rebound_effect(spark, sf):
    return outages.rebound_effect(orders(spark, sf))


# --- anomalies (W6, A29) -----------------------------------------------------------------------
_Z = """z AS (SELECT *, (energy_consumption - (SELECT avg(energy_consumption) FROM r))
                       / (SELECT stddev_samp(energy_consumption) FROM r) AS z_score FROM r)"""


@register("anomalies", with_ctes(EVENTS_READINGS, _Z, body=f"""
SELECT reading_id, household_id, "timestamp", {R('energy_consumption')} AS energy_consumption,
       load_shedding_stage, backup_power, {R('z_score')} AS z_score
FROM z WHERE abs(z_score) > 2.5"""))
def q_anomalies(spark, sf):
    return anomaly.anomalies(events(spark, sf))


@register("anomaly_count", with_ctes(EVENTS_READINGS, _Z, body="""
SELECT CAST(count_if(abs(z_score) > 2.5) AS BIGINT) AS anomalies, count(*) AS readings FROM z"""))
def q_anomaly_count(spark, sf):
    return anomaly.anomaly_count(events(spark, sf))


# --- trends (W7-W9, A20) -----------------------------------------------------------------------
@register("moving_averages", with_ctes(ORDERS_READINGS, ENRICH, body=f"""
SELECT date, {R('total_kwh')} AS total_kwh, max_stage,
       CASE WHEN count(*) OVER w7 = 7 THEN {R('avg(total_kwh) OVER w7')} END AS ma7_kwh,
       CASE WHEN count(*) OVER w30 = 30 THEN {R('avg(total_kwh) OVER w30')} END AS ma30_kwh
FROM (SELECT date, sum(energy_consumption) AS total_kwh, max(load_shedding_stage) AS max_stage FROM e GROUP BY date)
WINDOW w7 AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""))
def q_moving_averages(spark, sf):
    return trends.moving_averages(orders_enriched(spark, sf))


@register("forecast_7d", with_ctes(ORDERS_READINGS, ENRICH, body=f"""
SELECT CAST(last_date + INTERVAL (k) DAY AS DATE) AS forecast_date, {R('baseline')} AS forecast_kwh
FROM (SELECT avg(total_kwh) AS baseline, count(*) AS n, max(date) AS last_date
      FROM (SELECT date, sum(energy_consumption) AS total_kwh FROM e GROUP BY date ORDER BY date DESC LIMIT 7)),
     range(1, 8) AS t(k)
WHERE n >= 7"""))
def q_forecast_7d(spark, sf):
    return trends.forecast_7d(orders_enriched(spark, sf))


@register("daily_peak_hour", with_ctes(ORDERS_READINGS, ENRICH, body=f"""
SELECT day_name, CAST(hour AS INTEGER) AS peak_hour, {R('avg_kwh')} AS peak_avg_kwh
FROM (SELECT day_name, hour, avg_kwh,
             row_number() OVER (PARTITION BY day_name ORDER BY avg_kwh DESC, hour ASC) AS rn
      FROM (SELECT day_name, hour, avg(energy_consumption) AS avg_kwh FROM e GROUP BY day_name, hour))
WHERE rn = 1"""))
def q_daily_peak_hour(spark, sf):
    return trends.daily_peak_hour(orders_enriched(spark, sf))


@register("cost_outage_trend", with_ctes(ORDERS_READINGS, ENRICH, body=f"""
SELECT days, CASE WHEN days > 10 THEN {R('slope')} END AS slope,
       CASE WHEN days > 10 THEN {R('intercept')} END AS intercept,
       {R('min_x')} AS min_outage_hours, {R('max_x')} AS max_outage_hours
FROM (SELECT count(*) AS days, regr_slope(cost, x) AS slope, regr_intercept(cost, x) AS intercept,
             min(x) AS min_x, max(x) AS max_x
      FROM (SELECT date, sum(estimated_cost) AS cost, CAST(count_if(load_shedding_stage > 0) AS DOUBLE) AS x
            FROM e GROUP BY date))"""))
def q_cost_outage_trend(spark, sf):
    return trends.cost_outage_trend(daily_cost_outage(orders_enriched(spark, sf)))


# --- expected load (X1) and outage overlay (X2) ------------------------------------------------
def _xsql(body: str) -> str:
    return with_ctes(ORDERS_READINGS, N_OVER_R, EXPECTED, body=body)


@register("expected_load", _xsql(f"SELECT reading_id, household_id, {R('predicted')} AS predicted FROM x"))
def q_expected_load(spark, sf):
    return with_expected_load(orders(spark, sf)).select("reading_id", "household_id", "predicted")


@register("outage_overlay", with_ctes(EVENTS_READINGS, """
s AS (SELECT event_id AS seq, ts AS start, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 2 AS hours,
             CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 + 1 AS stage
      FROM events WHERE event_type = 'error')""", """
h AS (SELECT hr, arg_max(stage, seq) AS stage
      FROM (SELECT seq, stage, date_trunc('hour', start) + to_hours(CAST(k AS INTEGER)) AS hr
            FROM s, range(0, 6) AS t(k) WHERE k < hours)
      GROUP BY hr)""", body="""
SELECT r.reading_id, r.household_id, r."timestamp", CAST(coalesce(h.stage, 0) AS INTEGER) AS load_shedding_stage
FROM r LEFT JOIN h ON date_trunc('hour', r."timestamp") = h.hr"""))
def q_outage_overlay(spark, sf):
    r = events(spark, sf)
    out = outages.overlay_schedule(r, events_outage_schedule(spark, sf))
    return out.select("reading_id", "household_id", "timestamp", "load_shedding_stage")


# --- errors against the expected load (P16, P18, P19, A21-A25, J5) -----------------------------
def _predicted(spark, sf):
    return enrich(with_expected_load(orders(spark, sf)))


_XE = f"""xe AS (
  SELECT *, CAST(hour("timestamp") AS INTEGER) AS hour,
         CAST(isodow("timestamp") >= 6 AS INTEGER) AS is_weekend,
         CASE WHEN month("timestamp") IN (6, 7, 8) THEN 'Winter' WHEN month("timestamp") IN (12, 1, 2) THEN 'Summer'
              WHEN month("timestamp") IN (3, 4, 5) THEN 'Autumn' ELSE 'Spring' END AS season,
         energy_consumption - predicted AS residual
  FROM x)"""


def _xesql(body: str) -> str:
    return with_ctes(ORDERS_READINGS, N_OVER_R, EXPECTED, _XE, body=body)


@register("prediction_errors", _xsql(f"""
SELECT reading_id, {R('energy_consumption - predicted')} AS residual, {R('abs(energy_consumption - predicted)')} AS abs_error,
       {R('abs(energy_consumption - predicted) / greatest(energy_consumption, 0.01) * 100.0')} AS pct_error
FROM x"""))
def q_prediction_errors(spark, sf):
    return errors.with_errors(_predicted(spark, sf)).select("reading_id", "residual", "abs_error", "pct_error")


@register("error_metrics", _xsql(f"""
SELECT count(predicted) AS n, count(*) - count(predicted) AS n_unscored, {R('sqrt(avg((energy_consumption - predicted) * (energy_consumption - predicted)))')} AS rmse,
       {R('avg(abs(energy_consumption - predicted))')} AS mae,
       {R('avg(abs(energy_consumption - predicted) / greatest(energy_consumption, 0.01) * 100.0)')} AS mape,
       {R('1 - sum((energy_consumption - predicted) * (energy_consumption - predicted)) / (var_pop(energy_consumption) * count(*))')} AS r2
FROM x"""))
def q_error_metrics(spark, sf):
    return errors.error_metrics(_predicted(spark, sf))


@register("prediction_bands", _xsql(f"""
SELECT date, {R('a')} AS actual, {R('p')} AS predicted, {R('m')} AS residual_mean, {R('s')} AS residual_std,
       {R('p + 1.96 * sqrt(24) * s')} AS upper, {R('p - 1.96 * sqrt(24) * s')} AS lower
FROM (SELECT CAST("timestamp" AS DATE) AS date, sum(energy_consumption) AS a, sum(predicted) AS p,
             avg(energy_consumption - predicted) AS m, stddev_samp(energy_consumption - predicted) AS s
      FROM x GROUP BY 1)"""))
def q_prediction_bands(spark, sf):
    return errors.prediction_bands(_predicted(spark, sf))


@register("band_polygon", with_ctes(ORDERS_READINGS, N_OVER_R, EXPECTED, """
b AS (SELECT CAST("timestamp" AS DATE) AS date, sum(predicted) AS p, stddev_samp(energy_consumption - predicted) AS s
      FROM x GROUP BY 1)""", body=f"""
SELECT date, {R('v')} AS value, edge, ordinal FROM (
  SELECT date, p + 1.96 * sqrt(24) * s AS v, 'upper' AS edge, CAST(date - DATE '1970-01-01' AS BIGINT) AS ordinal FROM b
  UNION ALL
  SELECT date, p - 1.96 * sqrt(24) * s, 'lower', CAST(1000000000 - (date - DATE '1970-01-01') AS BIGINT) FROM b)"""))
def q_band_polygon(spark, sf):
    return errors.band_polygon(errors.prediction_bands(_predicted(spark, sf)))


@register("scenario_errors", _xesql(f"""
SELECT scenario, {R('sqrt(avg(residual * residual))')} AS rmse, {R('avg(abs(residual))')} AS mae, count(*) AS n
FROM (SELECT 'Normal Hours' AS scenario, residual FROM xe WHERE load_shedding_stage = 0
      UNION ALL SELECT 'During Outage', residual FROM xe WHERE load_shedding_stage > 0
      UNION ALL SELECT 'Winter Peak', residual FROM xe WHERE season = 'Winter' AND hour BETWEEN 17 AND 21
      UNION ALL SELECT 'Summer Midday', residual FROM xe WHERE season = 'Summer' AND hour BETWEEN 11 AND 14
      UNION ALL SELECT 'Weekend', residual FROM xe WHERE is_weekend = 1
      UNION ALL SELECT 'With Backup', residual FROM xe WHERE backup_power)
GROUP BY scenario"""))
def q_scenario_errors(spark, sf):
    return errors.scenario_errors(_predicted(spark, sf))


@register("residual_histogram", _xesql(f"""
SELECT CAST(k AS INTEGER) AS bin, {R('lo + k * w')} AS bin_start, {R('lo + (k + 1) * w')} AS bin_end, count(bin) AS count
FROM (SELECT min(residual) AS lo, (max(residual) - min(residual)) / 50.0 AS w FROM xe) CROSS JOIN range(0, 50) AS t(k)
LEFT JOIN (SELECT least(floor((residual - lo) / w), 49) AS bin
           FROM xe, (SELECT min(residual) AS lo, (max(residual) - min(residual)) / 50.0 AS w FROM xe)) b ON b.bin = t.k
GROUP BY k, lo, w"""))
def q_residual_histogram(spark, sf):
    return errors.residual_histogram(_predicted(spark, sf))


@register("residual_normal_fit", _xesql(f"""
SELECT CAST(k AS INTEGER) AS point, {R('lo + k * (hi - lo) / 99.0')} AS x,
       {R('exp(-0.5 * pow(((lo + k * (hi - lo) / 99.0) - mu) / sd, 2)) / (sd * sqrt(2 * pi())) * n * (hi - lo) / 50.0')}
         AS density
FROM (SELECT min(residual) AS lo, max(residual) AS hi, avg(residual) AS mu, stddev_samp(residual) AS sd,
             count(*) AS n FROM xe), range(0, 100) AS t(k)"""))
def q_residual_normal_fit(spark, sf):
    return errors.residual_normal_fit(_predicted(spark, sf))


@register("categorize_seasonal", _xesql(f"""
SELECT reading_id, {R('predicted')} AS predicted, season, hour,
       CASE WHEN predicted < 0.7 * (CASE WHEN season = 'Winter' THEN 1.4 ELSE 1.0 END)
                                 * (CASE WHEN hour BETWEEN 18 AND 21 THEN 1.5 ELSE 1.0 END) THEN 'Low'
            WHEN predicted < 1.5 * (CASE WHEN season = 'Winter' THEN 1.4 ELSE 1.0 END)
                                 * (CASE WHEN hour BETWEEN 18 AND 21 THEN 1.5 ELSE 1.0 END) THEN 'Normal'
            ELSE 'High' END AS category
FROM xe"""))
def q_categorize_seasonal(spark, sf):
    e = _predicted(spark, sf)
    return e.select("reading_id", "predicted", "season", "hour",
                    lab.category_seasonal("predicted", "season", "hour").alias("category"))


@register("categorize_fixed", _xsql(f"""
SELECT reading_id, {R('predicted')} AS predicted,
       CASE WHEN predicted < 0.5 THEN 'Low' WHEN predicted < 1.0 THEN 'Normal'
            WHEN predicted < 1.5 THEN 'Above Average' ELSE 'High' END AS category
FROM x"""))
def q_categorize_fixed(spark, sf):
    e = with_expected_load(orders(spark, sf))
    return e.select("reading_id", "predicted", lab.category_fixed("predicted").alias("category"))


# --- open household sets: every user a household; households without a profile -----------------
@register("user_outage_flags", with_ctes(EVENTS_BY_USER, N_OVER_R, body="""
SELECT reading_id, household_id, CAST(load_shedding_stage > 0 AS INTEGER) AS is_outage,
       CAST(load_shedding_stage = 0 AND next_stage > 0 AS INTEGER) AS before_outage,
       CAST(load_shedding_stage = 0 AND prev_stage > 0 AS INTEGER) AS after_outage
FROM n"""))
def q_user_outage_flags(spark, sf):
    f = outages.with_outage_flags(events_by_user(spark, sf))
    return f.select("reading_id", "household_id", "is_outage", "before_outage", "after_outage")


@register("user_stats", with_ctes(EVENTS_BY_USER, body=f"""
SELECT household_id, {R('avg(energy_consumption)')} AS mean_kwh, {R('stddev_samp(energy_consumption)')} AS std_kwh,
       {R('min(energy_consumption)')} AS min_kwh, {R('max(energy_consumption)')} AS max_kwh,
       arg_min(backup_power, ("timestamp", reading_id)) AS backup_power
FROM r GROUP BY household_id"""))
def q_user_stats(spark, sf):
    return household_stats(events_by_user(spark, sf))


def _open_sql(body: str) -> str:
    """Over readings of which some have no prediction; ``x`` and ``xe`` are the scored ones."""
    return with_ctes(ORDERS_OPEN, N_OVER_R, EXPECTED.replace("x AS (", "x0 AS (", 1),
                     "x AS (SELECT * FROM x0 WHERE predicted IS NOT NULL)", _XE, body=body)


def _predicted_open(spark, sf):
    return enrich(with_expected_load(orders_open_households(spark, sf)))


@register("error_metrics_open", _open_sql(f"""
SELECT count(*) AS n, (SELECT count(*) FROM x0) - count(*) AS n_unscored, {R('sqrt(avg(residual * residual))')} AS rmse,
       {R('avg(abs(residual))')} AS mae, {R('avg(abs(residual) / greatest(energy_consumption, 0.01) * 100.0)')} AS mape,
       {R('1 - sum(residual * residual) / (var_pop(energy_consumption) * count(*))')} AS r2
FROM xe"""))
def q_error_metrics_open(spark, sf):
    return errors.error_metrics(_predicted_open(spark, sf))


@register("prediction_bands_open", _open_sql(f"""
SELECT date, {R('a')} AS actual, {R('p')} AS predicted, {R('m')} AS residual_mean, {R('s')} AS residual_std,
       {R('p + 1.96 * sqrt(24) * s')} AS upper, {R('p - 1.96 * sqrt(24) * s')} AS lower
FROM (SELECT CAST("timestamp" AS DATE) AS date, sum(energy_consumption) AS a, sum(predicted) AS p,
             avg(residual) AS m, stddev_samp(residual) AS s FROM xe GROUP BY 1)"""))
def q_prediction_bands_open(spark, sf):
    return errors.prediction_bands(_predicted_open(spark, sf))


@register("residual_histogram_open", _open_sql(f"""
SELECT CAST(k AS INTEGER) AS bin, {R('lo + k * w')} AS bin_start, {R('lo + (k + 1) * w')} AS bin_end, count(bin) AS count
FROM (SELECT min(residual) AS lo, (max(residual) - min(residual)) / 50.0 AS w FROM xe) CROSS JOIN range(0, 50) AS t(k)
LEFT JOIN (SELECT least(floor((residual - lo) / w), 49) AS bin
           FROM xe, (SELECT min(residual) AS lo, (max(residual) - min(residual)) / 50.0 AS w FROM xe)) b ON b.bin = t.k
GROUP BY k, lo, w"""))
def q_residual_histogram_open(spark, sf):
    return errors.residual_histogram(_predicted_open(spark, sf))


@register("scenario_errors_open", _open_sql(f"""
SELECT scenario, {R('sqrt(avg(residual * residual))')} AS rmse, {R('avg(abs(residual))')} AS mae, count(*) AS n
FROM (SELECT 'Normal Hours' AS scenario, residual FROM xe WHERE load_shedding_stage = 0
      UNION ALL SELECT 'During Outage', residual FROM xe WHERE load_shedding_stage > 0
      UNION ALL SELECT 'Winter Peak', residual FROM xe WHERE season = 'Winter' AND hour BETWEEN 17 AND 21
      UNION ALL SELECT 'Summer Midday', residual FROM xe WHERE season = 'Summer' AND hour BETWEEN 11 AND 14
      UNION ALL SELECT 'Weekend', residual FROM xe WHERE is_weekend = 1
      UNION ALL SELECT 'With Backup', residual FROM xe WHERE backup_power)
GROUP BY scenario"""))
def q_scenario_errors_open(spark, sf):
    return errors.scenario_errors(_predicted_open(spark, sf))
