"""Registered feature, split, request and explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattspark import constants as C
from wattspark.functions import encoding as enc
from wattspark.functions import labels as lab
from wattspark.operators.features import feature_matrix
from wattspark.operators.requests import parse_requests, request_features, validate_requests
from wattspark.operators.sampling import train_test_split
from wattspark.plans.registry import orders, orders_enriched, register
from wattspark.plans.sql import ENRICH, NEIGHBOURS, ORDERS_READINGS, R, with_ctes
from wattspark.sources.adapters import requests_from_events

_CYC = """2 * pi() * hour("timestamp") / 24.0"""
_DCYC = """2 * pi() * (isodow("timestamp") - 1) / 7.0"""


@register("cyclical_features", with_ctes(ORDERS_READINGS, body=f"""
SELECT reading_id, {R(f'sin({_CYC})')} AS hour_sin, {R(f'cos({_CYC})')} AS hour_cos,
       {R(f'sin({_DCYC})')} AS dow_sin, {R(f'cos({_DCYC})')} AS dow_cos
FROM r"""))
def q_cyclical_features(spark, sf):
    r = orders(spark, sf).withColumns({"hour": F.hour("timestamp"), "dow": F.weekday("timestamp")})
    hs, hc = enc.cyclical("hour", 24)
    ds, dc = enc.cyclical("dow", 7)
    return r.select("reading_id", hs.alias("hour_sin"), hc.alias("hour_cos"), ds.alias("dow_sin"), dc.alias("dow_cos"))


_SEASON = """CASE WHEN month("timestamp") IN (6, 7, 8) THEN 'Winter' WHEN month("timestamp") IN (12, 1, 2) THEN 'Summer'
     WHEN month("timestamp") IN (3, 4, 5) THEN 'Autumn' ELSE 'Spring' END"""

_FEATURE_SQL = with_ctes(ORDERS_READINGS, NEIGHBOURS.format(src="r"), body=f"""
SELECT reading_id,
       CAST(hour("timestamp") AS INTEGER) AS hour,
       CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
       CAST(isodow("timestamp") >= 6 AS INTEGER) AS is_weekend,
       CAST(month("timestamp") AS INTEGER) AS month,
       {R(f'sin({_CYC})')} AS hour_sin, {R(f'cos({_CYC})')} AS hour_cos,
       {R(f'sin({_DCYC})')} AS dow_sin, {R(f'cos({_DCYC})')} AS dow_cos,
       CAST({_SEASON} = 'Autumn' AS INTEGER) AS season_Autumn,
       CAST({_SEASON} = 'Spring' AS INTEGER) AS season_Spring,
       CAST({_SEASON} = 'Summer' AS INTEGER) AS season_Summer,
       CAST({_SEASON} = 'Winter' AS INTEGER) AS season_Winter,
       CAST(load_shedding_stage > 0 AS INTEGER) AS is_load_shedding,
       CAST(load_shedding_stage = 0 AND prev_stage > 0 AS INTEGER) AS post_load_shedding,
       {R('load_shedding_stage / 6.0')} AS load_shedding_stage_normalized,
       CAST(backup_power AS INTEGER) AS has_backup_power,
       CAST(household_id = 'House_1' AS INTEGER) AS household_House_1,
       CAST(household_id = 'House_2' AS INTEGER) AS household_House_2,
       CAST(household_id = 'House_3' AS INTEGER) AS household_House_3,
       CAST(household_id = 'House_4' AS INTEGER) AS household_House_4,
       CAST(household_id = 'House_5' AS INTEGER) AS household_House_5,
       {R('energy_consumption')} AS energy_consumption
FROM n""")


@register("feature_matrix", _FEATURE_SQL)
def q_feature_matrix(spark, sf):
    return feature_matrix(orders(spark, sf))


@register("train_test_split", with_ctes(ORDERS_READINGS, body="""
SELECT reading_id, CASE WHEN reading_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM r"""))
def q_train_test_split(spark, sf):
    return train_test_split(orders(spark, sf)).select("reading_id", "split")


REQUEST_CTES = """k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
p AS (
  SELECT event_id AS request_id, k, k NOT BETWEEN 10 AND 21 AS plain,
         CAST(hour(ts) AS INTEGER) AS hour,
         CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type,
         CASE WHEN k % 10 = 3 THEN 'Summer' WHEN k = 99 THEN 'Monsoon' WHEN k % 4 = 0 THEN 'Winter'
              WHEN k % 4 = 1 THEN 'Summer' WHEN k % 4 = 2 THEN 'Spring' ELSE 'Autumn' END AS season,
         CAST(k % 8 AS INTEGER) AS load_shedding_stage,
         user_id % 2 = 1 AS has_backup_power,
         CASE WHEN k % 10 = 7 THEN 'House_1' ELSE 'House_' || CAST(user_id % 6 + 1 AS VARCHAR) END AS household_id
  FROM k),
q AS (
  SELECT request_id, k,
         CASE WHEN plain THEN hour WHEN k IN (10, 12) THEN 18 WHEN k IN (11, 17) THEN NULL ELSE 12 END AS hour,
         CASE WHEN plain THEN day_type ELSE 'weekday' END AS day_type,
         CASE WHEN plain THEN season WHEN k = 19 THEN NULL ELSE 'Summer' END AS season,
         CASE WHEN plain THEN load_shedding_stage WHEN k = 13 THEN 5 WHEN k = 14 THEN 1000000 ELSE 0 END AS load_shedding_stage,
         CASE WHEN plain THEN has_backup_power ELSE k IN (15, 16) END AS has_backup_power,
         CASE WHEN plain THEN household_id ELSE 'House_1' END AS household_id
  FROM p)"""

VALIDATION = """CASE WHEN k IN (20, 21) THEN 'Invalid JSON in request body'
            WHEN k IN (11, 17) THEN 'hour cannot be read'
            WHEN NOT hour BETWEEN 0 AND 23 THEN 'hour must be 0-23'
            WHEN day_type NOT IN ('weekday', 'weekend') THEN 'day_type must be ''weekday'' or ''weekend'''
            WHEN season IS NULL OR season NOT IN ('Winter', 'Summer', 'Spring', 'Autumn')
              THEN 'season must be Winter, Summer, Spring, or Autumn'
            WHEN NOT load_shedding_stage BETWEEN 0 AND 6 THEN 'load_shedding_stage must be 0-6'
            WHEN household_id NOT IN ('House_1', 'House_2', 'House_3', 'House_4', 'House_5')
              THEN 'household_id must be House_1 to House_5' END"""


def _requests(spark, sf):
    return validate_requests(parse_requests(requests_from_events(spark, sf)))


@register("parse_requests", with_ctes(REQUEST_CTES, body="""
SELECT request_id, hour, day_type, season, load_shedding_stage, has_backup_power, household_id FROM q"""))
def q_parse_requests(spark, sf):
    return parse_requests(requests_from_events(spark, sf)).select(
        "request_id", "hour", "day_type", "season", "load_shedding_stage", "has_backup_power", "household_id")


@register("validate_requests", with_ctes(REQUEST_CTES, body=f"""
SELECT request_id, {VALIDATION} AS error, ({VALIDATION}) IS NULL AS is_valid FROM q"""))
def q_validate_requests(spark, sf):
    return _requests(spark, sf).select("request_id", "error", "is_valid")


@register("request_features", with_ctes(REQUEST_CTES, body=f"""
SELECT request_id, hour,
       CASE WHEN day_type <> 'weekday' THEN 5 ELSE 0 END AS day_of_week,
       CAST(day_type <> 'weekday' AS INTEGER) AS is_weekend,
       CASE season WHEN 'Winter' THEN 7 WHEN 'Summer' THEN 1 WHEN 'Spring' THEN 10 WHEN 'Autumn' THEN 4 ELSE 1 END
         AS month,
       {R('sin(2 * pi() * hour / 24.0)')} AS hour_sin, {R('cos(2 * pi() * hour / 24.0)')} AS hour_cos,
       {R('sin(2 * pi() * (CASE WHEN day_type <> ' + "'weekday'" + ' THEN 5 ELSE 0 END) / 7.0)')} AS dow_sin,
       {R('cos(2 * pi() * (CASE WHEN day_type <> ' + "'weekday'" + ' THEN 5 ELSE 0 END) / 7.0)')} AS dow_cos,
       CAST(season = 'Autumn' AS INTEGER) AS season_Autumn, CAST(season = 'Spring' AS INTEGER) AS season_Spring,
       CAST(season = 'Summer' AS INTEGER) AS season_Summer, CAST(season = 'Winter' AS INTEGER) AS season_Winter,
       CAST(load_shedding_stage > 0 AS INTEGER) AS is_load_shedding, 0 AS post_load_shedding,
       {R('load_shedding_stage / 6.0')} AS load_shedding_stage_normalized,
       CAST(household_id = 'House_1' OR household_id NOT IN ('House_2', 'House_3', 'House_4', 'House_5')
            AS INTEGER) AS household_House_1,
       CAST(household_id = 'House_2' AS INTEGER) AS household_House_2,
       CAST(household_id = 'House_3' AS INTEGER) AS household_House_3,
       CAST(household_id = 'House_4' AS INTEGER) AS household_House_4,
       CAST(household_id = 'House_5' AS INTEGER) AS household_House_5
FROM q WHERE ({VALIDATION}) IS NULL"""))
def q_request_features(spark, sf):
    feats = request_features(_requests(spark, sf).where(F.col("is_valid")))
    cols = [c for c in C.FEATURES if c != "has_backup_power"]
    return feats.select("request_id", *cols)


@register("explanation_text", with_ctes(ORDERS_READINGS, ENRICH, body="""
SELECT reading_id, category || ' consumption expected due to: ' || coalesce(nullif(concat_ws(' + ',
         CASE WHEN hour >= 6 AND hour < 9 THEN 'morning peak time'
              WHEN hour >= 18 AND hour <= 21 THEN 'evening peak time'
              WHEN hour >= 0 AND hour < 5 THEN 'night (low consumption)' END,
         CASE WHEN season = 'Winter' THEN 'winter season (higher heating demand)'
              WHEN season = 'Summer' THEN 'summer season (lower heating, more cooling)' END,
         CASE WHEN load_shedding_stage > 0
              THEN 'electricity outage (Stage ' || CAST(load_shedding_stage AS VARCHAR) || ')' END,
         CASE WHEN backup_power AND load_shedding_stage > 0 THEN 'backup power available during outage' END,
         CASE WHEN is_weekend = 1 THEN 'weekend (different consumption pattern)' END), ''),
       'standard conditions') AS explanation
FROM (SELECT *, CASE WHEN energy_consumption < 0.7 * (CASE WHEN season = 'Winter' THEN 1.4 ELSE 1.0 END)
                                              * (CASE WHEN hour BETWEEN 18 AND 21 THEN 1.5 ELSE 1.0 END) THEN 'Low'
                     WHEN energy_consumption < 1.5 * (CASE WHEN season = 'Winter' THEN 1.4 ELSE 1.0 END)
                                              * (CASE WHEN hour BETWEEN 18 AND 21 THEN 1.5 ELSE 1.0 END) THEN 'Normal'
                     ELSE 'High' END AS category
      FROM e)"""))
def q_explanation_text(spark, sf):
    e = orders_enriched(spark, sf)
    day_type = F.when(F.col("is_weekend") == 1, F.lit("weekend")).otherwise(F.lit("weekday"))
    cat = lab.category_seasonal("energy_consumption", "season", "hour")
    return e.select("reading_id", lab.explanation(cat, "hour", day_type, "season", "load_shedding_stage",
                                                  "backup_power").alias("explanation"))
