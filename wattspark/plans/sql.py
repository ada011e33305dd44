"""SQL building blocks for the DuckDB oracles.

The oracles restate each operator in plain SQL over the driver's tables. The
adapters and the calendar enrichment are written once here and inlined as
CTEs. Doubles are rounded to 6 decimals on both sides (``R``).
"""

from __future__ import annotations


def R(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"


ORDERS_READINGS = """r AS (
  SELECT o_orderkey AS reading_id,
         'House_' || CAST(o_custkey % 5 + 1 AS VARCHAR) AS household_id,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS "timestamp",
         o_totalprice / 249989.0::DOUBLE AS energy_consumption,
         CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderkey % 6 + 1 AS INTEGER) ELSE 0 END
           AS load_shedding_stage,
         o_custkey % 5 IN (1, 3) AS backup_power
  FROM orders)"""

# Seven households, two of them without a profile.
ORDERS_OPEN = ORDERS_READINGS.replace("o_custkey % 5 + 1", "o_custkey % 7 + 1")

# Every customer is a household.
ORDERS_BY_CUSTOMER = ORDERS_READINGS.replace("'House_' || CAST(o_custkey % 5 + 1 AS VARCHAR)", "'Customer_' || CAST(o_custkey AS VARCHAR)")

EVENTS_READINGS = """r AS (
  SELECT event_id AS reading_id,
         'House_' || CAST(user_id % 5 + 1 AS VARCHAR) AS household_id,
         ts AS "timestamp",
         value / 25.0::DOUBLE AS energy_consumption,
         CASE WHEN event_type = 'error'
              THEN CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 + 1 AS INTEGER) ELSE 0 END
           AS load_shedding_stage,
         user_id % 5 IN (1, 3) AS backup_power
  FROM events)"""

# Every user is a household.
EVENTS_BY_USER = EVENTS_READINGS.replace("'House_' || CAST(user_id % 5 + 1 AS VARCHAR)", "'User_' || CAST(user_id AS VARCHAR)")

SEASON = """CASE WHEN month({t}) IN (6, 7, 8) THEN 'Winter'
     WHEN month({t}) IN (12, 1, 2) THEN 'Summer'
     WHEN month({t}) IN (3, 4, 5) THEN 'Autumn' ELSE 'Spring' END"""

TIME_PERIOD = """CASE WHEN hour({t}) >= 6 AND hour({t}) < 9 THEN 'Morning Peak'
     WHEN hour({t}) >= 9 AND hour({t}) < 17 THEN 'Daytime'
     WHEN hour({t}) >= 17 AND hour({t}) < 21 THEN 'Evening Peak' ELSE 'Off-Peak' END"""

SEVERITY = """CASE WHEN {s} > -1 AND {s} <= 0 THEN 'No Outage'
     WHEN {s} > 0 AND {s} <= 2 THEN 'Low (1-2)'
     WHEN {s} > 2 AND {s} <= 4 THEN 'Medium (3-4)'
     WHEN {s} > 4 AND {s} <= 6 THEN 'High (5-6)' END"""

ENRICH = f"""e0 AS (
  SELECT *,
         CAST(hour("timestamp") AS INTEGER) AS hour,
         CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
         CAST("timestamp" AS DATE) AS date,
         dayname("timestamp") AS day_name,
         CAST(month("timestamp") AS INTEGER) AS month,
         monthname("timestamp") AS month_name,
         CAST(weekofyear("timestamp") AS INTEGER) AS week,
         CAST(isodow("timestamp") >= 6 AS INTEGER) AS is_weekend,
         {SEASON.format(t='"timestamp"')} AS season,
         {TIME_PERIOD.format(t='"timestamp"')} AS time_period,
         {SEVERITY.format(s='load_shedding_stage')} AS outage_severity
  FROM r),
e AS (
  SELECT *, CASE WHEN time_period IN ('Morning Peak', 'Evening Peak')
                 THEN energy_consumption * 2.85::DOUBLE
                 ELSE energy_consumption * 1.45::DOUBLE END AS estimated_cost
  FROM e0)"""

NEIGHBOURS = """n AS (
  SELECT *,
         coalesce(lag(load_shedding_stage) OVER w, 0) AS prev_stage,
         coalesce(lead(load_shedding_stage) OVER w, 0) AS next_stage
  FROM {src}
  WINDOW w AS (PARTITION BY household_id ORDER BY "timestamp", reading_id))"""

# Expected-load baseline over neighbour rows ``n`` (needs hour, month of "timestamp").
EXPECTED = """x AS (
  SELECT n.*,
         p.base_load
         * CASE WHEN month(n."timestamp") IN (6, 7, 8) THEN 1.4::DOUBLE
                WHEN month(n."timestamp") IN (12, 1, 2) THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END
         * CASE WHEN hour(n."timestamp") >= 6 AND hour(n."timestamp") < 9 THEN 1.3::DOUBLE
                WHEN hour(n."timestamp") >= 9 AND hour(n."timestamp") < 17 THEN 0.8::DOUBLE
                WHEN hour(n."timestamp") >= 18 AND hour(n."timestamp") < 22 THEN 1.8::DOUBLE ELSE 0.5::DOUBLE END
         * CASE WHEN n.load_shedding_stage > 0 THEN
                     CASE WHEN n.backup_power
                          THEN 0.2::DOUBLE + 0.3::DOUBLE * (1.0::DOUBLE - n.load_shedding_stage / 6.0::DOUBLE)
                          ELSE 0.05::DOUBLE END
                WHEN n.prev_stage > 0 THEN 1.0::DOUBLE + p.resilience * 0.5::DOUBLE
                ELSE 1.0::DOUBLE END AS predicted
  FROM n LEFT JOIN (VALUES ('House_1', 0.8::DOUBLE, 0.3::DOUBLE), ('House_2', 1.2::DOUBLE, 0.7::DOUBLE),
                           ('House_3', 1.0::DOUBLE, 0.4::DOUBLE), ('House_4', 1.5::DOUBLE, 0.8::DOUBLE),
                           ('House_5', 0.9::DOUBLE, 0.2::DOUBLE)) AS p(household_id, base_load, resilience)
    ON n.household_id = p.household_id)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
