"""Adapters that derive household readings from the driver's tables.

No household data ships with the test data, so readings are derived, by
column expressions only, from ``orders`` (all seasons and hours, 1995-2001)
and from ``events`` (January 2024, long-tailed values). Each adapter is a pure
projection: Catalyst prunes the scan to the source columns it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspark.sources.readings import READING_COLUMNS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_between(spark: SparkSession, sf_dir: str, start_date: str, end_date: str) -> DataFrame:
    """``orders_readings`` that can fall between two days (inclusive): the bounds that the timestamp (date plus less
    than a day) implies on ``o_orderdate`` are pushed into the scan; the slicer still compares the timestamp itself."""
    day = F.col("o_orderdate")
    near = (day > F.to_timestamp_ntz(F.lit(start_date)) - F.expr("INTERVAL 1 DAY")) & (
        day < F.to_timestamp_ntz(F.lit(end_date)) + F.expr("INTERVAL 1 DAY"))
    return _orders_readings(_table(spark, sf_dir, "orders").where(near))


def orders_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per order.

    household = customer mod 5, hour = order key mod 24, kWh = total price / 249989
    (0.004 .. 2.0, mean 1; the divisor is coprime to 10 so
    averages never end exactly on a rounding tie), urgent orders are outages of stage (key mod 6)+1,
    households 2 and 4 have backup power.
    """
    return _orders_readings(_table(spark, sf_dir, "orders"))


def orders_open_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders_readings`` over seven households, two of which (House_6, House_7) have no profile."""
    return _orders_readings(_table(spark, sf_dir, "orders"), households=7)


def orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders_readings`` with every customer as a household of its own (an open set of households)."""
    o = _table(spark, sf_dir, "orders")
    return _orders_readings(o, F.concat(F.lit("Customer_"), F.col("o_custkey").cast("string")))


def _orders_readings(o: DataFrame, household: Column | None = None, households: int = 5) -> DataFrame:
    household = F.concat(F.lit("House_"), (F.col("o_custkey") % households + 1).cast("string")) if household is None else household
    return o.select(
        F.col("o_orderkey").alias("reading_id"),
        household.alias("household_id"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int")))
        .alias("timestamp"),
        (F.col("o_totalprice") / F.lit(249989.0)).alias("energy_consumption"),
        F.when(F.col("o_orderpriority") == "1-URGENT", (F.col("o_orderkey") % 6 + 1).cast("int"))
        .otherwise(F.lit(0)).alias("load_shedding_stage"),
        (F.col("o_custkey") % 5).isin(1, 3).alias("backup_power"),
    )


def events_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per event: kWh = value / 25, error events are outages of stage (k mod 6)+1; five households."""
    household = F.concat(F.lit("House_"), (F.col("user_id") % 5 + 1).cast("string"))
    return _events_readings(spark, sf_dir, household)


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events_readings`` with every user as a household of its own (an open set of households)."""
    return _events_readings(spark, sf_dir, F.concat(F.lit("User_"), F.col("user_id").cast("string")))


def _events_readings(spark: SparkSession, sf_dir: str, household: Column) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("reading_id"),
        household.alias("household_id"),
        F.col("ts").alias("timestamp"),
        (F.col("value") / F.lit(25.0)).alias("energy_consumption"),
        F.when(F.col("event_type") == "error", (k % 6 + 1).cast("int")).otherwise(F.lit(0))
        .alias("load_shedding_stage"),
        (F.col("user_id") % 5).isin(1, 3).alias("backup_power"),
    )


def events_outage_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outage schedule derived from error events.

    Each error event starts an outage at the top of its hour, lasting
    (k mod 4)+2 hours (2..5) at stage (k mod 6)+1; ``seq`` is the event id, a
    later entry overwrites an earlier one where they overlap.
    """
    e = _table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("ts").alias("start"),
        (k % 4 + 2).cast("int").alias("hours"),
        (k % 6 + 1).cast("int").alias("stage"),
    )


def events_outage_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outage schedule with part hours: each error event starts an outage at its own time, of (k mod 4 + 2) x 37 minutes."""
    e = _table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return e.select(F.col("event_id").alias("seq"), F.col("ts").alias("start"),
                    (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), ((k % 4 + 2) * 37).cast("int"))).alias("end"),
                    (k % 6 + 1).cast("int").alias("stage"))


#: Bodies whose values have another type than asked, or none; events with k from 10 to 21 send them, by k.
ODD_BODIES = (
    '{"hour": "18"}', '{"hour": "abc"}', '{"hour": 18.9}', '{"load_shedding_stage": "5"}', '{"load_shedding_stage": 99999999999}',
    '{"has_backup_power": "true"}', '{"has_backup_power": 1}', '{"hour": null}', '{"has_backup_power": ""}', '{"season": 3}',
    '[1, 2]', '{"hour": 7',
)


def requests_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests as JSON text, one per event (some deliberately invalid).

    hour = hour of ts (0..23); day_type from the event weekday; season cycles
    through the four seasons and, for k = 99, an invalid one; stage = k mod 8
    (7 is invalid); backup when user_id is odd; household = user mod 6 + 1
    (House_6 is invalid). Keys are omitted for some rows to exercise defaults,
    and events with k from 10 to 21 send the odd bodies above.
    """
    e = _table(spark, sf_dir, "events")
    # a generator: k is read once for each event
    e = e.select("event_id", "ts", "user_id", F.explode(F.array(F.get_json_object(F.col("props"), "$.k").cast("int"))).alias("k"))
    k = F.col("k")
    season = (F.when(k == 99, F.lit("Monsoon"))
              .when(k % 4 == 0, F.lit("Winter")).when(k % 4 == 1, F.lit("Summer"))
              .when(k % 4 == 2, F.lit("Spring")).otherwise(F.lit("Autumn")))
    fields = F.struct(
        F.hour("ts").alias("hour"),
        F.when(F.weekday("ts") >= 5, F.lit("weekend")).otherwise(F.lit("Weekday")).alias("day_type"),
        F.when(k % 10 == 3, F.lit(None)).otherwise(season).alias("season"),
        (k % 8).alias("load_shedding_stage"),
        (F.col("user_id") % 2 == 1).alias("has_backup_power"),
        F.when(k % 10 == 7, F.lit(None))
        .otherwise(F.concat(F.lit("House_"), (F.col("user_id") % 6 + 1).cast("string"))).alias("household_id"),
    )
    odd = F.get(F.array(*[F.lit(b) for b in ODD_BODIES]), k - 10)
    # to_json drops null fields, so the request omits those keys and defaults apply.
    return e.select(F.col("event_id").alias("request_id"), F.coalesce(F.when(k >= 10, odd), F.to_json(fields)).alias("body"))


def orders_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a readings CSV file (without header), one per order; some of every 97 hold a field that does not fit, by order key."""
    r = orders_readings(spark, sf_dir)
    odd = F.pmod(F.col("reading_id"), F.lit(97))
    fields = [
        F.col("household_id"),
        F.when(odd == 1, F.lit("yesterday")).otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")),
        F.when(odd == 2, F.lit("n/a")).when(odd == 7, F.lit("")).when(odd == 8, F.lit("NaN")).otherwise(F.col("energy_consumption").cast("string")),
        F.when(odd == 3, F.lit("9")).otherwise(F.col("load_shedding_stage").cast("string")),
        F.when(odd == 6, F.lit("maybe")).when(odd == 4, F.lit(None)).when(odd == 5, F.lit("true,false"))
        .otherwise(F.col("backup_power").cast("string")),  # a null is left out, with its comma
    ]
    return r.select(F.concat_ws(",", *fields).alias("value"))


__all__ = ["orders_readings", "events_readings", "events_outage_schedule", "requests_from_events",
           "READING_COLUMNS"]
