"""Previous / next reading of the same household, without one task per household or household-day.

A window ``partitionBy(household).orderBy(time)`` sends every reading of a
household to one task: a household (or meter gateway) holding a third of all
rows would make a single task sort a third of the data. Instead the window is
split into time buckets, so a hot household spreads over as many tasks as it
has buckets:

1. buckets are calendar days. The household-days with more than ``HOT_ROWS``
   rows, of many the ``HOT_DAYS`` largest (every other has a smaller share of all
   rows than 1/``HOT_DAYS``; their table is broadcast), are cut further, into hours
   and equal parts of an hour by their counted rows per hour;
2. ``lag``/``lead`` inside ``(household, bucket)`` windows: one shuffle of the
   readings, hashed on household and bucket;
3. only the first and last row of each bucket lack a neighbour there; those
   boundary rows (at most two per bucket, so their number is bounded by the
   time span, not by the row count) are windowed again per household, which
   links the last row of one bucket to the first row of the next non-empty one;
4. interior rows and fixed boundary rows are put back together with a union
   (no join, no second shuffle of the readings: both branches reuse the same
   exchange; every key is a function of the data, so they agree even where
   Spark evaluates them twice).

The result equals the plain per-household ``lag``/``lead`` over readings that
have a household and a timestamp. A reading without either has no neighbours
and is nobody's neighbour; such rows are dealt out by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS, HOT_DAYS = 20_000, 2_000
NOWHERE = 1_024


def _hot_days(df: DataFrame, key: str, ts: str, hot_rows: int) -> DataFrame:
    """(_hk, _hd, _hp): hot household-days and, for each hour, into how many parts it is cut. At most HOT_DAYS rows.

    One count a household-day; only the hot days (as a rule none) are read again for their hours.
    """
    placed = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_hk"), F.to_date(ts).alias("_hd"), F.col(ts).alias("_ht"))
    days = placed.groupBy("_hk", "_hd").agg(F.count(F.lit(1)).alias("_hn"))
    # the HOT_DAYS largest: every other day has less than one in HOT_DAYS of all rows
    hot = days.where(F.col("_hn") > hot_rows).orderBy(F.desc("_hn"), "_hk", "_hd").limit(HOT_DAYS).select("_hk", "_hd")
    hours = placed.join(F.broadcast(hot), ["_hk", "_hd"]).groupBy("_hk", "_hd").agg(
        *[F.count_if(F.hour("_ht") == h).alias(f"_h{h}") for h in range(24)])
    parts = F.array(*[F.greatest(F.lit(1), F.ceil(F.col(f"_h{h}") / (hot_rows / 16))).cast("int") for h in range(24)])
    return hours.select("_hk", "_hd", parts.alias("_hp"))


def _day_part(df: DataFrame, key: str, ts: str, tie: str, hot_rows: int) -> DataFrame:
    """Add _nb_day and _nb_part, the bucket of every row."""
    hot = F.broadcast(_hot_days(df, key, ts, hot_rows))
    rows = df.withColumn("_nb_day", F.to_date(F.col(ts)))
    rows = rows.join(hot, (F.col(key) == F.col("_hk")) & (F.col("_nb_day") == F.col("_hd")), "left")
    second = F.minute(ts) * 60 + F.second(ts)
    part = F.hour(ts) * 1_000_000 + F.floor(second * F.get("_hp", F.hour(ts)) / 3600).cast("int")
    part = F.when(F.col(key).isNull() | F.col(ts).isNull(), F.pmod(F.xxhash64(tie), F.lit(NOWHERE)).cast("int")) \
        .when(F.col("_hp").isNull(), F.lit(0)).otherwise(part)
    return rows.withColumn("_nb_part", part).drop("_hk", "_hd", "_hp")


def neighbour_values(df: DataFrame, value: str, key: str = "household_id", ts: str = "timestamp",
                     tie: str = "reading_id", default=0,
                     prev_name: str | None = None, next_name: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``prev_<value>`` and ``next_<value>``: the value on the previous / next row of the
    same ``key`` in ``(ts, tie)`` order, ``default`` where there is none."""
    prev_name = prev_name or f"prev_{value}"
    next_name = next_name or f"next_{value}"

    # lag of a one-field struct is null only when there is no neighbour row,
    # so a null value stays distinguishable from a missing neighbour
    cell = F.struct(F.col(value).alias("v"))
    in_bucket = Window.partitionBy(key, "_nb_day", "_nb_part").orderBy(ts, tie)
    placed = F.col(key).isNotNull() & F.col(ts).isNotNull()
    rows = _day_part(df, key, ts, tie, hot_rows).withColumns({
        "_nb_prev": F.when(placed, F.lag(cell).over(in_bucket)), "_nb_next": F.when(placed, F.lead(cell).over(in_bucket))})

    boundary = placed & (F.col("_nb_prev").isNull() | F.col("_nb_next").isNull())
    across = Window.partitionBy(key).orderBy(ts, tie)
    edges = rows.where(boundary).withColumns({
        "_nb_prev": F.coalesce(F.col("_nb_prev"), F.lag(cell).over(across)),
        "_nb_next": F.coalesce(F.col("_nb_next"), F.lead(cell).over(across)),
    })
    whole = rows.where(~boundary).unionByName(edges)

    out = whole.withColumns({
        prev_name: F.when(F.col("_nb_prev").isNull(), F.lit(default)).otherwise(F.col("_nb_prev.v")),
        next_name: F.when(F.col("_nb_next").isNull(), F.lit(default)).otherwise(F.col("_nb_next.v")),
    })
    return out.drop("_nb_day", "_nb_part", "_nb_prev", "_nb_next")
