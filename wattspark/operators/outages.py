"""Outage flags, transitions, rebound and schedule overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.operators.neighbours import neighbour_values

STAGE = "load_shedding_stage"
KWH = "energy_consumption"


def with_neighbour_stages(df: DataFrame, key: str = "household_id") -> DataFrame:
    """``prev_stage`` / ``next_stage`` per household in time order, 0 at the edges."""
    return neighbour_values(df, STAGE, key=key, prev_name="prev_stage", next_name="next_stage", default=0)


def with_outage_flags(df: DataFrame, key: str = "household_id") -> DataFrame:
    """Per reading: is_outage, before_outage (clear hour right before an outage starts),
    after_outage (clear hour right after one ends) and post_load_shedding (W1, W2)."""
    df = with_neighbour_stages(df, key)
    clear = F.col(STAGE) == 0
    return df.withColumns({
        "is_outage": (F.col(STAGE) > 0).cast("int"),
        "before_outage": (clear & (F.col("next_stage") > 0)).cast("int"),
        "after_outage": (clear & (F.col("prev_stage") > 0)).cast("int"),
        "post_load_shedding": (clear & (F.col("prev_stage") > 0)).cast("int"),
    })


def outage_transition(df: DataFrame, key: str = "household_id") -> DataFrame:
    """Mean kWh of normal / pre / during / post-outage hours and the waterfall steps.

    normal = clear with clear neighbours; pre = clear before an outage; during =
    outage; post = clear after an outage. A clear hour between two outages is
    both pre and post. One global aggregate: partial sums per task, one tiny merge.
    """
    f = with_neighbour_stages(df, key)
    clear = F.col(STAGE) == 0
    out = f.agg(
        F.avg(F.when(clear & (F.col("prev_stage") == 0) & (F.col("next_stage") == 0), F.col(KWH))).alias("normal_kwh"),
        F.avg(F.when(clear & (F.col("next_stage") > 0), F.col(KWH))).alias("pre_outage_kwh"),
        F.avg(F.when(F.col(STAGE) > 0, F.col(KWH))).alias("during_outage_kwh"),
        F.avg(F.when(clear & (F.col("prev_stage") > 0), F.col(KWH))).alias("post_outage_kwh"),
    )
    return out.withColumns({
        "pre_step": F.col("pre_outage_kwh") - F.col("normal_kwh"),
        "during_step": F.col("during_outage_kwh") - F.col("pre_outage_kwh"),
        "post_step": F.col("post_outage_kwh") - F.col("during_outage_kwh"),
    })


def rebound_effect(df: DataFrame, key: str = "household_id") -> DataFrame:
    """Before / during / after means and rebound % = (after - before) / before * 100.

    The rebound is null when no hour follows an outage (or the before-mean is 0).
    """
    f = with_outage_flags(df, key)
    out = f.agg(
        F.avg(F.when(F.col("before_outage") == 1, F.col(KWH))).alias("before_kwh"),
        F.avg(F.when(F.col("is_outage") == 1, F.col(KWH))).alias("during_kwh"),
        F.avg(F.when(F.col("after_outage") == 1, F.col(KWH))).alias("after_kwh"),
        F.count_if(F.col("after_outage") == 1).alias("after_hours"),
    )
    rebound = F.try_divide(F.col("after_kwh") - F.col("before_kwh"), F.col("before_kwh")) * 100.0
    return out.withColumn("rebound_pct", F.when(F.col("after_hours") > 0, rebound))


def expand_schedule(schedule: DataFrame) -> DataFrame:
    """Outage schedule (seq, start, hours, stage) -> one row per covered hour, later seq wins.

    Each entry covers ``hours`` whole hours from the hour of ``start``. The hour
    key is (date, hour of day), so the join stays an equi-join. The result has
    at most one row per clock hour of the schedule's time span (bounded size).
    """
    s = F.col("start")
    start_hour = F.make_timestamp_ntz(F.year(s), F.month(s), F.dayofmonth(s), F.hour(s), F.lit(0), F.lit(0))
    offsets = F.sequence(F.lit(0), F.col("hours") - 1)
    hours = schedule.select("seq", "stage", start_hour.alias("_h0"), F.explode(offsets).alias("_k"))
    hours = hours.select("seq", "stage",
                         (F.col("_h0") + F.make_dt_interval(F.lit(0), F.col("_k"))).alias("_h"))
    return (hours.groupBy(F.to_date("_h").alias("_date"), F.hour("_h").alias("_hour"))
            .agg(F.max_by("stage", "seq").alias("_stage")))


def overlay_schedule(readings: DataFrame, schedule: DataFrame) -> DataFrame:
    """Replace ``load_shedding_stage`` with the stage the schedule gives each reading's hour (0 if none).

    Equi-join on (date, hour): AQE broadcasts the expanded schedule when its
    materialised size is under the broadcast threshold and falls back to a
    sort-merge join otherwise; no nested-loop range join.
    """
    hours = expand_schedule(schedule)
    r = readings.withColumns({"_date": F.to_date("timestamp"), "_hour": F.hour("timestamp")})
    joined = r.drop(STAGE).join(hours, ["_date", "_hour"], "left")
    return joined.withColumn(STAGE, F.coalesce(F.col("_stage"), F.lit(0))).drop("_date", "_hour", "_stage")
