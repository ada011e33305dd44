"""Scoring: readings, the scenario grid and request tables (M7-M9)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspark import constants as C
from wattspark.functions import calendar as cal
from wattspark.functions import encoding as enc
from wattspark.functions import labels as lab
from wattspark.models.training import top_driver_values
from wattspark.operators.errors import with_errors
from wattspark.operators.features import with_features
from wattspark.operators.requests import parse_requests, request_features, validate_requests


def score_readings(model: PipelineModel, readings: DataFrame) -> DataFrame:
    """Predicted kWh and errors for every reading (M7, P16): a map-only ``transform``.

    Readings that already carry the features (a stored feature table) are scored as they are.
    """
    rows = readings if set(C.FEATURES) <= set(readings.columns) else with_features(readings)
    scored = model.transform(rows).drop("features")
    return with_errors(scored)


def scenario_grid(spark: SparkSession, seasons=("Winter", "Summer", "Spring", "Autumn")) -> DataFrame:
    """Every (hour, season, stage, backup) scenario at Wednesday for the first household (M8).

    24 x 4 x 7 x 2 = 1,344 rows, generated from one ``range`` by mixed-radix
    decoding (no cross join).
    """
    n_h, n_s, n_st, n_b = 24, len(seasons), C.MAX_STAGE + 1, 2
    i = F.col("id")
    season_arr = F.array(*[F.lit(s) for s in seasons])
    g = spark.range(n_h * n_s * n_st * n_b).select(
        (i % n_h).cast("int").alias("hour"),
        F.element_at(season_arr, ((i / n_h).cast("long") % n_s + 1).cast("int")).alias("season"),
        ((i / (n_h * n_s)).cast("long") % n_st).cast("int").alias("load_shedding_stage"),
        ((i / (n_h * n_s * n_st)).cast("long") % n_b == 1).alias("has_backup_power"))
    dow = F.lit(C.SCENARIO_DAY_OF_WEEK)
    hs, hc = enc.cyclical("hour", 24)
    ds, dc = enc.cyclical(dow, 7)
    stage = F.col("load_shedding_stage")
    g = g.withColumns({
        "day_of_week": dow, "is_weekend": F.lit(0), "month": cal.month_of_season("season"),
        "hour_sin": hs, "hour_cos": hc, "dow_sin": ds, "dow_cos": dc,
        "is_load_shedding": (stage > 0).cast("int"), "post_load_shedding": F.lit(0),
        "load_shedding_stage_normalized": stage / F.lit(float(C.MAX_STAGE)),
        "household_id": F.lit(C.SCENARIO_HOUSEHOLD),
    })
    return g.select("*", *enc.one_hot("season", C.SEASONS, "season"),
                    *enc.one_hot("household_id", C.HOUSEHOLDS, "household"))


def scenario_actuals(readings: DataFrame, grid: DataFrame) -> DataFrame:
    """The grid's scenarios with the readings that fall in each: n_readings and actual_kwh (null where none does).

    The readings are rolled up to their scenarios first (at most 1,344 groups, combined map-side).
    """
    keys = ["hour", "season", "load_shedding_stage", "has_backup_power"]
    seen = readings.groupBy(cal.hour("timestamp").alias("hour"), cal.season(cal.month("timestamp")).alias("season"),
                            "load_shedding_stage", F.col("backup_power").alias("has_backup_power")).agg(
        F.count("energy_consumption").alias("n_readings"), F.avg("energy_consumption").alias("actual_kwh"))
    return grid.join(seen, keys, "left").withColumn("n_readings", F.coalesce("n_readings", F.lit(0).cast("long")))


def score_scenarios(model: PipelineModel, grid: DataFrame) -> DataFrame:
    """Predicted kWh and the simulator category of each scenario, beside whatever actuals the grid carries."""
    out = model.transform(grid)
    actuals = [c for c in ("n_readings", "actual_kwh") if c in grid.columns]
    return out.select("hour", "season", "load_shedding_stage", "has_backup_power",
                      F.col("predicted").alias("expected_kwh"), lab.category_fixed("predicted").alias("category"), *actuals)


def score_requests(boosted: PipelineModel, forest: PipelineModel, requests: DataFrame) -> DataFrame:
    """Batch version of the prediction endpoint (M9).

    Valid requests get ``status = success`` and a nested ``prediction``
    (kWh clipped at 0 and rounded to 2, category, explanation), the echoed
    ``input_context`` and the ``top_drivers`` of the forest model; invalid
    ones get ``status = error`` and the validation message. The drivers are
    the forest's three largest importances (model metadata), attached as a
    literal array.
    """
    checked = validate_requests(parse_requests(requests))
    # rejected requests go through the model too, with unknown features: each body is decoded once
    scored = boosted.transform(request_features(checked)).withColumn("kwh", lab.clip_at_zero("predicted"))
    category = lab.category_seasonal("kwh", "season", "hour")
    # three (feature, importance) pairs of model metadata: a literal, not a subquery per run
    drivers = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(v).alias("importance"))
                        for f, v in top_driver_values(forest)])
    prediction = F.struct(F.bround("kwh", 2).alias("expected_consumption_kwh"), category.alias("consumption_category"),
                          lab.explanation(category, "hour", "day_type", "season", "load_shedding_stage",
                                          "has_backup_power").alias("explanation"))
    context = F.struct("hour", "day_type", "season", "load_shedding_stage", "has_backup_power", "household_id")
    good = F.col("is_valid")
    return scored.select("request_id", F.when(good, F.lit("success")).otherwise(F.lit("error")).alias("status"),
                         *[F.when(good, c).alias(n) for n, c in (("prediction", prediction), ("input_context", context), ("top_drivers", drivers))],
                         "error")
