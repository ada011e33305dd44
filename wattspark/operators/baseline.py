"""Expected-load baseline (X1): the deterministic part of the household load model.

expected = base_load x season factor x time-of-day factor x outage factor, where
the outage factor is 0.2 + 0.3 (1 - stage/6) with backup power, 0.05 without,
and a clear hour right after an outage is scaled by 1 + 0.5 x resilience.
Households join a fixed five-row profile table (broadcast: its size is fixed).
Unknown households get no profile and therefore a null expectation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspark import constants as C
from wattspark.functions import calendar as cal
from wattspark.operators.outages import with_neighbour_stages

PROFILE_SCHEMA = T.StructType([
    T.StructField("household_id", T.StringType(), False),
    T.StructField("base_load", T.DoubleType(), False),
    T.StructField("peak_sensitivity", T.DoubleType(), False),
    T.StructField("profile_backup", T.BooleanType(), False),
    T.StructField("resilience", T.DoubleType(), False),
])


def household_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.HOUSEHOLD_PROFILES), PROFILE_SCHEMA)


def season_factor(month_col) -> F.Column:
    s = cal.season(month_col)
    return (F.when(s == "Winter", F.lit(C.SIM_SEASON_FACTOR["Winter"]))
            .when(s == "Summer", F.lit(C.SIM_SEASON_FACTOR["Summer"]))
            .otherwise(F.lit(C.SIM_SEASON_FACTOR["other"])))


def time_factor(hour_col) -> F.Column:
    h = F.col(hour_col) if isinstance(hour_col, str) else hour_col
    expr = None
    for (lo, hi), factor in C.SIM_TIME_FACTORS:
        cond = (h >= lo) & (h < hi)
        expr = F.when(cond, F.lit(factor)) if expr is None else expr.when(cond, F.lit(factor))
    return expr.otherwise(F.lit(C.SIM_TIME_FACTOR_OTHER))


def with_expected_load(df: DataFrame, name: str = "predicted") -> DataFrame:
    """Add the expected kWh of each reading as column ``name``."""
    spark = df.sparkSession
    stage = F.col("load_shedding_stage")
    f = with_neighbour_stages(df)
    f = f.join(F.broadcast(household_profiles(spark)), "household_id", "left")
    outage = F.when(F.col("backup_power"),
                    F.lit(C.SIM_BACKUP_FLOOR) + F.lit(C.SIM_BACKUP_SPAN) * (F.lit(1.0) - stage / F.lit(float(C.MAX_STAGE))))\
        .otherwise(F.lit(C.SIM_NO_BACKUP_FACTOR))
    rebound = F.lit(1.0) + F.col("resilience") * F.lit(C.SIM_REBOUND_WEIGHT)
    situational = (F.when(stage > 0, outage)
                   .when(F.col("prev_stage") > 0, rebound)
                   .otherwise(F.lit(1.0)))
    expected = (F.col("base_load") * season_factor(F.month("timestamp"))
                * time_factor(F.hour("timestamp")) * situational)
    return f.withColumn(name, expected).drop("base_load", "peak_sensitivity", "profile_backup", "resilience",
                                             "prev_stage", "next_stage")
