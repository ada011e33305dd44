"""Model features (P7-P12, W1): 21 numeric columns in a fixed order, then one vector."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspark import constants as C
from wattspark.functions import calendar as cal
from wattspark.functions import encoding as enc
from wattspark.operators.outages import with_neighbour_stages


def with_features(readings: DataFrame) -> DataFrame:
    """Add the 21 model features to readings.

    One-hot columns use the fixed vocabularies (every season / household
    column exists even when absent from the data). ``post_load_shedding``
    needs the previous reading of the household (skew-safe neighbour lookup).
    """
    df = with_neighbour_stages(readings)
    hour, dow = cal.hour("timestamp"), cal.day_of_week("timestamp")
    df = df.withColumns({"hour": hour, "day_of_week": dow, "month": cal.month("timestamp")})
    hs, hc = enc.cyclical("hour", 24)
    ds, dc = enc.cyclical("day_of_week", 7)
    stage = F.col("load_shedding_stage")
    df = df.withColumns({
        "is_weekend": (F.col("day_of_week") >= 5).cast("int"),
        "hour_sin": hs, "hour_cos": hc, "dow_sin": ds, "dow_cos": dc,
        "season": cal.season("month"),
        "is_load_shedding": (stage > 0).cast("int"),
        "post_load_shedding": ((stage == 0) & (F.col("prev_stage") > 0)).cast("int"),
        "load_shedding_stage_normalized": stage / F.lit(float(C.MAX_STAGE)),
        "has_backup_power": F.col("backup_power").cast("int"),
    })
    df = df.select("*", *enc.one_hot("season", C.SEASONS, "season"),
                   *enc.one_hot("household_id", C.HOUSEHOLDS, "household"))
    return df.drop("prev_stage", "next_stage")


def feature_matrix(readings: DataFrame, keep=("reading_id",)) -> DataFrame:
    """``keep`` columns + the 21 features in model order + the label."""
    return with_features(readings).select(*keep, *C.FEATURES, C.LABEL)


def assembler(output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(C.FEATURES), outputCol=output, handleInvalid="keep")


def open_household_stages(output: str = "features") -> list:
    """Pipeline stages for an open set of households (P9): index and one-hot whatever the training rows hold.

    The vocabulary is fitted with the model and saved in it, so training and
    scoring agree; a household that training never saw is all zeros in both.
    """
    fixed = [f for f in C.FEATURES if not f.startswith("household_")]
    index = StringIndexer(inputCol="household_id", outputCol="household_index", handleInvalid="keep", stringOrderType="alphabetAsc")
    # the last index stands for the unseen: dropping it leaves them all zeros
    one_hot = OneHotEncoder(inputCol="household_index", outputCol="household_onehot", dropLast=True)
    return [index, one_hot, VectorAssembler(inputCols=[*fixed, "household_onehot"], outputCol=output, handleInvalid="keep")]


def feature_descriptions(spark: SparkSession) -> DataFrame:
    """Feature name -> human-readable description (21 rows, fixed: safe to broadcast)."""
    return spark.createDataFrame(list(C.FEATURE_DESCRIPTIONS), "feature string, description string")
