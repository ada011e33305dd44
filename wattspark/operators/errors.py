"""Prediction error analytics over a ``predicted`` column.

None of these depends on which model produced the prediction; with the
deterministic expected-load baseline they have exact SQL oracles. Every
aggregate looks at scored readings only, those with an actual and a predicted
value; ``error_metrics`` says how many readings were left out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark import constants as C
from wattspark.functions import labels as lab
from wattspark.operators.rollups import grouped

def actual():
    return F.col("energy_consumption")


def pred():
    return F.col("predicted")


def is_scored():
    return actual().isNotNull() & pred().isNotNull()


def scored(df: DataFrame) -> DataFrame:
    """The readings that errors can be computed for."""
    return df.where(is_scored())


def with_errors(df: DataFrame) -> DataFrame:
    """residual, abs_error and pct_error (actual floored at 0.01)."""
    return df.withColumns({
        "residual": lab.residual("energy_consumption", "predicted"),
        "abs_error": lab.abs_error("energy_consumption", "predicted"),
        "pct_error": lab.pct_error("energy_consumption", "predicted"),
    })


def error_metrics(df: DataFrame) -> DataFrame:
    """RMSE, MAE, R^2 and MAPE of the ``n`` scored readings in one aggregate, and ``n_unscored``.

    R^2 = 1 - SS_res / SS_tot with SS_tot = n * var_pop(actual), both from the
    same pass (no second scan for the mean).
    """
    res = actual() - pred()
    n = F.count(res)
    out = df.agg(n.alias("n"), (F.count(F.lit(1)) - n).alias("n_unscored"),
                 F.sqrt(F.avg(res * res)).alias("rmse"),
                 F.avg(F.abs(res)).alias("mae"),
                 F.sum(res * res).alias("_ss_res"),
                 (F.var_pop(F.when(is_scored(), actual())) * n).alias("_ss_tot"),
                 F.avg(lab.pct_error("energy_consumption", "predicted")).alias("mape"))
    return out.withColumn("r2", F.lit(1.0) - F.try_divide(F.col("_ss_res"), F.col("_ss_tot"))) \
        .drop("_ss_res", "_ss_tot")


def prediction_bands(df: DataFrame) -> DataFrame:
    """Per day: actual and predicted sums, residual mean / sample std and a 95% band.

    band = predicted +- 1.96 * residual_std * sqrt(24).
    """
    res = actual() - pred()
    d = grouped(scored(df), (F.to_date("timestamp"), "date")).agg(
        F.sum(actual()).alias("actual"), F.sum(pred()).alias("predicted"),
        F.avg(res).alias("residual_mean"), F.stddev_samp(res).alias("residual_std"))
    width = F.lit(C.BAND_Z * math.sqrt(C.BAND_HOURS)) * F.col("residual_std")
    return d.withColumns({"upper": F.col("predicted") + width, "lower": F.col("predicted") - width})


def band_polygon(bands: DataFrame) -> DataFrame:
    """The closed band outline: upper edge forward, lower edge backward.

    ``ordinal`` orders the vertices: upper by ascending date, then lower by
    descending date (negative day numbers after the upper ones).
    """
    day = F.datediff("date", F.lit("1970-01-01"))
    upper = bands.select("date", F.col("upper").alias("value"), F.lit("upper").alias("edge"),
                         day.cast("long").alias("ordinal"))
    lower = bands.select("date", F.col("lower").alias("value"), F.lit("lower").alias("edge"),
                         (F.lit(10 ** 9) - day).cast("long").alias("ordinal"))
    return upper.unionByName(lower)


def _scenario_conditions():
    return (
        ("Normal Hours", F.col("load_shedding_stage") == 0),
        ("During Outage", F.col("load_shedding_stage") > 0),
        ("Winter Peak", (F.col("season") == "Winter") & F.col("hour").between(*C.WINTER_PEAK_HOURS)),
        ("Summer Midday", (F.col("season") == "Summer") & F.col("hour").between(*C.SUMMER_MIDDAY_HOURS)),
        ("Weekend", F.col("is_weekend") == 1),
        ("With Backup", F.col("backup_power")),
    )


def scenario_errors(e: DataFrame) -> DataFrame:
    """RMSE / MAE / n for six overlapping scenarios; empty scenarios are dropped.

    One global aggregate with conditional averages; its single row is then
    unpivoted, so readings are never multiplied.
    """
    res = actual() - pred()
    conditions = _scenario_conditions()
    aggs = []
    for i, (_, cond) in enumerate(conditions):
        aggs += [F.avg(F.when(cond, res * res)).alias(f"_q{i}"), F.avg(F.when(cond, F.abs(res))).alias(f"_a{i}"),
                 F.count(F.when(cond, res)).alias(f"_n{i}")]
    cells = [F.struct(F.lit(name).alias("scenario"), F.sqrt(F.col(f"_q{i}")).alias("rmse"), F.col(f"_a{i}").alias("mae"),
                      F.col(f"_n{i}").alias("n")) for i, (name, _) in enumerate(conditions)]
    return e.agg(*aggs).select(F.inline(F.array(*cells))).where(F.col("n") > 0)


def residual_histogram(df: DataFrame, bins: int = C.HISTOGRAM_BINS) -> DataFrame:
    """Counts of residuals in 50 equal bins from min to max, empty bins included.

    The maximum falls in the last bin; equal residuals all fall in the first.
    Without a scored reading there is no bin.
    """
    res = actual() - pred()
    ends = df.select(F.struct(F.min(res).alias("lo"), F.max(res).alias("hi"))).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    at = F.when(width > 0, F.least(F.floor((res - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = scored(df).select(at.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("_c"))
    # one row: the filled bins (at most ``bins`` of them), then every bin with its count or zero
    one = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "_c"))).alias("_m"))
    h = one.where(F.size("_m") > 0).select("_m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return h.select("bin", (lo + F.col("bin") * width).alias("bin_start"), (lo + (F.col("bin") + 1) * width).alias("bin_end"),
                    F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0).cast("long")).alias("count"))


def residual_normal_fit(df: DataFrame, points: int = C.NORMAL_FIT_POINTS, bins: int = C.HISTOGRAM_BINS) -> DataFrame:
    """Normal-curve overlay for the histogram: 100 points from min to max, pdf x n x (max-min)/bins."""
    res = actual() - pred()
    s = df.agg(F.min(res).alias("_lo"), F.max(res).alias("_hi"), F.avg(res).alias("_mu"),
               F.stddev_samp(res).alias("_sd"), F.count(res).alias("_n"))
    s = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    x = F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / F.lit(float(points - 1))
    s = s.withColumn("x", x)
    pdf = F.exp(-0.5 * F.pow((F.col("x") - F.col("_mu")) / F.col("_sd"), 2)) / (F.col("_sd") * math.sqrt(2 * math.pi))
    density = pdf * F.col("_n") * (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return s.select("point", "x", density.alias("density"))
