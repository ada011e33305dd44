"""Prediction errors from a small mergeable table (A21-A25): one row a day and scenario, whatever the readings.

A row holds counts, sums, means and centred second moments of residual and
actual, and the least and largest residual. Rows merge exactly (``merge``): the
centred moment of a union is the sum of the parts' moments plus
n_i * (mean_i - mean)^2, so nothing is lost to cancellation as with sums of
squares. New days are added or replaced without reading old predictions, and
metrics, bands, scenario errors and the normal-fit overlay come from the table.

The histogram needs the residuals themselves and stays in ``errors``.

Scenario ``All`` holds every reading of the day, scored or not; the six
scenarios overlap. A reading without a timestamp belongs to the null day: it
counts in metrics, not in bands.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark import constants as C
from wattspark.functions import labels as lab
from wattspark.operators.errors import _scenario_conditions, actual, is_scored, pred

ALL = "All"
SUMS = ("n", "n_unscored", "sum_actual", "sum_predicted", "sum_abs", "sum_pct", "n_pct")
KEYS = ("date", "scenario")


def moments(e: DataFrame) -> DataFrame:
    """The table of enriched readings with a ``predicted`` column: one aggregate over days, unpivoted to scenarios."""
    res = actual() - pred()
    pct = lab.pct_error("energy_consumption", "predicted")
    conditions = [(ALL, F.lit(True)), *_scenario_conditions()]
    aggs, cells = [], []
    for i, (name, cond) in enumerate(conditions):
        inside = F.coalesce(cond, F.lit(False))
        own = inside & is_scored()
        own_actual, own_res = F.when(own, actual()), F.when(own, res)
        cols = {"n": F.count_if(own), "n_unscored": F.count_if(inside & ~is_scored()), "sum_actual": F.sum(own_actual),
                "sum_predicted": F.sum(F.when(own, pred())), "sum_abs": F.sum(F.abs(own_res)), "sum_pct": F.sum(F.when(own, pct)),
                "n_pct": F.count(F.when(own, pct)), "mean_residual": F.avg(own_res), "m2_residual": F.var_pop(own_res) * F.count(own_res),
                "mean_actual": F.avg(own_actual), "m2_actual": F.var_pop(own_actual) * F.count(own_actual),
                "min_residual": F.min(own_res), "max_residual": F.max(own_res)}
        aggs += [c.alias(f"_{i}_{k}") for k, c in cols.items()]
        cells.append(F.struct(F.lit(name).alias("scenario"), *[F.col(f"_{i}_{k}").alias(k) for k in cols]))
    days = e.groupBy(F.to_date("timestamp").alias("date")).agg(*aggs)
    return days.select("date", F.inline(F.array(*cells))).where("n + n_unscored > 0")


def merge(table: DataFrame, *by: str) -> DataFrame:
    """Rows of equal ``by`` (none: all rows) as one, exactly; two aggregates over the small table."""
    def centre(x: str) -> Column:
        return F.try_divide(F.sum(F.col("n") * F.col(f"mean_{x}")), F.sum("n").cast("double")).alias(f"_c_{x}")
    keys = [F.col(b) for b in by]
    means = table.groupBy(*keys).agg(centre("residual"), centre("actual"))
    if by:
        same = means.select(*[F.col(b).alias(f"_k_{b}") for b in by], "_c_residual", "_c_actual")
        on = F.lit(True)
        for b in by:
            on = on & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
        rows = table.join(same, on)
    else:
        one = means.select(F.struct("_c_residual", "_c_actual")).scalar()
        rows = table.withColumns({c: one.getField(c) for c in ("_c_residual", "_c_actual")})

    def spread(x: str) -> Column:
        off = F.col(f"mean_{x}") - F.col(f"_c_{x}")
        return F.sum(F.col(f"m2_{x}") + F.col("n") * off * off).alias(f"m2_{x}")
    return rows.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.max("_c_residual").alias("mean_residual"), spread("residual"),
        F.max("_c_actual").alias("mean_actual"), spread("actual"),
        F.min("min_residual").alias("min_residual"), F.max("max_residual").alias("max_residual"))


def _mean_square() -> Column:
    """Mean of the squared residuals: spread around the mean plus the mean's own square."""
    return F.try_divide(F.col("m2_residual"), F.col("n").cast("double")) + F.col("mean_residual") * F.col("mean_residual")


def error_metrics(table: DataFrame) -> DataFrame:
    """As ``errors.error_metrics``."""
    one = merge(table.where(F.col("scenario") == ALL))
    return one.select(
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_unscored", F.lit(0)).alias("n_unscored"), F.sqrt(_mean_square()).alias("rmse"),
        F.try_divide(F.col("sum_abs"), F.col("n").cast("double")).alias("mae"),
        F.try_divide(F.col("sum_pct"), F.col("n_pct").cast("double")).alias("mape"),
        (F.lit(1.0) - F.try_divide(_mean_square() * F.col("n"), F.col("m2_actual"))).alias("r2"))


def prediction_bands(table: DataFrame) -> DataFrame:
    """As ``errors.prediction_bands`` (A21): a day's row is its band already."""
    day = table.where((F.col("scenario") == ALL) & F.col("date").isNotNull() & (F.col("n") > 0))
    std = F.sqrt(F.try_divide(F.col("m2_residual"), (F.col("n") - 1).cast("double")))
    width = F.lit(C.BAND_Z * math.sqrt(C.BAND_HOURS)) * F.col("residual_std")
    return day.select("date", F.col("sum_actual").alias("actual"), F.col("sum_predicted").alias("predicted"),
                      F.col("mean_residual").alias("residual_mean"), std.alias("residual_std")).withColumns(
        {"upper": F.col("predicted") + width, "lower": F.col("predicted") - width})


def scenario_errors(table: DataFrame) -> DataFrame:
    """As ``errors.scenario_errors``."""
    out = merge(table.where((F.col("scenario") != ALL) & (F.col("n") > 0)), "scenario")
    return out.select("scenario", F.sqrt(_mean_square()).alias("rmse"), F.try_divide(F.col("sum_abs"), F.col("n").cast("double")).alias("mae"), "n")


def residual_normal_fit(table: DataFrame, points: int = C.NORMAL_FIT_POINTS, bins: int = C.HISTOGRAM_BINS) -> DataFrame:
    """As ``errors.residual_normal_fit``."""
    one = merge(table.where((F.col("scenario") == ALL) & (F.col("n") > 0)))
    sd = F.sqrt(F.try_divide(F.col("m2_residual"), (F.col("n") - 1).cast("double")))
    s = one.select("n", F.col("min_residual").alias("lo"), F.col("max_residual").alias("hi"), F.col("mean_residual").alias("mu"), sd.alias("sd"),
                   F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    s = s.withColumn("x", F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / F.lit(float(points - 1)))
    pdf = F.exp(-0.5 * F.pow((F.col("x") - F.col("mu")) / F.col("sd"), 2)) / (F.col("sd") * math.sqrt(2 * math.pi))
    return s.select("point", "x", (pdf * F.col("n") * (F.col("hi") - F.col("lo")) / F.lit(float(bins))).alias("density"))
