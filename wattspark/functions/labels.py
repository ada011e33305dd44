"""Labels, categories, tariff and error expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattspark import constants as C


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def outage_severity(stage="load_shedding_stage") -> Column:
    """Right-closed bins (-1,0], (0,2], (2,4], (4,6]; anything outside is null."""
    s = _c(stage)
    e = C.SEVERITY_EDGES
    expr = None
    for lo, hi, label in zip(e[:-1], e[1:], C.SEVERITY_LABELS):
        cond = (s > lo) & (s <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr  # no otherwise: null outside the bins


def is_peak_period(period="time_period") -> Column:
    return _c(period).isin(*C.PEAK_PERIODS)


def estimated_cost(kwh="energy_consumption", period="time_period") -> Column:
    """Time-of-use cost: peak periods at the peak tariff, everything else off-peak."""
    return F.when(is_peak_period(period), _c(kwh) * F.lit(C.TARIFF_PEAK)) \
        .otherwise(_c(kwh) * F.lit(C.TARIFF_OFFPEAK))


def residual(actual="energy_consumption", predicted="predicted") -> Column:
    return _c(actual) - _c(predicted)


def abs_error(actual="energy_consumption", predicted="predicted") -> Column:
    return F.abs(_c(actual) - _c(predicted))


def pct_error(actual="energy_consumption", predicted="predicted") -> Column:
    """Absolute error as % of the actual value, the actual floored at 0.01."""
    return F.abs(_c(actual) - _c(predicted)) / F.greatest(_c(actual), F.lit(C.PCT_ERROR_FLOOR)) * 100.0


def clip_at_zero(col) -> Column:
    return F.greatest(F.lit(0.0), _c(col))


def category_seasonal(kwh, season_col, hour_col) -> Column:
    """Low / Normal / High with thresholds scaled for Winter and hours 18..21."""
    mult = (F.when(_c(season_col) == "Winter", F.lit(C.CATEGORY_WINTER_MULT)).otherwise(F.lit(1.0))
            * F.when(_c(hour_col).between(*C.CATEGORY_EVENING_HOURS), F.lit(C.CATEGORY_EVENING_MULT))
            .otherwise(F.lit(1.0)))
    v = _c(kwh)
    return (F.when(v < F.lit(C.CATEGORY_LOW) * mult, F.lit("Low"))
            .when(v < F.lit(C.CATEGORY_NORMAL) * mult, F.lit("Normal"))
            .otherwise(F.lit("High")))


def _banded(v: Column, bounds, top: str) -> Column:
    expr = None
    for bound, label in bounds:
        expr = F.when(v < bound, F.lit(label)) if expr is None else expr.when(v < bound, F.lit(label))
    return expr.otherwise(F.lit(top))


def category_fixed(kwh) -> Column:
    """Scenario simulator bands: <0.5 Low, <1 Normal, <1.5 Above Average, else High."""
    return _banded(_c(kwh), C.FIXED_CATEGORY_BOUNDS, C.FIXED_CATEGORY_TOP)


def category_bi(avg_kwh) -> Column:
    """BI bands on an hourly average: <2 Low, <2.5 Medium, else High."""
    return _banded(_c(avg_kwh), C.BI_CATEGORY_BOUNDS, C.BI_CATEGORY_TOP)


def stage_label(stage, zero_label: str = "No Outage") -> Column:
    """"Stage n" for n > 0, otherwise ``zero_label`` ("No Outage" or "Normal")."""
    s = _c(stage)
    return F.when(s > 0, F.concat(F.lit("Stage "), s.cast("string"))).otherwise(F.lit(zero_label))


def feature_family(name) -> Column:
    """Family of a model feature name; first matching substring rule wins."""
    n = F.lower(_c(name))
    expr = None
    for needles, family in C.FEATURE_FAMILY_RULES:
        cond = None
        for needle in needles:
            c = n.contains(needle)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(family)) if expr is None else expr.when(cond, F.lit(family))
    return expr.otherwise(F.lit(C.FEATURE_FAMILY_OTHER))


def explanation(category, hour_col, day_type, season_col, stage, backup) -> Column:
    """"<category> consumption expected due to: r1 + r2 ..." or "standard conditions".

    ``concat_ws`` skips the null reasons, so absent conditions leave no separator.
    """
    h, s = _c(hour_col), _c(stage)
    time_reason = (F.when((h >= 6) & (h < 9), F.lit(C.EXPLAIN_MORNING))
                   .when((h >= 18) & (h <= 21), F.lit(C.EXPLAIN_EVENING))
                   .when((h >= 0) & (h < 5), F.lit(C.EXPLAIN_NIGHT)))
    season_reason = (F.when(_c(season_col) == "Winter", F.lit(C.EXPLAIN_WINTER))
                     .when(_c(season_col) == "Summer", F.lit(C.EXPLAIN_SUMMER)))
    outage_reason = F.when(s > 0, F.concat(F.lit("electricity outage (Stage "), s.cast("string"), F.lit(")")))
    backup_reason = F.when(_c(backup) & (s > 0), F.lit(C.EXPLAIN_BACKUP))
    weekend_reason = F.when(F.lower(_c(day_type)) == "weekend", F.lit(C.EXPLAIN_WEEKEND))
    reasons = F.concat_ws(" + ", time_reason, season_reason, outage_reason, backup_reason, weekend_reason)
    reasons = F.coalesce(F.nullif(reasons, F.lit("")), F.lit(C.EXPLAIN_DEFAULT))
    return F.concat(_c(category), F.lit(" consumption expected due to: "), reasons)
