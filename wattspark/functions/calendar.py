"""Calendar derivations on a ``timestamp_ntz`` column.

All functions are time-zone free: they read the wall-clock fields of a
``timestamp_ntz`` value, so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattspark import constants as C


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hour(ts="timestamp") -> Column:
    return F.hour(_c(ts))


def day_of_week(ts="timestamp") -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(_c(ts))


def month(ts="timestamp") -> Column:
    return F.month(_c(ts))


def day_of_year(ts="timestamp") -> Column:
    return F.dayofyear(_c(ts))


def date(ts="timestamp") -> Column:
    return F.to_date(_c(ts))


def day_name(ts="timestamp") -> Column:
    return F.date_format(_c(ts), "EEEE")


def month_name(ts="timestamp") -> Column:
    return F.date_format(_c(ts), "MMMM")


def iso_week(ts="timestamp") -> Column:
    return F.weekofyear(_c(ts))


def is_weekend(ts="timestamp") -> Column:
    return (F.weekday(_c(ts)) >= 5).cast("int")


def season(month_col) -> Column:
    """Southern-hemisphere season of a month number."""
    m = _c(month_col)
    return (F.when(m.isin(*C.SEASON_MONTHS["Winter"]), F.lit("Winter"))
            .when(m.isin(*C.SEASON_MONTHS["Summer"]), F.lit("Summer"))
            .when(m.isin(*C.SEASON_MONTHS["Autumn"]), F.lit("Autumn"))
            .otherwise(F.lit("Spring")))


def time_period(hour_col) -> Column:
    """Dashboard time-of-use period."""
    h = _c(hour_col)
    return (F.when((h >= 6) & (h < 9), F.lit("Morning Peak"))
            .when((h >= 9) & (h < 17), F.lit("Daytime"))
            .when((h >= 17) & (h < 21), F.lit("Evening Peak"))
            .otherwise(F.lit("Off-Peak")))


def bi_peak_label(hour_col) -> Column:
    """BI calculated field: inclusive 17..21 evening, 7..10 morning."""
    h = _c(hour_col)
    return (F.when(h.between(*C.BI_EVENING_HOURS), F.lit("Evening Peak"))
            .when(h.between(*C.BI_MORNING_HOURS), F.lit("Morning Peak"))
            .otherwise(F.lit("Off-Peak")))


def month_of_season(season_col) -> Column:
    """Mid-season month used when only a season is known (default January)."""
    lookup = F.create_map(*[x for kv in C.SEASON_MID_MONTH.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(lookup, _c(season_col)), F.lit(C.SEASON_MID_MONTH_DEFAULT))


def day_order(day_name_col) -> Column:
    """1 = Monday .. 7 = Sunday, for sorting day names."""
    d = _c(day_name_col)
    expr = None
    for i, name in enumerate(C.DAY_NAMES, start=1):
        expr = F.when(d == name, F.lit(i)) if expr is None else expr.when(d == name, F.lit(i))
    return expr
