"""Dashboard slicer (F1-F3) and its empty-result fallback (F2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark import constants as C


def slicer_predicate(start_date: dt.date | str | None = None, end_date: dt.date | str | None = None,
                     day_names=C.DAY_NAMES, hour_range: tuple[int, int] = (0, 23),
                     ts: str = "timestamp") -> Column:
    """Inclusive date range, day-name set and inclusive hour range.

    The date bounds are written as a half-open range on the raw timestamp
    (``ts >= start AND ts < end + 1 day``) so Parquet can skip row groups by
    min/max statistics. A missing bound means the data's own min / max, i.e.
    no bound. Day names and hours compare derived fields of the same column.
    """
    t = F.col(ts)
    cond = F.lit(True)
    if start_date is not None:
        cond = cond & (t >= F.to_timestamp_ntz(F.lit(str(start_date))))
    if end_date is not None:
        cond = cond & (t < F.to_timestamp_ntz(F.lit(str(end_date))) + F.expr("INTERVAL 1 DAY"))
    if tuple(day_names) != tuple(C.DAY_NAMES):
        cond = cond & F.date_format(t, "EEEE").isin(*day_names)
    lo, hi = hour_range
    if (lo, hi) != (0, 23):
        cond = cond & F.hour(t).between(lo, hi)
    return cond


def slicer_filter(df: DataFrame, **kwargs) -> DataFrame:
    """Rows inside the slicer."""
    return df.where(slicer_predicate(**kwargs))


def slicer_with_fallback(df: DataFrame, **kwargs) -> DataFrame:
    """Rows inside the slicer, or every row when the slicer matches nothing (F2).

    One probe with the pushed predicate stops at the first match; the plan is
    then either the sliced one, whose predicate still reaches the scan, or the
    full one. Neither reads the table twice.
    """
    sliced = slicer_filter(df, **kwargs)
    return df if sliced.limit(1).isEmpty() else sliced
