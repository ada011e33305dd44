"""Calendar-enriched readings: the shared first step of every dashboard analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wattspark.functions import calendar as cal
from wattspark.functions import labels as lab

CALENDAR_COLUMNS = ("hour", "day_of_week", "date", "day_name", "month", "month_name", "week", "is_weekend")
ENRICHED_COLUMNS = CALENDAR_COLUMNS + ("season", "time_period", "outage_severity", "estimated_cost")


def calendar_columns(ts: str = "timestamp") -> dict:
    """hour, day_of_week (0=Mon), date, day_name, month, month_name, ISO week, is_weekend."""
    return {
        "hour": cal.hour(ts),
        "day_of_week": cal.day_of_week(ts),
        "date": cal.date(ts),
        "day_name": cal.day_name(ts),
        "month": cal.month(ts),
        "month_name": cal.month_name(ts),
        "week": cal.iso_week(ts),
        "is_weekend": cal.is_weekend(ts),
    }


def with_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns(calendar_columns(ts))


def enrich(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Calendar columns plus season, time_period, outage_severity and estimated_cost.

    One projection (a single analysis pass and one codegen stage, no shuffle);
    expressions shared between columns (hour, month) are computed once by
    subexpression elimination. Catalyst prunes the columns a downstream
    aggregate does not reference.
    """
    cols = calendar_columns(ts)
    period = cal.time_period(cal.hour(ts))
    cols.update({
        "season": cal.season(cal.month(ts)),
        "time_period": period,
        "outage_severity": lab.outage_severity("load_shedding_stage"),
        "estimated_cost": lab.estimated_cost("energy_consumption", period),
    })
    return df.select("*", *[c.alias(n) for n, c in cols.items()])
