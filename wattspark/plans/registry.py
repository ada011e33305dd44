"""Registered queries: name -> (Spark plan builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables (through the readings adapters). Doubles in the output are
rounded to 6 decimals, as in the oracle, so both sides hash alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def register(name: str, sql: str | None = None, note: str = ""):
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, sql, note)
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {q.name: q.build for q in REGISTRY.values()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {q.name: q.sql for q in REGISTRY.values() if q.sql}


def _load() -> None:
    # importing the modules registers their queries
    from wattspark.plans import q_rollups, q_windows, q_features, q_models, q_stored  # noqa: F401


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattspark.sources.adapters import orders_readings
    return orders_readings(spark, sf_dir)


def orders_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattspark.operators.enrich import enrich
    return enrich(orders(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wattspark.sources.adapters import events_readings
    return events_readings(spark, sf_dir)
