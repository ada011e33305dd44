"""Model feature encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattspark import constants as C


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cyclical(col, period: int) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*x/period."""
    angle = F.lit(2.0 * math.pi) * _c(col) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def one_hot(col, vocabulary, prefix: str) -> list[Column]:
    """Fixed-vocabulary one-hot columns ``prefix_value`` (0/1 int), no extra pass over the data."""
    return [(_c(col) == F.lit(v)).cast("int").alias(f"{prefix}_{v}") for v in vocabulary]


def household_one_hot_default(col) -> list[Column]:
    """Household one-hot where an unknown or missing id counts as the first household."""
    h = _c(col)
    known = h.isin(*C.HOUSEHOLDS)
    first = C.HOUSEHOLDS[0]
    out = []
    for v in C.HOUSEHOLDS:
        hit = (h == v) if v != first else ((h == v) | ~F.coalesce(known, F.lit(False)))
        out.append(F.coalesce(hit, F.lit(v == first)).cast("int").alias(f"household_{v}"))
    return out
