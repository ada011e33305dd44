"""Least squares from sufficient statistics (M1): a mergeable table of sums of products.

A day's row of the Gram table holds the sum of ``z_i * z_j`` for every pair of
z = (1, the features, the label). Rows of different days add up, so a fit after
new days reads their rows and the stored table, never the old readings, and a
day can be replaced or left out. The table has one row a day, 276 sums wide for
21 features, whatever the number of readings.

The normal equations are solved on the driver from the added-up row (a matrix
of 23 x 23) by a pseudo-inverse of the centred and scaled matrix: the one-hot
features of a group add up to one, so coefficients are not unique, but their
predictions are.

Rows with a null or NaN feature or label, and rows without a timestamp, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark import constants as C

ONE = "one"
#: Directions of the scaled matrix with less than this share of the largest are taken as dependent.
DEPENDENT = 1e-9


def names(features=C.FEATURES, label: str = C.LABEL) -> list[str]:
    return [ONE, *features, label]


def pairs(features=C.FEATURES, label: str = C.LABEL) -> list[tuple[str, str]]:
    z = names(features, label)
    return [(a, b) for i, a in enumerate(z) for b in z[i:]]


def _column(a: str, b: str) -> str:
    return f"{a}*{b}"


def gram_table(rows: DataFrame, features=C.FEATURES, label: str = C.LABEL, ts: str = "timestamp") -> DataFrame:
    """(date, a column for every pair): one map-side combined aggregate."""
    def value(name: str) -> Column:
        return F.lit(1.0) if name == ONE else F.col(f"`{name}`").cast("double")
    known = rows.where(F.col(ts).isNotNull())
    for name in [*features, label]:
        known = known.where(value(name).isNotNull() & ~F.isnan(value(name)))
    return known.groupBy(F.to_date(ts).alias("date")).agg(
        *[F.sum(value(a) * value(b)).alias(_column(a, b)) for a, b in pairs(features, label)])


def merge(*tables: DataFrame) -> DataFrame:
    """One table of several: rows of equal days add up."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return both.groupBy("date").agg(*[F.sum(f"`{c}`").alias(c) for c in both.columns if c != "date"])


def replace_days(path: str, new: DataFrame) -> None:
    """Write the days of ``new`` into the stored table; only their own folders are replaced."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def totals(table: DataFrame) -> DataFrame:
    """(feature_a, feature_b, total) over all days of the table."""
    cols = [c for c in table.columns if c != "date"]
    one = table.agg(*[F.sum(f"`{c}`").alias(c) for c in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c.split("*")[0]).alias("feature_a"), F.lit(c.split("*")[1]).alias("feature_b"),
                                                  F.col(f"`{c}`").alias("total")) for c in cols])))


@dataclass(frozen=True)
class LeastSquares:
    """A fitted line: intercept, coefficients, and how many rows it rests on."""
    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    n: int

    def predicted(self) -> Column:
        out = F.lit(self.intercept)
        for name, w in zip(self.features, self.coefficients):
            out = out + F.col(f"`{name}`").cast("double") * F.lit(w)
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("predicted", self.predicted())


def solve(table: DataFrame, features=C.FEATURES, label: str = C.LABEL) -> LeastSquares:
    """The least-squares line of all days in the table; zero for a table without rows."""
    z = names(features, label)
    matrix = np.zeros((len(z), len(z)))
    for r in totals(table).collect():  # a row a pair
        i, j = z.index(r.feature_a), z.index(r.feature_b)
        matrix[i, j] = matrix[j, i] = r.total or 0.0
    n = matrix[0, 0]
    if not n:
        return LeastSquares(tuple(features), 0.0, (0.0,) * len(features), 0)
    mean = matrix[0, 1:] / n
    centred = matrix[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(centred)[:-1], 0.0))
    scale[scale <= 1e-12 * np.sqrt(n)] = np.inf  # constant features
    within = centred[:-1, :-1] / np.outer(scale, scale)
    w = np.linalg.pinv(within, rcond=DEPENDENT, hermitian=True) @ (centred[:-1, -1] / scale) / scale
    return LeastSquares(tuple(features), float(mean[-1] - mean[:-1] @ w), tuple(map(float, w)), int(round(n)))
