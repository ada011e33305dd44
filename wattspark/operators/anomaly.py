"""Z-score anomalies on global statistics.

Global mean and sample std are scalar subqueries (one partial-aggregated pass,
merged into a single subquery by the optimizer), inlined as constants into the
projection: no global window, no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark import constants as C


def with_z_score(df: DataFrame, value: str = "energy_consumption", threshold: float = C.ANOMALY_Z) -> DataFrame:
    mean = df.select(F.avg(value)).scalar()
    std = df.select(F.stddev_samp(value)).scalar()
    z = F.try_divide(F.col(value) - mean, std)
    return df.withColumn("z_score", z).withColumn("is_anomaly", F.coalesce(F.abs(F.col("z_score")) > threshold,
                                                                           F.lit(False)))


def anomalies(df: DataFrame, value: str = "energy_consumption", threshold: float = C.ANOMALY_Z) -> DataFrame:
    """Readings whose |z| exceeds the threshold."""
    return with_z_score(df, value, threshold).where(F.col("is_anomaly")).drop("is_anomaly")


def anomaly_count(df: DataFrame, value: str = "energy_consumption", threshold: float = C.ANOMALY_Z) -> DataFrame:
    """Number of anomalies and of readings."""
    z = with_z_score(df, value, threshold)
    return z.agg(F.count_if(F.col("is_anomaly")).alias("anomalies"), F.count(F.lit(1)).alias("readings"))
