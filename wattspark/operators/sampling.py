"""Repeatable fixed-size sample and key-based split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark import constants as C


def sample_fixed_n(df: DataFrame, n: int, seed: int = C.SEED, key: str = "reading_id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones on every run and partitioning.

    Rows are ranked by a seeded hash of their key and the ``n`` smallest kept:
    a top-k (each task keeps its own ``n`` best, then one merge), not a full sort.
    """
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)).limit(n)


def train_test_split(df: DataFrame, key: str = "reading_id", buckets: int = C.TEST_FRACTION_BUCKETS) -> DataFrame:
    """Tag every row ``train`` or ``test`` (one in ``buckets`` by key: 80/20).

    A function of the key only, so it is stable under repartitioning and task
    retries, unlike ``randomSplit``.
    """
    return df.withColumn("split", F.when(F.pmod(F.col(key), F.lit(buckets)) == 0, F.lit("test"))
                         .otherwise(F.lit("train")))
