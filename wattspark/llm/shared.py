"""Small helpers of the training-data operators.

``stage_table`` cuts lineage: it writes a frame as Parquet into the folder that
the cluster names in ``spark.checkpoint.dir`` (shared by all executors) and
reads it back, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspark.session import checkpoint_dir

#: Upper case A-Z and what it becomes; other letters stay as they are.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; ASCII-only texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that is no column of ``df`` (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
