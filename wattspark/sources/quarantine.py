"""Readings from CSV files that may hold bad rows (S1): nothing becomes null in silence, nothing is lost.

Spark's default CSV mode turns a field that does not fit the schema into null.
Here every field is read as text, beside the whole line where its number of
fields is wrong, and cast by rules of its own; a line that breaks one goes to
quarantine with the first reason, as it was sent. Every data line is either a
reading or in quarantine.

A field that is empty is null and no error, as in the plain reader. One
projection over one scan decides; reasons are a fixed list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspark import constants as C
from wattspark.sources.readings import READINGS_SCHEMA, with_reading_id

LINE = "_line"
FIELDS = "wrong number of fields"
TIMES = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


@dataclass(frozen=True)
class Sorted:
    """Readings that fit the schema, and the others: line number of no file, but fields as sent, reason and file."""
    good: DataFrame
    bad: DataFrame


def _time(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in TIMES])


def _rules() -> list[tuple[str, Column, Column]]:
    """Per field: its name, its value, and what the value must be."""
    kwh, stage = F.col("energy_consumption").try_cast("double"), F.col("load_shedding_stage").try_cast("int")
    truth = F.when(F.lower("backup_power").isin("true", "1"), F.lit(True)).when(F.lower("backup_power").isin("false", "0"), F.lit(False))
    return [("household_id", F.col("household_id"), F.lit(True)),
            ("timestamp", _time(F.col("timestamp")), F.lit(True)),
            ("energy_consumption", kwh, ~F.isnan(kwh) & (F.abs(kwh) < float("inf"))),
            ("load_shedding_stage", stage, stage.between(0, C.MAX_STAGE)),
            ("backup_power", truth, F.lit(True))]


def read_sorted(spark: SparkSession, path: str, header: bool = True) -> Sorted:
    """Read a CSV file or folder. A field is unreadable if it is present but not of its type, out of range if the rule says so."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in READINGS_SCHEMA.fields] + [T.StructField(LINE, T.StringType())])
    raw = spark.read.schema(text).option("header", header).option("enforceSchema", True).option("columnNameOfCorruptRecord", LINE) \
        .option("mode", "PERMISSIVE").csv(path).withColumn("file", F.col("_metadata.file_path"))
    rules = _rules()
    reason = F.when(F.col(LINE).isNotNull(), F.lit(FIELDS))
    for name, value, ok in rules:
        reason = reason.when(F.col(name).isNotNull() & value.isNull(), F.lit(f"{name} unreadable")) \
            .when(value.isNotNull() & ~ok, F.lit(f"{name} out of range"))
    # a generator: values and reason are worked out once and no filter moves below them
    cells = [v.alias(f"v_{n}") for n, v, _ in rules]
    both = raw.select("*", F.inline(F.array(F.struct(reason.alias("reason"), *cells))))
    good = both.where("reason is null").select(*[F.col(f"v_{f.name}").cast(f.dataType).alias(f.name) for f in READINGS_SCHEMA.fields])
    bad = both.where("reason is not null").select("reason", *READINGS_SCHEMA.fieldNames(), F.col(LINE).alias("line"), "file")
    return Sorted(with_reading_id(good), bad)


def write_quarantine(bad: DataFrame, path: str, mode: str = "append") -> None:
    """Keep bad rows by reason, so that one kind can be mended and read again."""
    bad.write.mode(mode).partitionBy("reason").parquet(path)


def counts_by_reason(bad: DataFrame) -> DataFrame:
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
