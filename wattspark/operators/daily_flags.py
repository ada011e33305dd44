"""Outage flags kept up batch by batch (W1-W5): a new day reads its own readings and one row a household.

The flags of a reading need its household's previous and next reading. A batch
(a day, or any later span of time) therefore leaves one open edge: the last
reading of each household, whose next one is not known yet. The *state* is a
table of these readings with their previous stage, one row a household:

    readings of the batch + state  ->  readings that are final, new state

The state's readings take part in the batch like its own, so the neighbour
lookup (skew-safe, see ``neighbours``) links them to the first reading of the
batch; all but the last of each household are final then. Households without a
reading in the batch stay in the state as they are. ``close`` ends the series:
the last readings have no next one.

What a batch costs depends on its own rows and the number of households, not on
history. State and final readings are written tables, so a failed batch is run
again from the state before it. Readings older than the end of the last batch
are late: their neighbours are final already, and they are returned apart.

Readings without a household or a timestamp have no neighbours (as in the whole
run); those of a batch are final at once.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark.operators.neighbours import neighbour_values
from wattspark.operators.outages import STAGE

FLAGS = ("prev_stage", "next_stage", "is_outage", "before_outage", "after_outage", "post_load_shedding")


@dataclass(frozen=True)
class Batch:
    """What a batch gives: final readings with their flags, the state after it, and late readings."""
    final: DataFrame
    state: DataFrame
    late: DataFrame


def _at(t: dt.datetime) -> Column:
    """A wall-clock time, whatever the session's time zone."""
    return F.to_timestamp_ntz(F.lit(t.isoformat(sep=" ")))


def _flags(df: DataFrame) -> DataFrame:
    clear = F.col(STAGE) == 0
    return df.withColumns({
        "is_outage": (F.col(STAGE) > 0).cast("int"),
        "before_outage": (clear & (F.col("next_stage") > 0)).cast("int"),
        "after_outage": (clear & (F.col("prev_stage") > 0)).cast("int"),
        "post_load_shedding": (clear & (F.col("prev_stage") > 0)).cast("int")})


def empty_state(readings: DataFrame) -> DataFrame:
    """The state before the first batch: no household."""
    return readings.where(F.lit(False)).withColumn("_before", F.lit(None).cast(readings.schema[STAGE].dataType))


def step(batch: DataFrame, state: DataFrame, since: dt.datetime | None = None, key: str = "household_id") -> Batch:
    """One batch after another; ``since`` is the end of the batch before (its readings are older)."""
    late = batch.where(F.lit(False)) if since is None else batch.where(F.col("timestamp") < _at(since))
    rows = batch if since is None else batch.where(F.col("timestamp").isNull() | (F.col("timestamp") >= _at(since)))
    # _held marks the state's readings: the stage before them is known from their own batch
    both = rows.withColumns({"_before": F.lit(None).cast(batch.schema[STAGE].dataType), "_held": F.lit(False)}).unionByName(
        state.withColumn("_held", F.lit(True))).withColumn("_cell", F.struct(F.col(STAGE).alias("v")))
    linked = neighbour_values(both, "_cell", key=key, prev_name="_prev", next_name="_next", default=None)
    before = F.when(F.col("_held"), F.col("_before")).when(F.col("_prev").isNull(), F.lit(0)).otherwise(F.col("_prev.v"))
    linked = linked.withColumn("prev_stage", before)
    # a placed reading without a next one is the last of its household
    last = F.col(key).isNotNull() & F.col("timestamp").isNotNull() & F.col("_next").isNull()
    after = F.when(F.col("_next").isNull(), F.lit(0)).otherwise(F.col("_next.v"))
    final = _flags(linked.where(~last).withColumn("next_stage", after)).select(*batch.columns, *FLAGS)
    return Batch(final, linked.where(last).select(*batch.columns, F.col("prev_stage").alias("_before")), late)


def close(state: DataFrame) -> DataFrame:
    """The flags of the last reading of every household, after which there is none."""
    columns = [c for c in state.columns if c != "_before"]
    return _flags(state.withColumn("prev_stage", F.col("_before")).withColumn("next_stage", F.lit(0))).select(*columns, *FLAGS)


def run(readings: DataFrame, ends: list[dt.datetime], folder: str, key: str = "household_id") -> DataFrame:
    """Batches that end at ``ends`` (rising), each written under ``folder`` before the next: the flags of all readings.

    Readings after the last end are a batch of their own. State and final rows of batch i are in
    ``folder/state-i`` and ``folder/final-i``; nothing but the batch's own span of ``readings`` is read.
    """
    spark = readings.sparkSession
    state, since, finals = empty_state(readings), None, []
    for i, end in enumerate([*ends, None]):
        t = F.col("timestamp")
        inside = F.lit(True) if since is None else (t >= _at(since))
        inside = inside if end is None else inside & (t < _at(end))
        batch = readings.where(inside | (t.isNull() if since is None else F.lit(False)))
        out = step(batch, state, since, key)
        for name, df in (("final", out.final), ("state", out.state)):
            df.write.mode("overwrite").parquet(f"{folder}/{name}-{i}")
        state = spark.read.schema(out.state.schema).parquet(f"{folder}/state-{i}")
        finals.append(spark.read.schema(out.final.schema).parquet(f"{folder}/final-{i}"))
        since = end
    for more in [*finals[1:], close(state)]:
        finals[0] = finals[0].unionByName(more)
    return finals[0]
