"""Outage schedule with part hours (X2): a sort-and-sweep over starts and ends inside bounded buckets of time.

An entry (seq, start, end, stage) sets the stage of every reading with
start <= timestamp < end; where entries overlap, the latest (largest seq)
wins. A range join would compare every reading with every entry. Instead

1. entries are dealt out by the number of their pieces and cut at the borders of buckets: hours, or minutes or seconds of
   the hours in which very many entries begin or end. Of entries with equal
   bounds in a bucket, and so of all that cover it whole, only the latest is
   kept, by a map-side combined aggregate;
2. a task sweeps over the starts and ends of one bucket in order, with a heap of
   the entries that are active, and writes disjoint segments;
3. readings meet the segments of their bucket in an equi-join, and take the one
   that holds their timestamp.

``CROWDED`` bounds what a bucket of more than a second holds. The table of crowded
hours is counted from the entries and has at most ``1 / CROWDED`` of their pieces
as rows; it is broadcast while it is small and joined otherwise.

Defined cases: an entry with a null field, or whose end is not after its start,
covers nothing; equal seq and bounds: the larger stage; a reading without a
timestamp has stage 0.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark.operators.outages import STAGE

HOUR, MINUTE, SECOND = 3_600_000_000, 60_000_000, 1_000_000
#: Pieces of an hour beyond which it is cut into minutes; a minute's share of as many cuts it into seconds.
CROWDED = 512
#: Crowded hours up to this number are broadcast.
SMALL = 100_000
#: Pieces of hours that one task makes and combines, about.
PIECES_A_TASK = 500_000


def _us(t: str) -> Column:
    """Microseconds of a wall-clock time."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(t).cast("timestamp_ntz"))


def _cut(rows: DataFrame, width: Column | int) -> DataFrame:
    """(bucket, lo, hi, seq, stage): intervals cut at the borders of buckets of ``width`` microseconds."""
    w = F.lit(width).cast("long") if isinstance(width, int) else width
    first, last = F.col("lo") - F.pmod("lo", w), F.col("hi") - 1 - F.pmod(F.col("hi") - 1, w)
    out = rows.select("*", w.alias("_w"), F.explode(F.sequence(first, last, w)).alias("_b"))
    return out.withColumns({"lo": F.greatest("lo", "_b"), "hi": F.least("hi", F.col("_b") + F.col("_w"))})


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (lo, hi, seq, stage) dealt out by their pieces of hours: a task holds the pieces of its rows to combine
    them, and the files that the rows come from may be read by few tasks."""
    last = F.col("hi") - 1
    pieces = rows.agg(F.sum(F.floor(last / HOUR) - F.floor(F.col("lo") / HOUR) + 1)).first()[0] or 0
    return rows.repartition(math.ceil(pieces / PIECES_A_TASK) or 1, "lo", "hi", "seq", "stage")


def _latest(pieces: DataFrame, *by: str) -> DataFrame:
    """Of pieces with equal bounds only the latest entry."""
    return pieces.groupBy(*by, "lo", "hi").agg(F.max(F.struct("seq", "stage")).alias("_e")).select(*by, "lo", "hi", "_e.seq", "_e.stage")


def sweep(entries: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint (lo, hi, stage) of (lo, hi, seq, stage): at each moment the stage of the active entry with the largest seq."""
    events = sorted({x for lo, hi, *_ in entries for x in (lo, hi)})
    waiting = sorted(entries, reverse=True)
    active: list[tuple[int, int, int]] = []  # -seq, -stage, end
    out: list[tuple[int, int, int]] = []
    for at, until in zip(events[:-1], events[1:]):
        while waiting and waiting[-1][0] <= at:
            _, hi, seq, stage = waiting.pop()
            heapq.heappush(active, (-seq, -stage, hi))
        while active and active[0][2] <= at:
            heapq.heappop(active)
        if active:
            stage = -active[0][1]
            if out and out[-1][1] == at and out[-1][2] == stage:
                out[-1] = (out[-1][0], until, stage)
            else:
                out.append((at, until, stage))
    return out


def _crowded(pieces: DataFrame) -> DataFrame:
    """(hour, width): hours that are cut further."""
    n = pieces.groupBy(F.col("_b").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") > CROWDED).select("hour", F.when(F.col("n") > CROWDED * 60, F.lit(SECOND)).otherwise(F.lit(MINUTE)).cast("long").alias("width"))


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def segments(schedule: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hour, bucket, segments) of a schedule (seq, start, end, stage), and its crowded hours."""
    rows = schedule.where("seq is not null and start is not null and end is not null and stage is not null").select(
        _us("start").alias("lo"), _us("end").alias("hi"), F.col("seq").cast("long").alias("seq"), F.col("stage").cast("int").alias("stage")).where("lo < hi")
    hours = _latest(_cut(dealt(rows), HOUR), "_b")
    crowded = _crowded(hours)
    cut = hours.withColumnRenamed("_b", "hour").join(_side(crowded), "hour", "left").withColumn("width", F.coalesce("width", F.lit(HOUR)))
    pieces = _latest(_cut(cut.select("hour", "lo", "hi", "seq", "stage", "width"), F.col("width")).withColumnRenamed("_b", "bucket"), "hour", "bucket")

    def run(group: pa.Table) -> pa.Table:
        found = sweep(list(zip(*(group[c].to_pylist() for c in ("lo", "hi", "seq", "stage")))))
        return pa.table({"hour": group["hour"][:1], "bucket": group["bucket"][:1],
                         "segments": pa.array([[{"lo": a, "hi": b, "stage": s} for a, b, s in found]], kind)})

    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("stage", pa.int32())]))
    return pieces.groupBy("hour", "bucket").applyInArrow(run, "hour long, bucket long, segments array<struct<lo:long,hi:long,stage:int>>"), crowded


def overlay(readings: DataFrame, schedule: DataFrame) -> DataFrame:
    """``readings`` with ``load_shedding_stage`` as the schedule sets it, 0 where it says nothing."""
    found, crowded = segments(schedule)
    r = readings.drop(STAGE).withColumn("_t", _us("timestamp"))
    r = r.withColumn("_hour", F.col("_t") - F.pmod("_t", F.lit(HOUR).cast("long")))
    r = r.join(_side(crowded.withColumnsRenamed({"hour": "_ch", "width": "_w"})), F.col("_hour") == F.col("_ch"), "left")
    width = F.coalesce("_w", F.lit(HOUR).cast("long"))
    r = r.withColumn("_bucket", F.col("_t") - F.pmod("_t", width)).drop("_ch", "_w")
    both = r.join(found.withColumnsRenamed({"hour": "_sh", "bucket": "_sb"}), (F.col("_hour") == F.col("_sh")) & (F.col("_bucket") == F.col("_sb")), "left")
    inside = F.filter("segments", lambda s: (s["lo"] <= F.col("_t")) & (F.col("_t") < s["hi"]))
    return both.withColumn(STAGE, F.coalesce(F.get(inside, F.lit(0))["stage"], F.lit(0))).drop("_t", "_hour", "_bucket", "_sh", "_sb", "segments")
