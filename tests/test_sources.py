"""Scans and sinks (S1-S6) and the streaming rollups."""

import datetime as dt
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.conftest import readings_df
from wattspark.operators import rollups
from wattspark.operators.enrich import enrich
from wattspark.sources import sinks
from wattspark.sources.adapters import orders_readings
from wattspark.sources.readings import READING_COLUMNS, read_readings
from wattspark.streaming import rollups as stream_rollups


def test_csv_roundtrip_and_schema(spark, scratch):
    r = orders_readings(spark, "/root/testdata/sf0.001").select(*READING_COLUMNS)
    sinks.write_readings(r, f"{scratch}/csv", fmt="csv", partitioned=False)
    back = read_readings(spark, f"{scratch}/csv", fmt="csv")
    assert [f.name for f in back.schema.fields][:5] == list(READING_COLUMNS)
    assert back.count() == r.count()
    a = r.agg(F.round(F.sum("energy_consumption"), 6)).first()[0]
    assert back.agg(F.round(F.sum("energy_consumption"), 6)).first()[0] == a


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_layout_reads_back_and_prunes(spark, scratch):
    r = orders_readings(spark, "/root/testdata/sf0.001")
    sinks.write_readings(r, f"{scratch}/pq")
    assert any(d.startswith("part_year=") for d in os.listdir(f"{scratch}/pq"))
    n_files = sum(f.endswith(".parquet") for _, _, names in os.walk(f"{scratch}/pq") for f in names)
    months = r.select(F.date_trunc("month", F.col("timestamp").cast("timestamp"))).distinct().count()
    assert n_files <= months + 4  # range-partitioned by time: a month is written once, or by two neighbours
    back = read_readings(spark, f"{scratch}/pq")
    assert back.columns == [*READING_COLUMNS, "reading_id"]
    assert sorted(back.select(*READING_COLUMNS).collect()) == sorted(r.select(*READING_COLUMNS).collect())
    for rollup in (rollups.daily_summary, rollups.seasonal_stats, rollups.household_stats):
        assert rollup(enrich(back)).count() == rollup(enrich(r)).count()
    from wattspark.operators.reshape import monthly_cost_by_period
    assert monthly_cost_by_period(enrich(back)).count() == monthly_cost_by_period(enrich(r)).count()
    part = read_readings(spark, f"{scratch}/pq", start_date="1996-03-01", end_date="1996-03-31")
    plan = _plan(part)
    filters = plan[plan.index("PartitionFilters"):]
    assert "part_month" in filters[:filters.index("]")] and "GreaterThanOrEqual(timestamp" in plan
    assert part.count() == r.where((F.year("timestamp") == 1996) & (F.month("timestamp") == 3)).count()


def test_reading_ids_do_not_depend_on_splits_and_let_filters_through(spark, scratch):
    from wattspark.operators.filters import slicer_filter
    r = orders_readings(spark, "/root/testdata/sf0.01").select(*READING_COLUMNS)
    r.repartition(3).write.parquet(f"{scratch}/pq")
    ids = []
    for size in ("32k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        ids.append(sorted(x.reading_id for x in read_readings(spark, f"{scratch}/pq").select("reading_id").collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids[0] == ids[1] and len(set(ids[0])) == r.distinct().count()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in _plan(
        slicer_filter(read_readings(spark, f"{scratch}/pq"), start_date="1996-01-01"))


def test_missing_source_is_an_error(spark, scratch):
    with pytest.raises(AnalysisException):
        read_readings(spark, f"{scratch}/nothing.csv", fmt="csv").count()


def test_extracts_and_warehouse_table(spark, scratch):
    r = orders_readings(spark, "/root/testdata/sf0.001")
    sinks.write_daily_extract(r, f"{scratch}/daily")
    sinks.write_hourly_extract(r, f"{scratch}/hourly")
    daily = spark.read.option("header", True).csv(f"{scratch}/daily")
    assert daily.columns == ["date", "day_name", "day_of_week", "total_kwh", "avg_kwh", "min_kwh", "max_kwh"]
    assert daily.count() == rollups.daily_extract(enrich(r)).count()
    sinks.save_warehouse_table(r, "energy_consumption")
    t = spark.table("energy_consumption")
    assert [(f.name, f.dataType.simpleString()) for f in t.schema.fields] == \
        [("household_id", "string"), ("timestamp", "timestamp_ntz"), ("energy_consumption", "float")]


def test_daily_stream_matches_batch_for_closed_days(spark, scratch):
    rows = []
    for d in range(4):
        for h in range(0, 24, 3):
            rows.append((d * 100 + h, "House_1", f"2025-02-{d + 1:02d} {h:02d}:00", 0.5 + h / 10, 0, False))
    r = readings_df(spark, rows).select(*READING_COLUMNS)
    src = f"{scratch}/in"
    for d in range(4):   # one file per day: the stream sees them in order
        r.where(F.dayofmonth("timestamp") == d + 1).write.mode("append").parquet(src)
    stream = stream_rollups.daily_summary_stream(
        stream_rollups.read_readings_stream(spark, src, max_files_per_trigger=1))
    q = stream.writeStream.outputMode("append").format("memory").queryName("daily_out") \
        .option("checkpointLocation", f"{scratch}/ckpt").start()
    q.processAllAvailable()
    q.stop()
    got = {x.date: (round(x.total_kwh, 9), x.day_name) for x in spark.table("daily_out").collect()}
    batch = {x.date: (round(x.total_kwh, 9), x.day_name) for x in rollups.daily_summary(enrich(r)).collect()}
    assert got and set(got) < set(batch)           # the last day is still open
    assert all(got[k] == batch[k] for k in got)
    assert dt.date(2025, 2, 1) in got


def test_hourly_stream_matches_batch_for_closed_hours(spark, scratch):
    rows = [(i, "House_1", f"2025-02-01 {i // 4:02d}:{(i % 4) * 15:02d}", 0.25 * (i % 7), 0, False) for i in range(40)]
    r = readings_df(spark, rows).select(*READING_COLUMNS)
    src = f"{scratch}/in_h"
    for h in range(10):
        r.where(F.hour("timestamp") == h).write.mode("append").parquet(src)
    stream = stream_rollups.hourly_extract_stream(
        stream_rollups.read_readings_stream(spark, src, max_files_per_trigger=1), lateness="30 minutes")
    q = stream.writeStream.outputMode("append").format("memory").queryName("hourly_out") \
        .option("checkpointLocation", f"{scratch}/ckpt_h").start()
    q.processAllAvailable()
    q.stop()
    got = {(x.date, x.hour): round(x.total_kwh, 9) for x in spark.table("hourly_out").collect()}
    batch = {(x.date, x.hour): round(x.total_kwh, 9) for x in rollups.hourly_extract(enrich(r)).collect()}
    assert got and set(got) < set(batch) and all(got[k] == batch[k] for k in got)
