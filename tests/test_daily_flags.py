import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import readings_df
from wattspark.operators import daily_flags, neighbours
from wattspark.operators.outages import with_outage_flags

DAYS = 12


def readings(spark, seed=1, n=900):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        day, hour = int(rng.integers(1, DAYS + 1)), int(rng.integers(0, 24))
        house = "House_hot" if i % 3 == 0 else f"House_{int(rng.integers(0, 30))}"  # many skip days
        rows.append((i, house, f"2025-03-{day:02d} {hour:02d}:{int(rng.integers(0, 4)) * 15:02d}", 1.0, int(rng.integers(0, 3)), False))
    df = readings_df(spark, rows)
    odd = df.limit(6).withColumn("household_id", F.when(F.col("reading_id") % 2 == 0, F.lit(None)).otherwise(F.col("household_id"))) \
        .withColumn("timestamp", F.when(F.col("reading_id") % 2 == 1, F.lit(None)).otherwise(F.col("timestamp"))).withColumn("reading_id", F.col("reading_id") + 10_000)
    return df.unionByName(odd)


def rows_of(df):
    cols = ["reading_id", "household_id", "timestamp", *daily_flags.FLAGS]
    return sorted(map(str, df.select(*cols).collect()))


def test_day_by_day_is_the_whole_run(spark, scratch, monkeypatch):
    monkeypatch.setattr(neighbours, "HOT_ROWS", 10)
    df = readings(spark)
    df.write.parquet(f"{scratch}/in")
    df = spark.read.parquet(f"{scratch}/in")
    ends = [dt.datetime(2025, 3, d) for d in (2, 3, 4, 8, 9)]
    got = daily_flags.run(df, ends, f"{scratch}/out")
    assert rows_of(got) == rows_of(with_outage_flags(df))


def test_a_batch_reads_its_own_rows_and_one_a_household(spark, scratch):
    df = readings(spark)
    last = dt.datetime(2025, 3, 10)
    state = daily_flags.empty_state(df)
    done = daily_flags.step(df.where(F.col("timestamp") < F.lit(last)), state)
    done.state.write.parquet(f"{scratch}/state")
    state = spark.read.parquet(f"{scratch}/state")
    households = df.where("timestamp < '2025-03-10' and household_id is not null").select("household_id").distinct().count()
    assert state.count() == households
    today = df.where((F.col("timestamp") >= F.lit(last)) & (F.col("timestamp") < F.lit(last) + F.expr("interval 1 day")))
    out = daily_flags.step(today, state, last)
    assert out.final.count() + out.state.count() == today.count() + households


def test_late_readings_are_returned_apart(spark):
    df = readings(spark, n=40)
    since = dt.datetime(2025, 3, 5)
    out = daily_flags.step(df, daily_flags.empty_state(df), since)
    assert out.late.count() == df.where("timestamp < '2025-03-05'").count() > 0
    assert out.final.count() + out.state.count() + out.late.count() == df.count()


def test_empty_batches(spark):
    df = readings(spark, n=30).where("timestamp is not null and household_id is not null")
    first = daily_flags.step(df, daily_flags.empty_state(df))
    again = daily_flags.step(df.limit(0), first.state)
    assert again.final.count() == 0 and again.state.count() == first.state.count()
    assert rows_of(first.final.unionByName(daily_flags.close(again.state))) == rows_of(with_outage_flags(df))
