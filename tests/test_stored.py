"""Stored, mergeable tables: Gram table (M1), error moments (A21-A25), slice rollup (F1-F3), quarantine."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import readings_df
from wattspark import constants as C
from wattspark.models import gram, training
from wattspark.operators import error_moments, errors, filters, rollups, slice_rollup
from wattspark.operators.enrich import enrich
from wattspark.operators.features import with_features
from wattspark.operators.sampling import train_test_split
from wattspark.sources.adapters import orders_readings
from wattspark.sources.quarantine import counts_by_reason, read_sorted, write_quarantine

SF = "/root/testdata/sf0.001"


def close(got, want, keys):
    got, want = ({tuple(str(r[k]) for k in keys): r.asDict() for r in df.collect()} for df in (got, want))
    assert set(got) == set(want) and want
    for k, row in want.items():
        assert set(got[k]) == set(row)
        for c, v in row.items():
            assert got[k][c] == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v), (k, c)


# --- Gram table ---------------------------------------------------------------------------------
def test_line_from_sums_is_least_squares_and_days_add_up(spark, scratch):
    rows = train_test_split(with_features(orders_readings(spark, SF)))
    rows.write.parquet(f"{scratch}/rows")
    rows = spark.read.parquet(f"{scratch}/rows")
    train = rows.where("split = 'train'")
    old, new = train.where("timestamp < '1998-01-01'"), train.where("timestamp >= '1998-01-01'")
    gram.gram_table(old).write.partitionBy("date").parquet(f"{scratch}/gram")
    gram.replace_days(f"{scratch}/gram", gram.gram_table(new))  # old readings are not read
    line = gram.solve(spark.read.parquet(f"{scratch}/gram"))
    assert line.n == train.count()
    model = training.fit(training.linear_pipeline(), train)
    both = line.transform(model.transform(rows).withColumnRenamed("predicted", "mllib"))
    assert both.agg(F.max(F.abs(F.col("predicted") - F.col("mllib")))).first()[0] < 1e-5
    pdf = train.select(*C.FEATURES, C.LABEL).toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf[list(C.FEATURES)].to_numpy(float)])
    best = X @ np.linalg.lstsq(X, pdf[C.LABEL].to_numpy(), rcond=None)[0]
    mine = line.transform(train).select("predicted").toPandas()["predicted"].to_numpy()
    assert np.abs(np.sort(best) - np.sort(mine)).max() < 1e-8
    # a day written again replaces itself
    gram.replace_days(f"{scratch}/gram", gram.gram_table(train.where("to_date(timestamp) in ('1996-01-02', '1996-01-03')")))
    assert gram.solve(spark.read.parquet(f"{scratch}/gram")).n == line.n
    # and merged tables are the table of all
    whole, parts = gram.totals(gram.gram_table(train)), gram.totals(gram.merge(gram.gram_table(old), gram.gram_table(new)))
    close(parts, whole, ["feature_a", "feature_b"])


def test_gram_without_rows_and_with_unknown_values(spark):
    rows = with_features(orders_readings(spark, SF)).limit(50)
    assert gram.solve(gram.gram_table(rows.limit(0))).n == 0
    odd = rows.withColumn(C.LABEL, F.when(F.col("reading_id") % 2 == 0, F.lit(None)).when(F.col("reading_id") % 3 == 0, F.lit(float("nan")))
                          .otherwise(F.col(C.LABEL)))
    assert gram.solve(gram.gram_table(odd)).n == odd.where(f"{C.LABEL} is not null and not isnan({C.LABEL})").count()


# --- error moments ------------------------------------------------------------------------------
def predictions(spark, offset=0.0):
    rng = np.random.default_rng(7)
    rows = [(i, f"House_{i % 5 + 1}", f"2025-{1 + i % 12:02d}-{1 + i % 20:02d} {i % 24:02d}:00", offset + float(rng.gamma(2.0)), int(rng.integers(0, 3)),
             bool(i % 2)) for i in range(500)]
    df = readings_df(spark, rows)
    pred = F.when(F.col("reading_id") % 11 == 0, F.lit(None)).otherwise(F.col("energy_consumption") * 0.9 + (F.col("reading_id") % 7) * 0.1)
    df = df.withColumn("predicted", pred).withColumn("energy_consumption", F.when(F.col("reading_id") % 13 == 0, F.lit(None))
                                                     .otherwise(F.col("energy_consumption")))
    df = df.withColumn("timestamp", F.when(F.col("reading_id") % 101 == 0, F.lit(None)).otherwise(F.col("timestamp")))
    return enrich(df)


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_analytics_from_moments_are_those_of_the_readings(spark, scratch, offset):
    e = predictions(spark, offset)
    table = error_moments.moments(e)
    table.write.parquet(f"{scratch}/m")
    table = spark.read.parquet(f"{scratch}/m")
    if offset:  # sums of squares would lose the spread here; moments about the mean do not
        spread = error_moments.merge(table.where("scenario = 'All'")).first()
        res = np.array([r[0] for r in errors.scored(e).select("energy_consumption").collect()])
        assert spread.m2_actual == pytest.approx(((res - res.mean()) ** 2).sum(), rel=1e-6)
        return
    close(error_moments.error_metrics(table), errors.error_metrics(e), ["n"])
    close(error_moments.prediction_bands(table), errors.prediction_bands(e), ["date"])
    close(error_moments.scenario_errors(table), errors.scenario_errors(e), ["scenario"])
    close(error_moments.residual_normal_fit(table), errors.residual_normal_fit(e), ["point"])


def test_merged_parts_are_the_whole(spark):
    e = predictions(spark)
    parts = [error_moments.moments(e.where(f"reading_id % 3 = {i}")) for i in range(3)]
    table = parts[0].unionByName(parts[1]).unionByName(parts[2])
    once = error_moments.merge(table, *error_moments.KEYS)
    close(once.select(*error_moments.moments(e).columns), error_moments.moments(e), error_moments.KEYS)
    empty = error_moments.error_metrics(error_moments.moments(e.limit(0))).collect()
    assert len(empty) == 1 and empty[0].n == 0 and empty[0].rmse is None


# --- slice rollup -------------------------------------------------------------------------------
SLICES = [{}, {"start_date": "2025-03-05", "end_date": "2025-08-11"}, {"day_names": ("Monday", "Sunday"), "hour_range": (6, 21)},
          {"start_date": "2025-03-05", "hour_range": (0, 5)}]


@pytest.mark.parametrize("which", SLICES)
def test_sliced_views_are_those_of_the_readings(spark, scratch, which):
    e = predictions(spark).drop("predicted")
    slice_rollup.write(slice_rollup.rollup(e), f"{scratch}/r")
    kept = slice_rollup.sliced(slice_rollup.read(spark, f"{scratch}/r"), **which)
    raw = filters.slicer_filter(e, **which).where("timestamp is not null")
    close(slice_rollup.daily_summary(kept), rollups.daily_summary(raw), ["date"])
    close(slice_rollup.avg_by_hour(kept), rollups.avg_by_hour(raw), ["hour"])
    close(slice_rollup.day_hour_distribution(kept), rollups.day_hour_distribution(raw), ["day_name", "hour"])
    close(slice_rollup.day_totals(kept), rollups.day_totals(raw), ["day_name"])
    close(slice_rollup.daily_cost_outage(kept), rollups.daily_cost_outage(raw), ["date"])
    close(slice_rollup.kpi_cards(kept), rollups.kpi_cards(raw), ["outage_hours"])


def test_dates_prune_folders_days_are_replaced_and_empty_slices_fall_back(spark, scratch):
    e = predictions(spark).drop("predicted")
    slice_rollup.write(slice_rollup.rollup(e), f"{scratch}/r")
    table = slice_rollup.read(spark, f"{scratch}/r")
    plan = slice_rollup.sliced(table, start_date="2025-03-05", end_date="2025-04-11")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "part_month" in plan.split("PartitionFilters")[1][:300]
    double = e.where("date = '2025-03-07'").withColumn("energy_consumption", F.col("energy_consumption") * 2)
    new = slice_rollup.replace_days(spark, f"{scratch}/r", slice_rollup.rollup(double), f"{scratch}/r2")
    want = e.where("date <> '2025-03-07'").unionByName(double)
    close(slice_rollup.daily_summary(new), rollups.daily_summary(want), ["date"])
    assert slice_rollup.with_fallback(table, start_date="1990-01-01", end_date="1990-12-31").count() == table.count()


# --- quarantine ---------------------------------------------------------------------------------
LINES = [
    ("House_1,2025-03-01 05:00:00,1.25,0,true", None), ("House_1,2025-03-01,1.25,0,false", None), ("House_2,,,,", None), (",2025-03-01 05:00:00,1e3,6,TRUE", None),
    ("House_1,yesterday,1.25,0,true", "timestamp unreadable"), ("House_1,2025-02-30 05:00:00,1,0,true", "timestamp unreadable"),
    ("House_1,2025-03-01 05:00:00,lots,0,true", "energy_consumption unreadable"), ("House_1,2025-03-01 05:00:00,NaN,0,true", "energy_consumption out of range"),
    ("House_1,2025-03-01 05:00:00,1.0,two,true", "load_shedding_stage unreadable"), ("House_1,2025-03-01 05:00:00,1.0,7,true", "load_shedding_stage out of range"),
    ("House_1,2025-03-01 05:00:00,1.0,-1,true", "load_shedding_stage out of range"), ("House_1,2025-03-01 05:00:00,1.0,0,maybe", "backup_power unreadable"),
    ("House_1,2025-03-01 05:00:00,1.0,0", "wrong number of fields"), ("House_1,2025-03-01 05:00:00,1.0,0,true,extra", "wrong number of fields"),
    ("just text", "wrong number of fields"), ("House_1,yesterday,lots,9,maybe", "timestamp unreadable"),
]


def test_every_line_is_a_reading_or_in_quarantine(spark, scratch):
    with open(f"{scratch}/readings.csv", "w") as f:
        f.write("household_id,timestamp,energy_consumption,load_shedding_stage,backup_power\n" + "\n".join(x for x, _ in LINES) + "\n")
    out = read_sorted(spark, f"{scratch}/readings.csv")
    want = [r for _, r in LINES if r]
    got = out.bad.collect()
    assert sorted(r.reason for r in got) == sorted(want) and out.good.count() == len(LINES) - len(want)
    assert all(r.file.endswith("readings.csv") for r in got)
    assert "House_1,2025-03-01 05:00:00,1.0,0,true,extra" in {r.line for r in got}
    assert {r.timestamp for r in got if r.reason == "timestamp unreadable"} == {"yesterday", "2025-02-30 05:00:00"}
    first = out.good.where("household_id = 'House_1'").orderBy("timestamp").collect()
    assert [r.timestamp for r in first] == [dt.datetime(2025, 3, 1), dt.datetime(2025, 3, 1, 5)] and first[1].backup_power is True
    write_quarantine(out.bad, f"{scratch}/q")
    back = spark.read.parquet(f"{scratch}/q")
    assert back.count() == len(want)
    counts = {r.reason: r.lines for r in counts_by_reason(out.bad).collect()}
    assert sum(counts.values()) == len(want) and counts["wrong number of fields"] == 3


def test_an_empty_file_has_neither(spark, scratch):
    open(f"{scratch}/e.csv", "w").close()
    out = read_sorted(spark, f"{scratch}/e.csv")
    assert out.good.count() == 0 and out.bad.count() == 0
