"""Rollups, guards, pivots and exact quantiles (A*, F1-F3, J2, W7-W9, A20, A26)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import readings_df
from wattspark.operators import filters, reshape, rollups, trends
from wattspark.operators.enrich import enrich
from wattspark.operators.quantiles import grouped_quantiles


def _days(spark, n, kwh=lambda d: float(d)):
    start = dt.date(2025, 1, 1)
    rows = [(d, "House_1", (start + dt.timedelta(days=d)).strftime("%Y-%m-%d 12:00"), kwh(d), d % 2, False)
            for d in range(n)]
    return enrich(readings_df(spark, rows))


def test_forecast_needs_seven_days(spark):
    assert trends.forecast_7d(_days(spark, 6)).count() == 0
    out = trends.forecast_7d(_days(spark, 9)).orderBy("forecast_date").collect()
    assert len(out) == 7 and out[0].forecast_date == dt.date(2025, 1, 10)
    assert out[0].forecast_kwh == pytest.approx(np.mean(range(2, 9)))


def test_trend_needs_more_than_ten_days(spark):
    few = trends.cost_outage_trend(rollups.daily_cost_outage(_days(spark, 10))).first()
    assert few.slope is None and few.days == 10
    many = trends.cost_outage_trend(rollups.daily_cost_outage(_days(spark, 11))).first()
    assert many.slope is not None


def test_moving_average_null_until_full(spark):
    out = trends.moving_averages(_days(spark, 8)).orderBy("date").collect()
    assert [r.ma7_kwh is None for r in out] == [True] * 6 + [False, False]
    assert out[6].ma7_kwh == pytest.approx(3.0) and all(r.ma30_kwh is None for r in out)


def test_peak_hour_tie_takes_earliest(spark):
    rows = [(1, "House_1", "2025-01-06 08:00", 2.0, 0, False), (2, "House_1", "2025-01-06 03:00", 2.0, 0, False),
            (3, "House_1", "2025-01-06 05:00", 1.0, 0, False)]
    got = trends.daily_peak_hour(enrich(readings_df(spark, rows))).first()
    assert (got.day_name, got.peak_hour) == ("Monday", 3)


def test_slicer_and_fallback(spark):
    e = _days(spark, 10)
    assert filters.slicer_filter(e, start_date="2025-01-02", end_date="2025-01-04").count() == 3
    assert filters.slicer_filter(e, day_names=("Monday",)).count() == 1  # only 2025-01-06
    assert filters.slicer_filter(e, start_date="2025-01-08").count() == 3        # open end: up to the max
    assert filters.slicer_filter(e, end_date="2025-01-02", hour_range=(12, 12)).count() == 2
    assert filters.slicer_with_fallback(e, start_date="2030-01-01", end_date="2030-12-31").count() == 10
    assert filters.slicer_with_fallback(e, start_date="2025-01-02", end_date="2025-01-02").count() == 1


def test_backup_effect_missing_side_reads_zero(spark):
    rows = [(1, "House_1", "2025-01-01 00:00", 1.0, 0, False), (2, "House_1", "2025-01-01 01:00", 3.0, 2, False)]
    out = {r.stage: (r.no_backup_kwh, r.with_backup_kwh) for r in rollups.backup_effect(readings_df(spark, rows)).collect()}
    assert out == {0: (1.0, 0.0), 2: (3.0, 0.0)}


def test_heatmap_has_every_day(spark):
    out = reshape.heatmap_day_hour(_days(spark, 3)).collect()
    assert [r.day_name for r in out] == ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    assert out[0].h12 is None and out[2].h12 == 0.0  # 2025-01-01 is a Wednesday


def test_household_first_backup_and_nulls(spark):
    rows = [(2, "House_1", "2025-01-01 01:00", 1.0, 0, True), (1, "House_1", "2025-01-01 00:00", 3.0, 0, False)]
    df = readings_df(spark, rows).unionByName(readings_df(spark, [(3, "House_1", "2025-01-01 02:00", 1.0, 0, True)])
                                              .withColumn("household_id", F.lit(None).cast("string")))
    out = rollups.household_stats(df).collect()
    assert len(out) == 1 and out[0].backup_power is False and out[0].mean_kwh == 2.0


def test_exact_quantiles_match_numpy_with_hot_group(spark):
    rnd = np.random.default_rng(3)
    hot = rnd.exponential(1.0, 3000)            # one group holds most rows
    cold = rnd.normal(5, 1, 40)
    data = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("one", 2.5)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in grouped_quantiles(df, "g", "v", {"q1": 0.25, "med": 0.5, "q3": 0.75}).collect()}
    for name, arr in (("hot", hot), ("cold", cold), ("one", np.array([2.5]))):
        for col, p in (("q1", 25), ("med", 50), ("q3", 75)):
            assert getattr(got[name], col) == pytest.approx(np.percentile(arr, p), rel=1e-12, abs=1e-12)


def test_shares_sum_to_totals(spark):
    from wattspark.sources.adapters import orders_readings
    e = enrich(orders_readings(spark, "/root/testdata/sf0.001"))
    total = rollups.kpi_cards(e).first().total_kwh
    by_day = sum(r.total_kwh for r in rollups.day_totals(e).collect())
    s = rollups.peak_shift_savings(e).first()
    assert by_day == pytest.approx(total) and s.peak_kwh + s.offpeak_kwh == pytest.approx(total)


def test_null_group_keys_are_left_out(spark):
    base = readings_df(spark, [(1, "House_1", "2025-01-01 00:00", 1.0, 0, False),
                               (2, "House_1", "2025-01-01 01:00", 2.0, 3, False)])
    nulls = base.limit(1).select(F.lit(9).cast("long").alias("reading_id"), F.lit("House_2").alias("household_id"),
                                 F.lit(None).cast("timestamp_ntz").alias("timestamp"),
                                 F.lit(5.0).alias("energy_consumption"),
                                 F.lit(None).cast("int").alias("load_shedding_stage"), F.lit(True).alias("backup_power"))
    e = enrich(base.unionByName(nulls))
    assert [(r.date, r.total_kwh) for r in rollups.daily_summary(e).collect()] == [(dt.date(2025, 1, 1), 3.0)]
    assert sorted(r.stage for r in rollups.stage_impact(e).collect()) == [0, 3]
    assert rollups.kpi_cards(e).first().total_kwh == 8.0   # global aggregates keep every row


def test_quantiles_many_groups_without_broadcast_hint(spark):
    rnd = np.random.default_rng(11)
    data = [(f"g{g}", float(v)) for g in range(40) for v in rnd.gamma(2.0, 1.0, 25 + g)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r.med for r in grouped_quantiles(df, "g", "v", {"med": 0.5}).collect()}
    for g in range(40):
        arr = np.array([v for k, v in data if k == f"g{g}"])
        assert got[f"g{g}"] == pytest.approx(np.median(arr), rel=1e-12)


def test_season_box_approximate_is_close(spark):
    from wattspark.operators.quantiles import season_box
    from wattspark.sources.adapters import orders_readings
    e = enrich(orders_readings(spark, "/root/testdata/sf0.001"))
    exact = {r.season: r for r in season_box(e).collect()}
    approx = {r.season: r for r in season_box(e, approximate=True).collect()}
    assert set(exact) == set(approx)
    for s in exact:
        assert abs(exact[s].median_kwh - approx[s].median_kwh) < 0.05


def test_histogram_and_normal_fit_formulas(spark):
    from wattspark.operators import errors
    rnd = np.random.default_rng(5)
    actual = rnd.normal(1.0, 0.3, 500)
    pred = np.full(500, 1.0)
    df = spark.createDataFrame([(float(a), float(p)) for a, p in zip(actual, pred)],
                               "energy_consumption double, predicted double")
    res = actual - pred
    counts, edges = np.histogram(res, bins=50)
    h = sorted((r["bin"], r["count"]) for r in errors.residual_histogram(df).collect())
    got = np.zeros(50, dtype=int)
    for b, c in h:
        got[b] = c
    assert (got == counts).all()
    fit = sorted(errors.residual_normal_fit(df).collect(), key=lambda r: r.point)
    x = np.linspace(res.min(), res.max(), 100)
    sd = res.std(ddof=1)
    pdf = np.exp(-0.5 * ((x - res.mean()) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))
    want = pdf * len(res) * (res.max() - res.min()) / 50
    assert np.allclose([r.density for r in fit], want, rtol=1e-9) and np.allclose([r.x for r in fit], x)


def test_quantiles_do_not_depend_on_caching_or_reuse(spark):
    from wattspark.operators.quantiles import grouped_quantiles
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"),
                                      F.when(F.col("id") % 5 < 3, F.lit(0.0)).otherwise((F.hash("id") % 1000) / F.lit(7.0)).alias("v"))
    probs = {"q1": 0.25, "m": 0.5, "q3": 0.75, "hi": 0.999}
    want = {r.g: [round(x, 9) for x in r.p] for r in rows.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs.values()])).alias("p")).collect()}
    for key in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled"):
        spark.conf.set(key, "false")
    try:
        for df in (rows, rows.cache()):
            got = {r.g: [round(r[n], 9) for n in probs] for r in grouped_quantiles(df, "g", "v", probs).collect()}
            assert got == want
    finally:
        for key in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)
        rows.unpersist()


def test_errors_look_at_scored_readings_only(spark):
    from wattspark.operators import errors
    cols = "energy_consumption double, predicted double, timestamp timestamp_ntz"
    import datetime as dt
    t = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(1.0, 2.0, t), (3.0, 1.0, t), (2.0, None, t), (None, 5.0, t)], cols)
    m = errors.error_metrics(df).first()
    assert (m.n, m.n_unscored, round(m.r2, 9)) == (2, 2, round(1 - 5 / 2, 9))
    h = [r["count"] for r in errors.residual_histogram(df, 5).orderBy("bin").collect()]
    assert h == [1, 0, 0, 0, 1]
    same = spark.createDataFrame([(1.0, 2.0, t), (2.0, 3.0, t)], cols)
    assert [r["count"] for r in errors.residual_histogram(same, 3).orderBy("bin").collect()] == [2, 0, 0]
    assert errors.residual_histogram(df.where("predicted is null"), 5).count() == 0
    b = errors.prediction_bands(df).first()
    assert (b.actual, b.predicted) == (4.0, 3.0)
