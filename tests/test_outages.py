"""Outage flags, transitions, rebound, overlay and expected load."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import readings_df
from wattspark.operators import outages
from wattspark.operators.baseline import with_expected_load

ROWS = [
    (1, "House_1", "2025-07-01 17:00", 1.0, 0, False),   # pre
    (2, "House_1", "2025-07-01 18:00", 0.1, 2, False),   # during
    (3, "House_1", "2025-07-01 19:00", 2.0, 0, False),   # post and pre (lone clear hour)
    (4, "House_1", "2025-07-01 20:00", 0.2, 4, False),   # during
    (5, "House_1", "2025-07-01 21:00", 3.0, 0, False),   # post
    (6, "House_1", "2025-07-01 22:00", 5.0, 0, False),   # normal
    (7, "House_2", "2025-07-01 00:00", 0.4, 6, True),    # outage at a household's first hour
    (8, "House_2", "2025-07-01 01:00", 4.0, 0, True),    # post
]


def test_flags(spark):
    f = outages.with_outage_flags(readings_df(spark, ROWS))
    got = {r.reading_id: (r.is_outage, r.before_outage, r.after_outage, r.post_load_shedding) for r in f.collect()}
    assert got[3] == (0, 1, 1, 1)
    assert got[1] == (0, 1, 0, 0) and got[6] == (0, 0, 0, 0) and got[7] == (1, 0, 0, 0) and got[8] == (0, 0, 1, 1)


def test_transition_and_rebound(spark):
    r = readings_df(spark, ROWS)
    t = outages.outage_transition(r).first()
    assert t.normal_kwh == pytest.approx(5.0)
    assert t.pre_outage_kwh == pytest.approx((1.0 + 2.0) / 2)
    assert t.during_outage_kwh == pytest.approx((0.1 + 0.2 + 0.4) / 3)
    assert t.post_outage_kwh == pytest.approx((2.0 + 3.0 + 4.0) / 3)
    assert t.pre_step == pytest.approx(t.pre_outage_kwh - t.normal_kwh)
    b = outages.rebound_effect(r).first()
    assert b.rebound_pct == pytest.approx((3.0 - 1.5) / 1.5 * 100)


def test_rebound_null_without_after_rows(spark):
    r = readings_df(spark, [(1, "House_1", "2025-01-01 00:00", 1.0, 0, False),
                            (2, "House_1", "2025-01-01 01:00", 1.0, 2, False)])
    assert outages.rebound_effect(r).first().rebound_pct is None


def test_overlay_later_entry_wins(spark):
    r = readings_df(spark, [(i, "House_1", f"2025-01-01 {h:02d}:30", 1.0, 0, False)
                            for i, h in enumerate([0, 1, 2, 3, 4, 5])])
    sched = spark.createDataFrame([(1, dt.datetime(2025, 1, 1, 1, 15), 3, 2),
                                   (2, dt.datetime(2025, 1, 1, 2, 45), 2, 5)],
                                  "seq long, start timestamp_ntz, hours int, stage int")
    got = {r.reading_id: r.load_shedding_stage for r in outages.overlay_schedule(r, sched).collect()}
    assert got == {0: 0, 1: 2, 2: 5, 3: 5, 4: 0, 5: 0}


def test_expected_load(spark):
    r = readings_df(spark, [
        (1, "House_4", "2025-07-01 19:00", 1.0, 0, True),   # winter evening: 1.5*1.4*1.8
        (2, "House_4", "2025-07-01 20:00", 1.0, 3, True),   # outage with backup: x (0.2+0.3*0.5)
        (3, "House_4", "2025-07-01 21:00", 1.0, 0, True),   # rebound: x (1+0.5*0.8)
        (4, "House_1", "2025-01-01 03:00", 1.0, 2, False),  # summer night outage, no backup: 0.8*1*0.5*0.05
        (5, "House_9", "2025-01-01 03:00", 1.0, 0, False),  # unknown household: null
        (6, "House_3", "2025-04-01 17:00", 1.0, 0, False),  # hour 17 falls through to 0.5; autumn 0.9
    ])
    got = {r.reading_id: r.predicted for r in with_expected_load(r).collect()}
    assert got[1] == pytest.approx(1.5 * 1.4 * 1.8)
    assert got[2] == pytest.approx(1.5 * 1.4 * 1.8 * 0.35)
    assert got[3] == pytest.approx(1.5 * 1.4 * 1.8 * 1.4)
    assert got[4] == pytest.approx(0.8 * 1.0 * 0.5 * 0.05)
    assert got[5] is None
    assert got[6] == pytest.approx(1.0 * 0.9 * 0.5)


def test_repartitioning_leaves_results_equal(spark):
    from wattspark.sources.adapters import orders_readings
    r = orders_readings(spark, "/root/testdata/sf0.001")
    a = outages.outage_transition(r).first()
    b = outages.outage_transition(r.repartition(7, F.col("reading_id"))).first()
    assert a == b
