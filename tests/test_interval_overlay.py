import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattspark.operators import interval_overlay as io

T0 = dt.datetime(2025, 3, 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.integers(0, 5), st.integers(0, 6)), max_size=14))
def test_sweep_is_the_latest_entry_at_every_moment(raw):
    entries = [(lo, lo + n, seq, stage) for lo, n, seq, stage in raw]
    out = io.sweep(entries)
    assert all(a < b for a, b, _ in out) and all(x[1] <= y[0] for x, y in zip(out, out[1:]))
    for t in range(45):
        active = [(seq, stage) for lo, hi, seq, stage in entries if lo <= t < hi]
        assert [s for a, b, s in out if a <= t < b] == ([max(active)[1]] if active else [])


@pytest.mark.parametrize("crowded,small", [(512, 100_000), (5, 100_000), (2, 0)])
def test_overlay_is_brute_force(spark, monkeypatch, crowded, small):
    monkeypatch.setattr(io, "CROWDED", crowded)
    monkeypatch.setattr(io, "SMALL", small)
    rng = np.random.default_rng(3)
    schedule = []
    for i in range(150):
        # a third of the entries begin within one hour
        start = T0 + dt.timedelta(seconds=int(rng.integers(36_000, 39_600) if i % 3 == 0 else rng.integers(0, 90_000)), microseconds=int(rng.integers(0, 10 ** 6)))
        schedule.append((i, start, start + dt.timedelta(seconds=float(rng.choice([0.4, 30, 600, 5000, 40_000]))), int(rng.integers(0, 7))))
    schedule += [(900, T0, T0, 5), (901, None, T0, 5), (902, T0 + dt.timedelta(hours=1), T0, 5), (None, T0, T0 + dt.timedelta(days=9), 6), (903, T0, None, 1)]
    edges = [t for _, a, b, _ in schedule[:40] for t in (a, b)]
    times = edges + [T0 + dt.timedelta(seconds=float(rng.uniform(-4000, 100_000))) for _ in range(300)] + [None, T0, T0 - dt.timedelta(microseconds=1)]
    readings = [(i, t, 9, "x") for i, t in enumerate(times)]
    s = spark.createDataFrame(schedule, "seq long, start timestamp_ntz, end timestamp_ntz, stage int")
    r = spark.createDataFrame(readings, "reading_id long, timestamp timestamp_ntz, load_shedding_stage int, hour string")
    got = io.overlay(r, s)
    assert set(got.columns) == set(r.columns)
    valid = [(a, b, n, k) for n, a, b, k in schedule if n is not None and a and b and a < b]
    want = {i: (max([(n, k) for a, b, n, k in valid if a <= t < b], default=(0, 0))[1] if t else 0) for i, t, *_ in readings}
    assert {x.reading_id: x.load_shedding_stage for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_schedule_and_readings(spark):
    s = spark.createDataFrame([], "seq long, start timestamp_ntz, end timestamp_ntz, stage int")
    r = spark.createDataFrame([(1, T0, 4)], "reading_id long, timestamp timestamp_ntz, load_shedding_stage int")
    assert io.overlay(r, s).first().load_shedding_stage == 0
    assert io.overlay(r.limit(0), s).count() == 0


def test_entries_read_by_one_task_are_dealt_out_by_their_pieces(spark, monkeypatch):
    monkeypatch.setattr(io, "PIECES_A_TASK", 100)
    entries = [(i, T0 + dt.timedelta(minutes=7 * i), T0 + dt.timedelta(minutes=7 * i + 150), i % 6 + 1) for i in range(200)]
    schedule = spark.createDataFrame(entries, "seq long, start timestamp_ntz, end timestamp_ntz, stage int").coalesce(1)
    cut, made = io._cut, []
    monkeypatch.setattr(io, "_cut", lambda rows, width: (made.append(rows), cut(rows, width))[1])
    io.segments(schedule)
    sizes = made[0].rdd.glom().map(len).collect()
    assert sum(sizes) == 200 and len(sizes) >= 6 and max(sizes) <= 70  # over 600 pieces of hours
