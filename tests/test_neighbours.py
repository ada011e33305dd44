"""The bucketed neighbour lookup equals a plain per-household lag / lead."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import readings_df
from wattspark.operators.neighbours import neighbour_values


def _reference(df):
    w = Window.partitionBy("household_id").orderBy("timestamp", "reading_id")
    return df.select("reading_id", F.coalesce(F.lag("load_shedding_stage").over(w), F.lit(0)).alias("p"),
                     F.coalesce(F.lead("load_shedding_stage").over(w), F.lit(0)).alias("n"))


def test_matches_plain_window_random(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        h = rnd.choice(["House_1", "House_2", "House_3"])
        day = rnd.choice([1, 2, 3, 5, 9])          # gaps between days
        hour = rnd.choice([0, 5, 12, 23])          # repeated timestamps: ties broken by reading_id
        rows.append((i, h, f"2025-01-{day:02d} {hour:02d}:00", rnd.random(), rnd.choice([0, 0, 1, 4]), False))
    df = readings_df(spark, rows)
    got = neighbour_values(df, "load_shedding_stage", prev_name="p", next_name="n").select("reading_id", "p", "n")
    assert sorted(got.collect()) == sorted(_reference(df).collect())


def test_household_and_bucket_boundaries(spark):
    rows = [
        (1, "House_1", "2025-01-01 22:00", 1, 0, False),
        (2, "House_1", "2025-01-01 23:00", 1, 3, False),   # last of day 1
        (3, "House_1", "2025-01-04 00:00", 1, 0, False),   # first of day 4 (gap): prev = 3
        (4, "House_2", "2025-01-01 00:00", 1, 5, False),   # first of household: prev = 0
        (5, "House_2", "2025-01-01 01:00", 1, 0, False),
    ]
    df = readings_df(spark, rows)
    got = {r.reading_id: (r.p, r.n) for r in
           neighbour_values(df, "load_shedding_stage", prev_name="p", next_name="n").collect()}
    assert got == {1: (0, 3), 2: (0, 0), 3: (3, 0), 4: (0, 0), 5: (5, 0)}


def test_hot_day_is_cut_into_parts(spark):
    rows = [(i, "House_1", f"2025-01-01 {i % 24:02d}:{i // 24:02d}", 1, i % 3, False) for i in range(72)]
    df = readings_df(spark, rows)
    got = neighbour_values(df, "load_shedding_stage", prev_name="p", next_name="n", hot_rows=4)
    assert sorted(got.select("reading_id", "p", "n").collect()) == sorted(_reference(df).collect())


def test_rows_without_time_or_household_have_no_neighbours(spark):
    import datetime as dt
    t = dt.datetime(2025, 1, 1)
    rows = [(1, "House_1", t, 1.0, 2, False), (2, "House_1", None, 1.0, 3, False), (3, "House_1", t + dt.timedelta(hours=1), 1.0, 4, False),
            (4, None, t, 1.0, 5, False), (5, None, t, 1.0, 6, False)]
    df = spark.createDataFrame(rows, "reading_id long, household_id string, timestamp timestamp_ntz, energy_consumption double, "
                                     "load_shedding_stage int, backup_power boolean")
    got = neighbour_values(df, "load_shedding_stage", prev_name="p", next_name="n").collect()
    assert {r.reading_id: (r.p, r.n) for r in got} == {1: (0, 4), 2: (0, 0), 3: (2, 0), 4: (0, 0), 5: (0, 0)}


try:
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st
except ImportError:  # pragma: no cover
    given = None

if given is not None:
    _row = st.tuples(st.sampled_from(["House_1", "House_2"]), st.integers(0, 6), st.sampled_from([0, 11, 23]),
                     st.one_of(st.none(), st.integers(0, 6)))

    @settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(st.lists(_row, min_size=1, max_size=40))
    def test_property_equals_plain_window(spark, rows):
        """Any layout of households, days (with gaps), tied hours and null values."""
        data = [(i, h, f"2025-03-{d + 1:02d} {hr:02d}:00", 1.0, s, False) for i, (h, d, hr, s) in enumerate(rows)]
        import datetime as dt
        df = spark.createDataFrame(
            [(i, h, dt.datetime.strptime(t, "%Y-%m-%d %H:%M"), k, s, b) for i, h, t, k, s, b in data],
            "reading_id long, household_id string, timestamp timestamp_ntz, energy_consumption double, "
            "load_shedding_stage int, backup_power boolean")
        w = Window.partitionBy("household_id").orderBy("timestamp", "reading_id")
        cell = F.struct(F.col("load_shedding_stage").alias("v"))
        expected = df.select("reading_id",
                             F.when(F.lag(cell).over(w).isNull(), F.lit(0)).otherwise(F.lag(cell).over(w).v).alias("p"),
                             F.when(F.lead(cell).over(w).isNull(), F.lit(0)).otherwise(F.lead(cell).over(w).v).alias("n"))
        got = neighbour_values(df, "load_shedding_stage", prev_name="p", next_name="n", hot_rows=3).select("reading_id", "p", "n")
        assert sorted(got.collect()) == sorted(expected.collect())
