"""Scalar expressions: every boundary of every band."""

from pyspark.sql import functions as F

from wattspark import constants as C
from wattspark.functions import calendar as cal
from wattspark.functions import labels as lab


def _eval(spark, values, expr_fn, dtype="int"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr_fn(F.col("x"))).collect()]


def test_outage_severity_edges(spark):
    got = _eval(spark, [-1, 0, 1, 2, 3, 4, 5, 6, 7], lab.outage_severity)
    assert got == [None, "No Outage", "Low (1-2)", "Low (1-2)", "Medium (3-4)", "Medium (3-4)",
                   "High (5-6)", "High (5-6)", None]


def test_time_period_edges(spark):
    got = _eval(spark, [5, 6, 8, 9, 16, 17, 20, 21, 22], cal.time_period)
    assert got == ["Off-Peak", "Morning Peak", "Morning Peak", "Daytime", "Daytime", "Evening Peak",
                   "Evening Peak", "Off-Peak", "Off-Peak"]


def test_bi_peak_edges(spark):
    got = _eval(spark, [6, 7, 10, 11, 16, 17, 21, 22], cal.bi_peak_label)
    assert got == ["Off-Peak", "Morning Peak", "Morning Peak", "Off-Peak", "Off-Peak", "Evening Peak",
                   "Evening Peak", "Off-Peak"]


def test_season_every_month(spark):
    got = _eval(spark, list(range(1, 13)), cal.season)
    assert got == ["Summer", "Summer", "Autumn", "Autumn", "Autumn", "Winter", "Winter", "Winter",
                   "Spring", "Spring", "Spring", "Summer"]


def test_month_of_season_default(spark):
    got = _eval(spark, ["Winter", "Summer", "Spring", "Autumn", "Monsoon"], cal.month_of_season, "string")
    assert got == [7, 1, 10, 4, 1]


def test_categories(spark):
    assert _eval(spark, [0.49, 0.5, 0.99, 1.0, 1.49, 1.5], lab.category_fixed, "double") == \
        ["Low", "Normal", "Normal", "Above Average", "Above Average", "High"]
    assert _eval(spark, [1.99, 2.0, 2.49, 2.5], lab.category_bi, "double") == ["Low", "Medium", "Medium", "High"]
    df = spark.createDataFrame([(0.69, "Summer", 12), (0.7, "Summer", 12), (0.97, "Winter", 12),
                                (0.99, "Winter", 12), (1.46, "Winter", 19), (1.48, "Winter", 19),
                                (3.14, "Winter", 21), (3.16, "Winter", 21)], "k double, s string, h int")
    got = [r[0] for r in df.select(lab.category_seasonal("k", "s", "h")).collect()]
    assert got == ["Low", "Normal", "Low", "Normal", "Low", "Normal", "Normal", "High"]


def test_pct_error_floor_and_errors(spark):
    df = spark.createDataFrame([(0.0, 0.5), (2.0, 1.5)], "energy_consumption double, predicted double")
    got = df.select(lab.pct_error(), lab.abs_error(), lab.residual()).collect()
    assert abs(got[0][0] - 5000.0) < 1e-9 and abs(got[1][0] - 25.0) < 1e-9
    assert got[0][1] == 0.5 and got[1][2] == 0.5


def test_explanation_and_labels(spark):
    df = spark.createDataFrame([("Low", 12, "weekday", "Spring", 0, False),
                                ("High", 19, "Weekend", "Winter", 3, True),
                                ("Normal", 7, "weekday", "Summer", 2, False)],
                               "c string, h int, d string, s string, st int, b boolean")
    got = [r[0] for r in df.select(lab.explanation("c", "h", "d", "s", "st", "b")).collect()]
    assert got[0] == "Low consumption expected due to: standard conditions"
    assert got[1] == ("High consumption expected due to: evening peak time + winter season (higher heating demand)"
                      " + electricity outage (Stage 3) + backup power available during outage"
                      " + weekend (different consumption pattern)")
    assert got[2] == ("Normal consumption expected due to: morning peak time + summer season (lower heating, "
                      "more cooling) + electricity outage (Stage 2)")
    assert _eval(spark, [0, 3], lambda c: lab.stage_label(c, "Normal")) == ["Normal", "Stage 3"]


def test_feature_family(spark):
    fam = dict(zip(C.FEATURES, _eval(spark, list(C.FEATURES), lab.feature_family, "string")))
    assert fam["hour"] == "time" and fam["dow_sin"] == "other" and fam["is_weekend"] == "time"
    assert fam["day_of_week"] == "time" and fam["month"] == "season" and fam["season_Winter"] == "season"
    assert fam["post_load_shedding"] == "outage" and fam["has_backup_power"] == "outage"
    assert fam["household_House_3"] == "household"


def test_tariff(spark):
    df = spark.createDataFrame([(1.0, "Morning Peak"), (1.0, "Daytime"), (2.0, "Evening Peak"), (1.0, "Off-Peak")],
                               "energy_consumption double, time_period string")
    got = [r[0] for r in df.select(lab.estimated_cost()).collect()]
    assert got == [2.85, 1.45, 5.7, 1.45]


def test_order_key_sorts_like_timestamp_then_id(spark):
    import datetime as dt
    from wattspark.functions.ordering import order_key
    rows = [(dt.datetime(1969, 12, 31, 23, 59, 59, 999999), 5), (dt.datetime(1970, 1, 1), -3),
            (dt.datetime(2024, 1, 1, 0, 0, 7, 179575), 2), (dt.datetime(2024, 1, 1, 0, 0, 7, 179575), 1),
            (dt.datetime(2024, 1, 1, 0, 0, 7, 179576), -9), (dt.datetime(1899, 6, 1, 12), 9_000_000_000_000_000_000)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, reading_id long")
    by_key = [(r.timestamp, r.reading_id) for r in df.orderBy(order_key()).collect()]
    assert by_key == sorted(rows)
    plan = df.groupBy().agg(F.min_by(F.col("reading_id") > 0, order_key()))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "SortAggregate" not in plan
