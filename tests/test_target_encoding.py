import numpy as np
import pytest
from pyspark.sql import functions as F

from wattspark.operators import target_encoding as te


def brute(rows, folds=te.FOLDS, weight=te.WEIGHT):
    """rows: (reading_id, household, label, split) -> {reading_id: encoding}, plainly."""
    out = {}
    for i, h, _, split in rows:
        fold = (i // 5) % folds if split == "train" else None
        seen = [(g, y) for j, g, y, s in rows if s == "train" and y is not None and (fold is None or (j // 5) % folds != fold)]
        if not seen:
            out[i] = None
            continue
        mean = sum(y for _, y in seen) / len(seen)
        own = [y for g, y in seen if g == h and h is not None]
        out[i] = (sum(own) + weight * mean) / (len(own) + weight)
    return out


def corpus(n=600):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        house = "hot" if i % 3 == 0 else f"h{int(rng.integers(0, 80))}"
        rows.append((i, None if i % 50 == 7 else house, None if i % 41 == 3 else float(rng.normal()), "test" if i % 5 == 0 else "train"))
    return rows + [(5000, "never seen", 1.0, "test"), (5005, "never seen", None, "test")]


@pytest.mark.parametrize("hot_rows", [100_000, 20])
def test_encoding_is_brute_force(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(te, "HOT_ROWS", hot_rows)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "reading_id long, household_id string, energy_consumption double, split string, n string")
    got = te.with_encoding(df, df.where("split = 'train'"))
    assert got.columns == [*df.columns, "household_encoding"]
    got = {r.reading_id: r.household_encoding for r in got.collect()}
    want = brute(rows)
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_without_training_rows(spark):
    df = spark.createDataFrame(corpus(20), "reading_id long, household_id string, energy_consumption double, split string")
    out = te.with_encoding(df, df.where("1 = 0"))
    assert out.count() == df.count() and out.where("household_encoding is not null").count() == 0
    assert te.with_encoding(df.limit(0), df.where("split = 'train'")).count() == 0


def test_no_household_reaches_the_driver_and_hot_ones_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(te, "HOT_ROWS", 20)
    df = spark.createDataFrame(corpus(), "reading_id long, household_id string, energy_consumption double, split string")
    plan = te.with_encoding(df, df.where("split = 'train'"))._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
