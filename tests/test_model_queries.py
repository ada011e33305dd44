"""Model queries: how often they fit, score and group, on own orders and with small models."""

import datetime as dt
import threading

import pytest

from wattspark.models import training
from wattspark.plans import q_models


@pytest.fixture(scope="module")
def orders_folder(spark, tmp_path_factory):
    """1,200 orders over a year; every fifth is urgent."""
    sf = str(tmp_path_factory.mktemp("orders"))
    day = dt.datetime(1996, 1, 1)
    rows = [(i, i * 7 % 50, "O", 1000.0 + i * 137 % 90_000, day + dt.timedelta(days=i * 11 % 365), "1-URGENT" if i % 5 == 1 else "5-LOW")
            for i in range(1, 1201)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
                                "o_orderpriority string").write.parquet(f"{sf}/orders.parquet")
    return sf


@pytest.fixture()
def small_models(monkeypatch):
    boosted, forest = training.boosted_pipeline, training.forest_pipeline
    monkeypatch.setattr(training, "boosted_pipeline", lambda: boosted(maxIter=3, maxDepth=3))
    monkeypatch.setattr(training, "forest_pipeline", lambda: forest(numTrees=3, maxDepth=3))
    monkeypatch.setattr(q_models, "_CACHE", {})


def test_models_of_a_query_are_fitted_at_the_same_time(spark, orders_folder, small_models, monkeypatch):
    fit, both, fitted = training.fit, threading.Barrier(2), []

    def meeting(pipeline, train):
        both.wait(60)  # broken unless the other fit begins before this one ends
        fitted.append(type(pipeline.getStages()[-1]).__name__)
        return fit(pipeline, train)
    monkeypatch.setattr(training, "fit", meeting)
    rows = q_models._compare(spark, orders_folder, "boosted", "forest").collect()
    assert [r["model"] for r in rows] == ["Gradient Boosting", "Random Forest"]
    q_models._compare(spark, orders_folder, "boosted", "forest").collect()
    assert sorted(fitted) == ["GBTRegressor", "RandomForestRegressor"]
    assert sum(kind == "features" for _, _, kind in q_models._CACHE) == 1


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_feature_table_is_scored_as_it_is(spark, orders_folder, small_models):
    from wattspark.models import scoring
    from wattspark.plans.registry import orders
    own = q_models.q_score_readings(spark, orders_folder)
    assert "Window" not in plan(own)  # the neighbours were looked up for the feature table
    model = q_models._model(spark, orders_folder, "boosted")
    again = scoring.score_readings(model, orders(spark, orders_folder)).select(*own.columns)
    assert own.count() == 1200 and own.exceptAll(again).isEmpty() and again.exceptAll(own).isEmpty()


@pytest.mark.parametrize("name", ["histogram", "analytics_counts"])
def test_predictions_are_written_once(spark, orders_folder, small_models, name):
    found = getattr(q_models, f"q_model_{name}")(spark, orders_folder)
    assert "UDF" not in plan(found)  # no reading is scored anew
    rows = found.collect()
    assert sum(r["count"] for r in rows) == 1200 if name == "histogram" else {r["what"]: r["n"] for r in rows}["histogram rows"] == 1200
    stored, computed = q_models._scored(spark, orders_folder).select("reading_id", "predicted"), q_models._predicted(spark, orders_folder)
    assert stored.exceptAll(computed.select("reading_id", "predicted")).isEmpty()


def test_routed_rows_are_grouped_once(spark, orders_folder, small_models, monkeypatch):
    from wattspark.plans import q_stored
    read = []
    stored = q_stored._stored
    monkeypatch.setattr(q_stored, "_stored", lambda df, name: read.append(name) or stored(df, name))
    found = q_stored.q_boosted_routed(spark, orders_folder)
    assert read.count("vectors") == 1
    assert "energy_consumption" not in plan(found)  # no reading is read by the query itself
    row = found.first()
    assert (row["train_rows"], row["all_rows"], row["largest_difference"]) == (960, 1200, 0.0)


@pytest.mark.parametrize("few", [10 ** 6, 100])
def test_node_tables_need_no_forest_on_the_driver(spark, orders_folder, small_models, monkeypatch, few):
    """The trees of a forest are saved and let go, at most three at a time; a forest of few rows, once saved."""
    from wattspark.plans import q_stored
    monkeypatch.setattr(training, "FEW_ROWS", few)
    held, most, lock, grow = set(), [0], threading.Lock(), training._saved_tree

    def saved(tree, path, i):
        with lock:
            held.add(i)
            most[0] = max(most[0], len(held))
        depth = grow(tree, path, i)
        with lock:
            held.discard(i)
        return depth
    monkeypatch.setattr(training, "_saved_tree", saved)
    monkeypatch.setattr(training, "_forest", lambda *a: pytest.fail("a whole forest is put together"))
    rows = {(r["model"], r["tree"]): r["train_rows"] for r in q_stored.q_tree_leaf_rows(spark, orders_folder).collect()}
    assert rows == {(kind, i): 960 for kind in ("boosted", "forest") for i in range(3)}
    effect = {r["model"]: r for r in q_stored.q_min_split_effect(spark, orders_folder).collect()}
    assert set(effect) == {"boosted", "forest"} and effect["forest"]["inner_nodes"] > 0 and effect["forest"]["too_small_after"] == 0
    assert not [k for k in q_models._CACHE if k[2] == "forest"] and most[0] <= training.SAVED_AT_ONCE


def test_a_fitted_forest_is_saved_and_not_fitted_again(spark, orders_folder, small_models, monkeypatch):
    from wattspark.plans import q_stored
    q_models._model(spark, orders_folder, "forest")
    monkeypatch.setattr(training, "fit_saved_forest", lambda *a: pytest.fail("the forest is fitted again"))
    assert q_stored.q_tree_leaf_rows(spark, orders_folder).where("model = 'forest' and train_rows = 960").count() == 3
