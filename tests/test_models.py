"""Features, training, persistence and scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattspark import constants as C
from wattspark.models import scoring, training, trees
from wattspark.operators.baseline import with_expected_load
from wattspark.operators.errors import error_metrics
from wattspark.operators.features import feature_matrix, with_features
from wattspark.operators.requests import parse_requests, request_features, validate_requests
from wattspark.operators.sampling import sample_fixed_n, train_test_split
from wattspark.sources.adapters import orders_readings

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def noiseless(spark):
    """Orders readings whose label is the deterministic expected load: learnable without noise."""
    r = orders_readings(spark, SF)
    r = with_expected_load(r).withColumn("energy_consumption", F.col("predicted")).drop("predicted")
    f = train_test_split(with_features(r)).cache()
    yield f
    f.unpersist()


def test_feature_matrix_columns(spark):
    fm = feature_matrix(orders_readings(spark, "/root/testdata/sf0.001"))
    assert fm.columns == ["reading_id", *C.FEATURES, C.LABEL]
    row = fm.agg(*[F.sum(f"season_{s}").alias(s) for s in C.SEASONS],
                 F.sum(sum(F.col(f"household_{h}") for h in C.HOUSEHOLDS)).alias("hh"), F.count("*").alias("n")).first()
    assert sum(row[s] for s in C.SEASONS) == row.n and row.hh == row.n


def test_ols_matches_lstsq(spark, noiseless):
    train = noiseless.where("split = 'train'")
    model = training.fit(training.linear_pipeline(), train)
    pdf = model.transform(train).select(*C.FEATURES, C.LABEL, "predicted").toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf[list(C.FEATURES)].to_numpy(float)])
    coef, *_ = np.linalg.lstsq(X, pdf[C.LABEL].to_numpy(), rcond=None)
    assert np.max(np.abs(X @ coef - pdf["predicted"].to_numpy())) < 1e-5
    assert error_metrics(model.transform(noiseless.where("split = 'test'"))).first().r2 > 0.5


def test_trees_learn_noiseless_target(spark, noiseless):
    train, test = noiseless.where("split = 'train'"), noiseless.where("split = 'test'")
    forest = training.fit(training.forest_pipeline(numTrees=20, maxDepth=8), train)
    boosted = training.fit(training.boosted_pipeline(maxIter=20, maxDepth=5), train)
    assert error_metrics(forest.transform(test)).first().r2 > 0.99
    assert error_metrics(boosted.transform(test)).first().r2 > 0.99
    imp = training.importances(forest, spark).orderBy("rank").collect()
    assert len(imp) == 21 and imp[0].importance >= imp[1].importance
    assert sum(r.importance for r in imp) == pytest.approx(1.0)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    cmp = training.compare({"forest": forest, "boosted": boosted}, both).collect()
    assert [x.asDict() for x in cmp] == [
        {k: pytest.approx(v) if isinstance(v, float) else v for k, v in training.evaluate(m, train, test, n).first().asDict().items()}
        for m, n in ((forest, "Random Forest"), (boosted, "Gradient Boosting"))]
    assert [r.model for r in cmp] == ["Random Forest", "Gradient Boosting"]


def test_save_load_roundtrip(spark, noiseless, scratch):
    model = training.fit(training.linear_pipeline(), noiseless.where("split = 'train'"))
    path = f"{scratch}/linear"
    training.save(model, path)
    again = training.load(path)
    a = model.transform(noiseless).select("reading_id", "predicted").orderBy("reading_id").limit(50).collect()
    b = again.transform(noiseless).select("reading_id", "predicted").orderBy("reading_id").limit(50).collect()
    assert a == b
    with pytest.raises(FileNotFoundError):
        training.load(f"{scratch}/missing")


def _requests(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")


def test_request_defaults_and_validation(spark):
    bodies = ['{}', '{"hour": 24}', '{"day_type": "WEEKEND", "season": "Winter"}', '{"season": "winter"}',
              '{"load_shedding_stage": 7}', '{"household_id": "House_6"}', 'not json',
              '{"hour": 18, "day_type": "weekday", "season": "Winter", "load_shedding_stage": 0,'
              ' "has_backup_power": false}']
    out = validate_requests(parse_requests(_requests(spark, bodies))).orderBy("request_id").collect()
    assert (out[0].hour, out[0].day_type, out[0].season, out[0].load_shedding_stage, out[0].has_backup_power,
            out[0].household_id, out[0].error) == (12, "weekday", "Summer", 0, False, "House_1", None)
    assert out[1].error == "hour must be 0-23"
    assert out[2].error is None and out[2].day_type == "weekend"
    assert out[3].error == "season must be Winter, Summer, Spring, or Autumn"
    assert out[4].error == "load_shedding_stage must be 0-6"
    assert out[5].error == "household_id must be House_1 to House_5"
    assert out[6].error == "Invalid JSON in request body"
    assert out[7].is_valid
    feats = request_features(validate_requests(parse_requests(_requests(spark, [bodies[2]])))).first()
    assert (feats.day_of_week, feats.is_weekend, feats.month, feats.season_Winter, feats.household_House_1) == \
        (5, 1, 7, 1, 1)


def test_score_requests_and_grid(spark, noiseless):
    train = noiseless.where("split = 'train'")
    boosted = training.fit(training.boosted_pipeline(maxIter=5, maxDepth=3), train)
    forest = training.fit(training.forest_pipeline(numTrees=5, maxDepth=4), train)
    reqs = _requests(spark, ['{"hour": 18, "day_type": "weekday", "season": "Winter"}', '{"hour": -1}'])
    out = scoring.score_requests(boosted, forest, reqs).orderBy("request_id").collect()
    assert out[0].status == "success" and out[0].prediction.expected_consumption_kwh >= 0
    assert out[0].prediction.explanation.startswith(out[0].prediction.consumption_category)
    assert len(out[0].top_drivers) == 3
    assert out[1].status == "error" and out[1].error == "hour must be 0-23" and out[1].prediction is None
    grid = scoring.score_scenarios(boosted, scoring.scenario_grid(spark))
    assert grid.count() == 1344
    assert grid.select("hour", "season", "load_shedding_stage", "has_backup_power").distinct().count() == 1344


def test_sample_is_repeatable(spark):
    r = orders_readings(spark, SF)
    a = sorted(x.reading_id for x in sample_fixed_n(r, 100).collect())
    b = sorted(x.reading_id for x in sample_fixed_n(r.repartition(5), 100).collect())
    assert len(a) == 100 and a == b


def test_pipeline_plans(spark, scratch):
    from wattspark.plans.pipeline import dashboard_views, train_and_evaluate
    r = orders_readings(spark, "/root/testdata/sf0.001")
    models, cmp = train_and_evaluate(r, model_dir=f"{scratch}/models", forest_params={"numTrees": 3, "maxDepth": 3},
                                     boosted_params={"maxIter": 3, "maxDepth": 3})
    assert cmp.count() == 3 and set(models) == {"linear", "forest", "boosted"}
    assert training.load(f"{scratch}/models/boosted") is not None
    views = dashboard_views(r, start_date="1996-01-01", end_date="1996-12-31", hour_range=(6, 21))
    assert views["daily_summary"].count() > 0 and views["heatmap_day_hour"].count() == 7
    assert spark.conf.get("spark.checkpoint.dir")


def test_request_values_are_coerced_or_rejected(spark):
    bodies = ['{"hour":"18"}', '{"hour":"abc"}', '{"hour":18.9}', '{"load_shedding_stage":"5"}', '{"load_shedding_stage":99999999999}',
              '{"has_backup_power":"true"}', '{"has_backup_power":1}', '{"hour":null}', '{"has_backup_power":0}', '{"season":null}',
              '{"hour":-1}', '{"hour":" 7 "}', '{"day_type":5}', '[]', 'nope', '{}', None, '{"has_backup_power":[]}', '{"hour":true}']
    out = validate_requests(parse_requests(_requests(spark, bodies)))
    got = [(r.error, r.hour, r.load_shedding_stage, r.has_backup_power) for r in out.orderBy("request_id").collect()]
    cannot, stage = "hour cannot be read", "load_shedding_stage must be 0-6"
    assert [g[0] for g in got] == [None, cannot, None, None, stage, None, None, cannot, None, "season must be Winter, Summer, Spring, or Autumn",
                                   "hour must be 0-23", None, "day_type cannot be read", "Invalid JSON in request body",
                                   "Invalid JSON in request body", None, "Invalid JSON in request body", None, None]
    assert (got[0][1], got[2][1], got[3][2], got[5][3], got[6][3], got[8][3], got[11][1], got[15][1], got[17][3], got[18][1]) == (
        18, 18, 5, True, True, False, 7, 12, False, 1)


def test_a_body_is_decoded_once(spark):
    from wattspark.sources.adapters import requests_from_events
    feats = request_features(validate_requests(parse_requests(requests_from_events(spark, "/root/testdata/sf0.001"))).where("is_valid"))
    plan = feats._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("get_json_object") == 1


def test_open_households_are_learned_and_unseen_ones_are_zero(spark):
    from wattspark.operators.features import open_household_stages
    from pyspark.ml import Pipeline
    r = with_features(orders_readings(spark, "/root/testdata/sf0.001"))
    users = r.withColumn("household_id", F.concat(F.lit("User_"), (F.col("reading_id") % 9).cast("string")))
    prepared = Pipeline(stages=open_household_stages()).fit(users.where("household_id <> 'User_8'"))
    rows = prepared.transform(users).select("household_id", "features").collect()
    fixed = len([f for f in C.FEATURES if not f.startswith("household_")])
    for row in rows:
        hot = [i for i, v in enumerate(row.features.toArray()[fixed:]) if v]
        assert hot == ([] if row.household_id == "User_8" else [int(row.household_id[-1])])
    model = training.fit(training.linear_pipeline(open_households=True), users)
    assert model.transform(users).where("predicted is null").count() == 0


def test_a_rewritten_folder_is_fitted_anew(spark, tmp_path):
    """The state comes from the listing: an even number of rows, and files of the same size, make no difference."""
    from wattspark.plans import q_models
    src = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(200)
    path = f"{tmp_path}/orders.parquet"
    src.write.parquet(path)
    made = []
    for factor in (1, 1, 2, 2):
        if factor == 2 and len(made) == 1:
            src.withColumn("o_totalprice", F.col("o_totalprice") * 2).write.mode("overwrite").parquet(path)
        q_models._once(spark, str(tmp_path), "probe", lambda: made.append(factor))
    assert made == [1, 2]


def test_requests_are_decoded_in_one_pass(spark, noiseless):
    """Accepted and rejected requests come out of one scan, and each body is parsed once."""
    from wattspark.sources.adapters import requests_from_events
    small = noiseless.where("split = 'train'").limit(500)
    forest = training.fit(training.forest_pipeline(numTrees=2, maxDepth=2), small)
    out = scoring.score_requests(training.fit(training.linear_pipeline(), small), forest, requests_from_events(spark, SF))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    assert {r.status for r in out.select("status").distinct().collect()} == {"success", "error"}
    assert out.where("status = 'error' and (prediction is not null or error is null)").count() == 0


@pytest.mark.parametrize("kind", ["forest", "boosted"])
@pytest.mark.parametrize("broadcast", [10 ** 6, 0])
def test_routed_vectors_predict_what_the_model_does(spark, noiseless, scratch, monkeypatch, kind, broadcast):
    from wattspark.models import trees
    monkeypatch.setattr(trees, "BROADCAST_NODES", broadcast)
    train = noiseless.where("split = 'train'").limit(1500)
    pipe = training.forest_pipeline(numTrees=4, maxDepth=6) if kind == "forest" else training.boosted_pipeline(maxIter=4, maxDepth=4)
    model = training.fit(pipe, train)
    training.save(model, f"{scratch}/m")
    nodes = trees.node_table(spark, f"{scratch}/m")
    n, depth = trees.shape(model)
    vecs = trees.vectors(train)
    got = {tuple(r.x): r.predicted for r in trees.predictions(vecs, nodes, n, depth, mean=kind == "forest").collect()}
    for r in model.transform(train).select(*C.FEATURES, "predicted").collect():
        assert got[tuple(float(r[f]) for f in C.FEATURES)] == pytest.approx(r.predicted, abs=1e-9)
    # training rows per node: leaves hold every row once, inner nodes what their children hold
    counts = {(r.tree, r.node): r.rows for r in trees.rows_per_node(vecs, nodes, n, depth).collect()}
    table = {(r.tree, r.node): r for r in nodes.collect()}
    assert set(counts) <= set(table)
    for (t, i), rows in counts.items():
        if table[t, i].left != trees.LEAF:
            assert rows == sum(counts.get((t, c), 0) for c in (table[t, i].left, table[t, i].right))
    assert {sum(c for (t, i), c in counts.items() if t == k and table[t, i].left == trees.LEAF) for k in range(n)} == {train.count()}
    if kind == "forest":  # a plain prediction with the folded table
        least = 40
        per = trees.rows_per_node(vecs, nodes, n, depth)
        folded = trees.with_min_split(nodes, per, least)
        assert trees.too_small(nodes, per, least).count() > 0 and trees.too_small(folded, per, least).count() == 0
        out = trees.predictions(vecs, folded, n, depth, mean=True).limit(50).collect()
        for r in out:
            leaves = []
            for t in range(n):
                i = 0
                while table[t, i].left != trees.LEAF and counts.get((t, i), 0) >= least:
                    node = table[t, i]
                    i = node.left if r.x[node.feature] <= node.threshold else node.right
                leaves.append(table[t, i].prediction)
            assert r.predicted == pytest.approx(sum(leaves) / n, abs=1e-9)


def test_errors_of_vectors_are_those_of_their_rows(spark, noiseless):
    from wattspark.models import trees
    rows = noiseless.where("split = 'train'").limit(400).withColumn("energy_consumption", F.col("energy_consumption") + F.rand(3))
    vecs = trees.vectors(rows).withColumn("predicted", F.lit(0.7))
    want = rows.agg(F.sqrt(F.avg((F.col("energy_consumption") - 0.7) ** 2))).first()[0]
    assert vecs.agg(trees.rmse()).first()[0] == pytest.approx(want, rel=1e-9)


# --- tree learners on weighted vectors ----------------------------------------------------------
@pytest.fixture(scope="module")
def repeated(spark):
    """Orders readings ten times over, with labels that differ within a vector."""
    r = train_test_split(with_features(orders_readings(spark, "/root/testdata/sf0.001")))
    return r.crossJoin(spark.range(10).select(F.col("id").alias("copy"))).withColumn(C.LABEL, F.col(C.LABEL) + F.col("copy") * 0.1).cache()


def test_vectors_hold_the_rows_and_the_draws(spark, repeated):
    v = training.weighted_vectors(repeated, trees=3).cache()
    assert v.count() == repeated.select(*C.FEATURES).distinct().count() < repeated.count() / 10 + 1
    n = repeated.count()
    sums = v.agg(F.sum("_rows").alias("n"), F.sum(F.col("_rows") * F.col(C.LABEL)).alias("y"), *[F.sum(f"_taken{i}").alias(f"t{i}") for i in range(3)]).first()
    assert sums.n == n and sums.y == pytest.approx(repeated.agg(F.sum(C.LABEL)).first()[0])
    drawn = [sums[f"t{i}"] for i in range(3)]
    assert len(set(drawn)) > 1 and all(abs(d - n) < 6 * n ** 0.5 for d in drawn)
    # the labels taken are those of single rows, not the vector's mean as often as it is drawn
    assert v.where(F.abs(F.col("_taken_sum0") - F.col("_taken0") * F.col(C.LABEL)) > 1e-6).count() > 0
    assert training.weighted_vectors(repeated.withColumn(C.LABEL, F.lit(None).cast("double"))).where(f"not isnan({C.LABEL})").isEmpty()


def test_boosting_on_vectors_predicts_as_on_rows(spark, repeated):
    pipe = training.boosted_pipeline(maxIter=4, maxDepth=4, minInstancesPerNode=25)
    ours, rows = training.fit(pipe, repeated), pipe.fit(repeated)
    both = training.predict_all({"a": ours, "b": rows}, repeated)
    assert both.agg(F.max(F.abs(F.col("predicted_a") - F.col("predicted_b")))).first()[0] < 1e-9
    assert ours.stages[-1].treeWeights == rows.stages[-1].treeWeights


def test_forest_is_a_forest_of_its_trees(spark, repeated, scratch, monkeypatch):
    monkeypatch.setattr(training, "FEW_ROWS", 100)
    model = training.fit(training.forest_pipeline(numTrees=6, maxDepth=5, minInstancesPerNode=25), repeated)
    forest = model.stages[-1]
    assert forest.getNumTrees == 6 and len({t.toDebugString for t in forest.trees}) == 6
    assert forest.featureImportances.toArray().sum() == pytest.approx(1.0)
    training.save(model, f"{scratch}/m")
    training.save_trees(model, f"{scratch}/trees")
    whole = trees.node_table(spark, f"{scratch}/m")
    parts = trees.node_table_by_tree(spark, f"{scratch}/trees", forest.treeWeights).select(*whole.columns)
    assert parts.exceptAll(whole).isEmpty() and whole.exceptAll(parts).isEmpty() and not whole.isEmpty()
    again = training.load(f"{scratch}/m")
    both = training.predict_all({"a": model, "b": again}, repeated)
    assert both.where("predicted_a <> predicted_b").isEmpty()


def test_a_forest_saved_while_it_grows_is_that_of_fit(spark, repeated, scratch, monkeypatch):
    monkeypatch.setattr(training, "FEW_ROWS", 100)
    pipe = training.forest_pipeline(numTrees=5, maxDepth=4, minInstancesPerNode=25)
    model = training.fit(pipe, repeated)
    weights, depth = training.fit_saved_forest(pipe, repeated, f"{scratch}/grown")
    assert (len(weights), depth) == trees.shape(model) and weights == model.stages[-1].treeWeights
    training.save_trees(model, f"{scratch}/whole")
    grown, whole = (trees.node_table_by_tree(spark, f"{scratch}/{x}", weights).drop("prediction") for x in ("grown", "whole"))
    assert grown.exceptAll(whole).isEmpty() and whole.exceptAll(grown).isEmpty() and not whole.isEmpty()


def test_rows_per_node_walk_the_trees_once(spark, noiseless):
    """As many joins as levels, however deep the node; nodes that no row reaches have no count."""
    root, inner = (0, 0, 1.0, 0, 11.5, 1, 2, 0.0), (0, 2, 1.0, 0, 99.0, 3, 4, 0.0)  # feature 0 is the hour: none is over 99
    leaves = [(0, i, 1.0, -1, 0.0, trees.LEAF, trees.LEAF, 0.5) for i in (1, 3, 4)]
    nodes = spark.createDataFrame([root, inner, *leaves], "tree int, node int, weight double, feature int, threshold double, left int, right int, prediction double")
    vecs = trees.vectors(noiseless, ["hour", "month"])
    found = trees.rows_per_node(vecs, nodes, 1, 3)
    late = noiseless.where("hour >= 12").count()
    assert {r.node: r.rows for r in found.collect()} == {0: noiseless.count(), 1: noiseless.count() - late, 2: late, 3: late}
    joins = [df._jdf.queryExecution().analyzed().toString().count("Join Inner") for df in (vecs, found)]
    assert joins[1] == joins[0] + 3


@pytest.mark.parametrize("most", [10 ** 6, 10])
def test_rows_get_the_predictions_of_their_vector(spark, repeated, monkeypatch, most):
    """Nulls, NaN and both zeros included; too many vectors for the driver are scored row by row."""
    monkeypatch.setattr(training, "SCORED_VECTORS", most)
    models = {"linear": training.fit(training.linear_pipeline(), repeated), "forest": training.fit(training.forest_pipeline(numTrees=3, maxDepth=4), repeated),
              "boosted": training.fit(training.boosted_pipeline(maxIter=3, maxDepth=3), repeated)}
    odd = repeated.where("copy < 3").withColumns({
        "month": F.when(F.col("reading_id") % 7 != 1, F.col("month")),
        "hour_sin": F.when(F.col("reading_id") % 7 == 2, F.lit(-0.0)).when(F.col("reading_id") % 7 == 3, F.lit(0.0)).when(F.col("reading_id") % 7 == 4, F.lit(float("nan"))).otherwise(F.col("hour_sin"))})
    keys = ["reading_id", "copy", C.LABEL, *[f"predicted_{k}" for k in models]]
    got, want = (f(models, odd).select(*keys) for f in (training.predict_by_vector, training.predict_all))
    assert got.count() == odd.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_comparison_scores_each_vector_once(spark, repeated):
    models = {"linear": training.fit(training.linear_pipeline(), repeated), "boosted": training.fit(training.boosted_pipeline(maxIter=3, maxDepth=3), repeated)}
    found = training.compare(models, repeated)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan[:plan.index("Join ")] and "scored-vectors" in "".join(found.inputFiles())
    own = {r["model"]: r for r in found.collect()}
    for key, model in models.items():
        one = training.evaluate_split(model, repeated, training.MODEL_NAMES[key]).first()
        assert own[one["model"]]["test_rows"] == one["test_rows"]
        assert all(own[one["model"]][c] == pytest.approx(one[c], rel=1e-9) for c in ("train_rmse", "test_rmse", "test_mae", "test_r2"))
