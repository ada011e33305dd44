"""Train, evaluate, persist and compare the three regressors.

Each model is a ``Pipeline(VectorAssembler, regressor)`` over the 21 feature
columns, so a saved model scores raw feature rows directly. Training runs on
the executors (MLlib: distributed normal equations for OLS, distributed
histogram splits for trees); only the fitted model lives on the driver.

Tree learners read the *different feature vectors*, each with its number of
rows as weight and their mean label, instead of the rows. A split's gain is made
of the counts and label sums of its two sides, so both give the same splits and
the same leaves; the rows are read once, to group them, however many trees and
levels are grown. A forest's bootstrap draws for each row and tree how often the
tree takes that row, from a Poisson distribution, in the same pass; a tree reads
of each vector how often its rows were taken and the sum of the labels taken.
Forests of few rows are fitted on the rows.
"""

from __future__ import annotations

import gc
import math
import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import is_remote

from wattspark import constants as C
from wattspark.functions import labels as lab
from wattspark.operators.features import assembler, feature_descriptions, open_household_stages
from wattspark.session import checkpoint_dir

#: Rows of a feature vector; how often a tree of a forest takes them, and the sum of the labels taken.
ROWS, TAKEN, TAKEN_SUM = "_rows", "_taken", "_taken_sum"
#: A forest of up to this many rows is fitted on the rows, all trees at once: that needs far fewer jobs, and passes are short.
FEW_ROWS = 500_000
#: Vectors that one task reads, at most (about).
VECTORS_A_TASK = 50_000
#: Trees of a forest that are fitted at the same time, at most; and of one that is saved while it grows: the driver holds
#: some 50 MB a growing tree of 20,000 nodes (the tree, its best splits, what is sent with its jobs).
TREES_AT_ONCE, SAVED_AT_ONCE = 16, 2

#: Rows of up to this many different feature vectors are scored by vector: the vectors' predictions, some 250 bytes each, are broadcast.
SCORED_VECTORS = 200_000

MODEL_NAMES = {"linear": "Linear Regression", "forest": "Random Forest", "boosted": "Gradient Boosting"}


def linear_pipeline(open_households: bool = False) -> Pipeline:
    """Ordinary least squares on all features (collinear dummies are fine: predictions are unique).

    ``open_households`` one-hots the households found in the training rows instead of the five known ones.
    """
    first = open_household_stages() if open_households else [assembler()]
    return Pipeline(stages=[*first, LinearRegression(featuresCol="features", labelCol=C.LABEL,
                                                          predictionCol="predicted", regParam=0.0,
                                                          elasticNetParam=0.0, solver="normal")])


def forest_pipeline(numTrees: int = C.FOREST_PARAMS["numTrees"], maxDepth: int = C.FOREST_PARAMS["maxDepth"],
                    minInstancesPerNode: int = C.FOREST_PARAMS["minInstancesPerNode"], seed: int = C.SEED,
                    maxBins: int = 32) -> Pipeline:
    """Random forest; every feature is a split candidate at each node, as the original regressor."""
    rf = RandomForestRegressor(featuresCol="features", labelCol=C.LABEL, predictionCol="predicted",
                               numTrees=numTrees, maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode,
                               featureSubsetStrategy="all", seed=seed, maxBins=maxBins,
                               cacheNodeIds=True, checkpointInterval=10)
    return Pipeline(stages=[assembler(), rf])


def boosted_pipeline(maxIter: int = C.BOOSTED_PARAMS["maxIter"], stepSize: float = C.BOOSTED_PARAMS["stepSize"],
                     maxDepth: int = C.BOOSTED_PARAMS["maxDepth"],
                     minInstancesPerNode: int = C.BOOSTED_PARAMS["minInstancesPerNode"], seed: int = C.SEED,
                     maxBins: int = 32) -> Pipeline:
    gbt = GBTRegressor(featuresCol="features", labelCol=C.LABEL, predictionCol="predicted", maxIter=maxIter,
                       stepSize=stepSize, maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode, seed=seed,
                       maxBins=maxBins, cacheNodeIds=True, checkpointInterval=10)
    return Pipeline(stages=[assembler(), gbt])


def _poisson(u: Column, rate: float) -> Column:
    """The Poisson(``rate``) number at which the distribution function exceeds the uniform number ``u``."""
    k, p, below = 0, math.exp(-rate), math.exp(-rate)
    out = F.when(u < below, F.lit(0))
    while p > 2.0 ** -60 or k < rate:
        k, p = k + 1, p * rate / (k + 1)
        below += p
        out = out.when(u < below, F.lit(k))
    return out.otherwise(F.lit(k))


def _numbers(features=C.FEATURES) -> list[Column]:
    """The features as the assembler reads them: null is NaN."""
    return [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))).alias(f) for f in features]


def weighted_vectors(train: DataFrame, features=C.FEATURES, label: str = C.LABEL, trees: int = 0, rate: float = 1.0,
                     seed: int = C.SEED) -> DataFrame:
    """(features, label, _rows, _taken0, _taken_sum0, ...): the different feature vectors with mean label and number of
    rows, and for each of ``trees`` bootstraps how often their rows are taken and the sum of the labels taken.

    Null features become NaN, as the assembler makes them. A vector with a null label has the label NaN: no learner takes it.
    """
    x = F.array(*_numbers(features))
    y = F.coalesce(F.col(f"`{label}`").cast("double"), F.lit(float("nan")))
    # seeds far apart: a partition's number is added to them
    rows = train.select(x.alias("_x"), y.alias("_y"), *[F.rand(seed + 1_000_003 * i).alias(f"_u{i}") for i in range(trees)])
    rows = rows.select("_x", "_y", *[_poisson(F.col(f"_u{i}"), rate).alias(f"_k{i}") for i in range(trees)])
    found = rows.groupBy("_x").agg(
        F.avg("_y").alias(label), F.count(F.lit(1)).alias(ROWS), *[F.sum(f"_k{i}").alias(f"{TAKEN}{i}") for i in range(trees)],
        *[F.sum(F.col(f"_k{i}") * F.col("_y")).alias(f"{TAKEN_SUM}{i}") for i in range(trees)])
    return found.select(*[F.get("_x", F.lit(i)).alias(f) for i, f in enumerate(features)], *[c for c in found.columns if c != "_x"])


def _by_weight(learner, weight: str, total: float):
    """The learner on weighted vectors: its least number of rows in a node as a share of their ``total`` weight.

    Half a row less than that number keeps the comparison clear of rounding; weights are whole. A share must lie
    below one half: beyond it no split leaves both sides enough, and the tree is a leaf.
    """
    share = (learner.getMinInstancesPerNode() - 0.5) / total if total else 0.0
    extra = {learner.weightCol: weight, learner.minInstancesPerNode: 1, learner.minWeightFractionPerNode: min(share, 0.49)}
    if 2 * learner.getMinInstancesPerNode() > total:
        extra[learner.maxDepth] = 0
    return learner.copy(extra)


def _grow(learner: RandomForestRegressor, vecs: DataFrame, path: str, then, at_once: int) -> list:
    """``then(i, tree)`` of every tree of the forest, each grown on its own draws (as a forest of one), up to ``at_once``
    at the same time. ``vecs`` is the table written to ``path``. What ``then`` does not keep goes when it returns."""
    n, label, spark = learner.getNumTrees(), learner.getLabelCol(), vecs.sparkSession
    *totals, rows = vecs.agg(*[F.sum(f"{TAKEN}{i}") for i in range(n)], F.count(F.lit(1))).first()
    tasks = math.ceil(rows / VECTORS_A_TASK) or 1

    def grow(i: int):
        one = _by_weight(learner, TAKEN, totals[i] or 0)
        one = one.copy({one.numTrees: 1, one.bootstrap: False, one.subsamplingRate: 1.0, one.cacheNodeIds: False, one.seed: learner.getSeed() + i})
        read = spark.read.schema(vecs.select(learner.getFeaturesCol(), f"{TAKEN}{i}", f"{TAKEN_SUM}{i}").schema).parquet(path)
        bag = read.where(F.col(f"{TAKEN}{i}") > 0).select(learner.getFeaturesCol(), F.col(f"{TAKEN}{i}").alias(TAKEN),
                                                          (F.col(f"{TAKEN_SUM}{i}") / F.col(f"{TAKEN}{i}")).alias(label))
        return then(i, one.fit(bag.coalesce(tasks)))
    pool = ThreadPool(min(n, at_once, spark.sparkContext.defaultParallelism))
    try:
        return pool.map(inheritable_thread_target(spark)(grow), range(n), chunksize=1)
    finally:
        pool.close()


def _forest(learner: RandomForestRegressor, vecs: DataFrame, path: str) -> RandomForestRegressionModel:
    """The forest, put together from its trees."""
    trees = _grow(learner, vecs, path, lambda i, one: one._java_obj.trees()[0], TREES_AT_ONCE)
    sc = vecs.sparkSession.sparkContext
    ml = sc._jvm.org.apache.spark.ml.regression
    array = sc._gateway.new_array(ml.DecisionTreeRegressionModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    model = learner._copyValues(RandomForestRegressionModel(ml.RandomForestRegressionModel(learner.uid, array, trees[0].numFeatures())))
    model._transfer_params_to_java()  # the number of trees is one
    return model


def _saved_tree(tree, path: str, i: int) -> int:
    """The depth of a tree, now the ``i``-th in the folder (see ``save_trees``)."""
    tree.write().overwrite().save(f"{path.rstrip('/')}/tree-{i}")
    return tree.depth


def _read_by_weight(pipeline: Pipeline, train: DataFrame) -> tuple[DataFrame, str] | None:
    """The written table of weighted vectors that the pipeline's tree learner reads, and its path; None where it is
    fitted on the rows: least squares, forests of few rows, and everything under Connect."""
    spark = train.sparkSession
    folder = checkpoint_dir(spark).rstrip("/")
    first, learner = pipeline.getStages()[0], pipeline.getStages()[-1]
    if not isinstance(first, VectorAssembler) or not isinstance(learner, (GBTRegressor, RandomForestRegressor)) or is_remote():
        return None
    is_forest = isinstance(learner, RandomForestRegressor)
    if is_forest and train.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return None
    bags = {"trees": learner.getNumTrees(), "rate": learner.getSubsamplingRate(), "seed": learner.getSeed()} if is_forest else {}
    features = first.getInputCols()
    vecs = first.transform(weighted_vectors(train, features, learner.getLabelCol(), **bags)).drop(*features)
    path = f"{folder}/vectors-{uuid.uuid4().hex}"
    vecs.write.parquet(path)
    return spark.read.schema(vecs.schema).parquet(path), path


def fit(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """Fit on the executors: trees on the weighted vectors (see above), written once to the session's shared
    checkpoint folder; least squares, forests of few rows, and everything under Connect, on the rows. Boosting checkpoints its node-id
    cache every ``checkpointInterval`` iterations there, so a lost executor late in a long run does not replay the
    whole lineage."""
    found = _read_by_weight(pipeline, train)
    if found is None:
        return pipeline.fit(train)
    first, learner = pipeline.getStages()[0], pipeline.getStages()[-1]
    vecs, path = found
    if isinstance(learner, RandomForestRegressor):
        return PipelineModel([first, _forest(learner, vecs, path)])
    total = vecs.agg(F.sum(ROWS)).first()[0]
    return PipelineModel([first, learner._copyValues(_by_weight(learner, ROWS, total).fit(vecs))])


def fit_saved_forest(pipeline: Pipeline, train: DataFrame, path: str) -> tuple[list[float], int]:
    """The weights of a forest's trees and their greatest depth, for callers that need only its node table: the trees are
    those of ``fit``, saved as ``save_trees`` does. Of many rows each is saved as soon as it is grown and then let go, so the
    driver holds the few that grow at the same time, never the forest."""
    found = _read_by_weight(pipeline, train)
    if found is None:
        model = pipeline.fit(train)
        return model.stages[-1].treeWeights, max(save_trees(model, path))

    def keep(i, one):
        depth = _saved_tree(one.trees[0], path, i)
        gc.collect()  # writers hold their tree in a cycle, and what Python holds the JVM keeps
        return depth
    depths = _grow(pipeline.getStages()[-1], *found, keep, SAVED_AT_ONCE)
    return [1.0] * len(depths), max(depths)


def evaluate_split(model: PipelineModel, features: DataFrame, name: str, split: str = "split") -> DataFrame:
    """One row: model name, train RMSE, test RMSE / MAE / R^2 and test rows (M5).

    Rows carry their ``split`` tag, so one scoring pass and one aggregate
    (conditional on the tag) give every metric; R^2 uses SS_tot = n x var_pop.
    """
    scored = model.transform(features)
    y, p = F.col(C.LABEL), F.col("predicted")
    res = y - p
    tr, te = F.col(split) == "train", F.col(split) == "test"
    out = scored.agg(
        F.sqrt(F.avg(F.when(tr, res * res))).alias("train_rmse"),
        F.sqrt(F.avg(F.when(te, res * res))).alias("test_rmse"),
        F.avg(F.when(te, F.abs(res))).alias("test_mae"),
        F.sum(F.when(te, res * res)).alias("_ss_res"),
        (F.var_pop(F.when(te, y)) * F.count_if(te)).alias("_ss_tot"),
        F.count_if(te).alias("test_rows"))
    r2 = F.lit(1.0) - F.try_divide(F.col("_ss_res"), F.col("_ss_tot"))
    return out.select(F.lit(name).alias("model"), "train_rmse", "test_rmse", "test_mae", r2.alias("test_r2"),
                      "test_rows")


def evaluate(model: PipelineModel, train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    """``evaluate_split`` for separately held train and test frames."""
    both = train.withColumn("_split", F.lit("train")).unionByName(test.withColumn("_split", F.lit("test")))
    return evaluate_split(model, both, name, split="_split")


def predict_all(models: dict[str, PipelineModel], features: DataFrame) -> DataFrame:
    """One scoring pass for several models: a column ``predicted_<key>`` each."""
    out = features
    for key, model in models.items():
        out = model.transform(out).drop("features").withColumnRenamed("predicted", f"predicted_{key}")
    return out


def predict_by_vector(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """As ``predict_all``, for models that take long to walk through: each different feature vector is scored once, and the
    rows look up what their own got. Rows of more than ``SCORED_VECTORS`` vectors are scored one by one.

    The look-up is by a hash of the vector, and by the vector itself where hashes are equal.
    """
    spark = rows.sparkSession
    vecs, path = rows.select(*_numbers()).distinct(), f"{checkpoint_dir(spark).rstrip('/')}/scored-vectors-{uuid.uuid4().hex}"
    vecs.write.parquet(path)
    vecs = spark.read.schema(vecs.schema).parquet(path)
    if vecs.count() > SCORED_VECTORS:
        return predict_all(models, rows)
    found = [f"predicted_{key}" for key in models]
    scored = predict_all(models, vecs).select(F.xxhash64(*_numbers()).alias("_scored_hash"), F.array(*_numbers()).alias("_scored_x"), *found)
    at = rows.withColumns({"_row_hash": F.xxhash64(*_numbers()), "_row_x": F.array(*_numbers())})
    both = at.join(F.broadcast(scored), (F.col("_row_hash") == F.col("_scored_hash")) & (F.col("_row_x") == F.col("_scored_x")))
    return both.select(*rows.columns, *found)


def compare(models: dict[str, PipelineModel], features: DataFrame, split: str = "split") -> DataFrame:
    """One evaluation row per model (M6), as ``evaluate_split``, from one scoring pass and one aggregate. With a tree model
    among them the pass is over the different feature vectors: a row costs a forest some 1,500 steps from node to node."""
    y = F.col(C.LABEL)
    tr, te = F.col(split) == "train", F.col(split) == "test"
    aggs = [(F.var_pop(F.when(te, y)) * F.count_if(te)).alias("_tot"), F.count_if(te).alias("_n")]
    rows = []
    for key in models:
        res = y - F.col(f"predicted_{key}")
        aggs += [F.sqrt(F.avg(F.when(tr, res * res))).alias(f"_tr_{key}"), F.sqrt(F.avg(F.when(te, res * res))).alias(f"_te_{key}"),
                 F.avg(F.when(te, F.abs(res))).alias(f"_mae_{key}"), F.sum(F.when(te, res * res)).alias(f"_ss_{key}")]
        rows.append(F.struct(F.lit(MODEL_NAMES.get(key, key)).alias("model"), F.col(f"_tr_{key}").alias("train_rmse"),
                             F.col(f"_te_{key}").alias("test_rmse"), F.col(f"_mae_{key}").alias("test_mae"),
                             (F.lit(1.0) - F.try_divide(F.col(f"_ss_{key}"), F.col("_tot"))).alias("test_r2"),
                             F.col("_n").alias("test_rows")))
    predict = predict_by_vector if any(hasattr(m.stages[-1], "trees") for m in models.values()) else predict_all
    return predict(models, features).agg(*aggs).select(F.inline(F.array(*rows)))


def normal_equations(model: PipelineModel, train: DataFrame) -> DataFrame:
    """Mean of residual x feature over the training rows, a row per feature: all zero for a least-squares fit (M1 check)."""
    res = F.col(C.LABEL) - F.col("predicted")
    aggs = model.transform(train).agg(*[F.avg(res * F.col(f)).alias(f) for f in C.FEATURES])
    return aggs.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("moment")) for f in C.FEATURES])))


def importances(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Feature importances of a tree model as a table (M4): feature, importance, rank, family, description.

    The importance vector is model metadata (21 numbers) already on the
    driver; ties rank the later feature first, as a stable descending sort
    of the original order reversed.
    """
    vec = model.stages[-1].featureImportances.toArray().tolist()
    order = sorted(range(len(vec)), key=lambda i: (-vec[i], -i))
    rank = {i: r for r, i in enumerate(order, start=1)}
    rows = [(name, float(v), rank[i]) for i, (name, v) in enumerate(zip(C.FEATURES, vec))]
    ranked = spark.createDataFrame(rows, "feature string, importance double, rank int")
    return (ranked.join(F.broadcast(feature_descriptions(spark)), "feature", "left")
            .withColumn("family", lab.feature_family("feature")))


def top_driver_values(model: PipelineModel, k: int = C.TOP_DRIVERS) -> list[tuple[str, float]]:
    """The k most important (feature, importance) pairs, from the model's own metadata."""
    vec = model.stages[-1].featureImportances.toArray().tolist()
    order = sorted(range(len(vec)), key=lambda i: (-vec[i], -i))[:k]
    return [(C.FEATURES[i], float(vec[i])) for i in order]


def top_drivers(model: PipelineModel, spark: SparkSession, k: int = C.TOP_DRIVERS) -> DataFrame:
    """The k most important features."""
    return importances(model, spark).where(F.col("rank") <= k).orderBy("rank")


def save(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)


def save_trees(model: PipelineModel, path: str) -> list[int]:
    """Save a fitted ensemble tree by tree (``path/tree-<i>``): the driver writes out one tree after another, never a
    copy of the whole ensemble. ``trees.node_table_by_tree`` reads it. The depths of the trees."""
    return [_saved_tree(tree, path, i) for i, tree in enumerate(model.stages[-1].trees)]


def load(path: str) -> PipelineModel:
    """Load a fitted pipeline (S8); a missing model is a clear error, not a silent ``None``."""
    try:
        return PipelineModel.load(path)
    except Exception as exc:  # noqa: BLE001 - the error type varies by file system; only a missing path is renamed
        said = str(exc)
        if "does not exist" in said or "FileNotFound" in said or "PATH_NOT_FOUND" in said or "No such file" in said:
            raise FileNotFoundError(f"no trained model at {path}: train and save one first") from exc
        raise
