"""Registered model queries (M1-M9, O4, O6, A21-A25 on the model's own predictions).

All train with the original settings (100 trees x depth 15; 100 rounds x depth
5, rate 0.1). Models are fitted once per session and state of the input files,
over one written feature table; queries that share a model share the fit.

What a fit predicts is no SQL; what holds for every right fit is: the normal
equations of least squares, the mean of a boosted fit, row counts of splits,
days, bins and scenarios, and everything of a response but the prediction.
Those are the ``O`` queries here; accuracy bounds are in the tests.
"""

from __future__ import annotations

import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from wattspark import constants as C
from wattspark.models import scoring, training
from wattspark.operators import errors
from wattspark.operators.anomaly import with_z_score
from wattspark.operators.enrich import enrich
from wattspark.operators.features import with_features
from wattspark.operators.sampling import sample_fixed_n, train_test_split
from wattspark.plans.q_features import REQUEST_CTES, VALIDATION
from wattspark.plans.registry import orders, register
from wattspark.plans.sql import ENRICH, ORDERS_READINGS, R, with_ctes
from wattspark.session import checkpoint_dir, session_key
from wattspark.sources.adapters import requests_from_events

_CACHE: dict = {}


def _state(spark, sf):
    """What identifies the orders files: path, size and time of each, from their listing (no row is read)."""
    files = spark.read.format("binaryFile").load(f"{sf}/orders.parquet").select("path", "length", "modificationTime")
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"),
                           F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def _once(spark, sf, kind, make):
    """``make()`` once per session, folder and state of its orders files (a rewritten folder is fitted anew)."""
    state, key = _state(spark, sf), (session_key(spark), sf, kind)
    if key not in _CACHE or _CACHE[key][0] != state:
        _CACHE[key] = (state, make())
    return _CACHE[key][1]


def _kept(spark, sf, kind):
    """What ``_once`` has made of this kind and still holds; None if nothing, or of other files."""
    state, made = _CACHE.get((session_key(spark), sf, kind), (None, None))
    return made if state is not None and state == _state(spark, sf) else None


def _features(spark, sf):
    """Readings with features and split, written once to the shared folder: one neighbour shuffle for all fits."""
    def write():
        path = f"{checkpoint_dir(spark).rstrip('/')}/features-{uuid.uuid4().hex}"
        df = train_test_split(with_features(orders(spark, sf)))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return _once(spark, sf, "features", write)


def _train(spark, sf):
    return _features(spark, sf).where(F.col("split") == "train")


def _model(spark, sf, kind):
    pipe = {"linear": training.linear_pipeline, "forest": training.forest_pipeline, "boosted": training.boosted_pipeline}[kind]
    return _once(spark, sf, kind, lambda: training.fit(pipe(), _train(spark, sf)))


def _models(spark, sf, *kinds):
    """The models by kind. Those not fitted yet are fitted at the same time: a boosted fit is a long chain of short jobs,
    which leaves most cores to the others."""
    _features(spark, sf)  # before the threads, so that it is written once
    pool = ThreadPool(len(kinds))
    try:
        found = pool.map(inheritable_thread_target(spark)(lambda kind: _model(spark, sf, kind)), kinds, chunksize=1)
    finally:
        pool.close()
    return dict(zip(kinds, found))


def _compare(spark, sf, *kinds):
    return training.compare(_models(spark, sf, *kinds), _features(spark, sf))


def _predicted(spark, sf):
    """Readings with the boosted model's predictions."""
    scored = _model(spark, sf, "boosted").transform(_features(spark, sf)).drop("features")
    return scored.select("reading_id", "household_id", "timestamp", "energy_consumption", "load_shedding_stage", "backup_power",
                         "predicted")


def _scored(spark, sf):
    """Scored readings with calendar fields (A21-A25). The predictions are written once: the analytics over them read
    them up to six times."""
    def write():
        df = _predicted(spark, sf)
        path = f"{checkpoint_dir(spark).rstrip('/')}/scored-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return enrich(_once(spark, sf, "scored", write))


@register("train_linear", note="R: predictions are not bit-equal across solvers")
def q_train_linear(spark, sf):
    return _compare(spark, sf, "linear")


@register("train_forest", note="R")
def q_train_forest(spark, sf):
    return _compare(spark, sf, "forest")


@register("train_gbt", note="R")
def q_train_gbt(spark, sf):
    return _compare(spark, sf, "boosted")


@register("model_comparison", note="R")
def q_model_comparison(spark, sf):
    return _compare(spark, sf, "linear", "forest", "boosted")


@register("ols_normal_equations", f"SELECT unnest({list(C.FEATURES)}) AS feature, 0.0::DOUBLE AS moment")
def q_ols_normal_equations(spark, sf):
    """Zero to 5 decimals; adding 0.0 turns -0.0 into 0.0."""
    moments = training.normal_equations(_model(spark, sf, "linear"), _features(spark, sf).where(F.col("split") == "train"))
    return moments.select("feature", (F.round("moment", 5) + F.lit(0.0)).alias("moment"))


@register("fit_means", with_ctes(ORDERS_READINGS, body=f"""
SELECT model, count(*) AS train_rows, {R('avg(energy_consumption)')} AS mean_label, {R('avg(energy_consumption)')} AS mean_predicted
FROM r, (VALUES ('linear'), ('boosted')) AS m(model) WHERE reading_id % 5 <> 0 GROUP BY model"""))
def q_fit_means(spark, sf):
    """The mean prediction on the training rows is the mean label, for least squares and for boosting on full rows."""
    kinds = ("linear", "boosted")
    train = _features(spark, sf).where(F.col("split") == "train")
    out = training.predict_all(_models(spark, sf, *kinds), train).agg(
        F.count(F.lit(1)).alias("train_rows"), F.avg(C.LABEL).alias("mean_label"), *[F.avg(f"predicted_{k}").alias(k) for k in kinds])
    return out.select(F.inline(F.array(*[F.struct(F.lit(k).alias("model"), "train_rows", "mean_label", F.col(k).alias("mean_predicted"))
                                         for k in kinds])))


@register("evaluation_rows", with_ctes(ORDERS_READINGS, body="""
SELECT model, count(*) AS test_rows
FROM r, (VALUES ('Linear Regression'), ('Random Forest'), ('Gradient Boosting')) AS m(model) WHERE reading_id % 5 = 0 GROUP BY model"""))
def q_evaluation_rows(spark, sf):
    return _compare(spark, sf, "linear", "forest", "boosted").select("model", "test_rows")


@register("feature_importance", note="R")
def q_feature_importance(spark, sf):
    return training.importances(_model(spark, sf, "forest"), spark)


@register("top_drivers", note="R")
def q_top_drivers(spark, sf):
    return training.top_drivers(_model(spark, sf, "forest"), spark)


@register("score_readings", note="R")
def q_score_readings(spark, sf):
    scored = scoring.score_readings(_model(spark, sf, "boosted"), _features(spark, sf))
    return scored.select("reading_id", "household_id", "timestamp", "energy_consumption", "predicted",
                         "residual", "abs_error", "pct_error")


@register("in_sample_metrics", note="R")
def q_in_sample_metrics(spark, sf):
    return errors.error_metrics(_scored(spark, sf))


@register("model_bands", note="R")
def q_model_bands(spark, sf):
    return errors.prediction_bands(_scored(spark, sf))


@register("model_scenario_errors", note="R")
def q_model_scenario_errors(spark, sf):
    return errors.scenario_errors(_scored(spark, sf))


@register("model_histogram", note="R")
def q_model_histogram(spark, sf):
    return errors.residual_histogram(_scored(spark, sf))


@register("model_normal_fit", note="R")
def q_model_normal_fit(spark, sf):
    return errors.residual_normal_fit(_scored(spark, sf))


@register("model_analytics_counts", with_ctes(ORDERS_READINGS, ENRICH, body="""
SELECT 'band days' AS what, count(DISTINCT date) AS n FROM e
UNION ALL SELECT 'histogram bins', 50
UNION ALL SELECT 'histogram rows', count(*) FROM e
UNION ALL SELECT 'normal fit points', 100
UNION ALL SELECT 'Normal Hours', count(*) FROM e WHERE load_shedding_stage = 0
UNION ALL SELECT 'During Outage', count(*) FROM e WHERE load_shedding_stage > 0
UNION ALL SELECT 'Winter Peak', count(*) FROM e WHERE season = 'Winter' AND hour BETWEEN 17 AND 21
UNION ALL SELECT 'Summer Midday', count(*) FROM e WHERE season = 'Summer' AND hour BETWEEN 11 AND 14
UNION ALL SELECT 'Weekend', count(*) FROM e WHERE is_weekend = 1
UNION ALL SELECT 'With Backup', count(*) FROM e WHERE backup_power"""))
def q_model_analytics_counts(spark, sf):
    """Row counts of the four analytics over the boosted model's predictions."""
    e = _scored(spark, sf)
    hist = errors.residual_histogram(e)
    parts = [errors.prediction_bands(e).agg(F.lit("band days").alias("what"), F.count(F.lit(1)).alias("n")),
             hist.agg(F.lit("histogram bins").alias("what"), F.count(F.lit(1)).alias("n")),
             hist.agg(F.lit("histogram rows").alias("what"), F.sum("count").alias("n")),
             errors.residual_normal_fit(e).agg(F.lit("normal fit points").alias("what"), F.count(F.lit(1)).alias("n")),
             errors.scenario_errors(e).select(F.col("scenario").alias("what"), "n")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_GRID = """
SELECT g.hour, g.season, g.stage AS load_shedding_stage, g.backup AS has_backup_power, count(e.energy_consumption) AS n_readings{more}
FROM (SELECT CAST(h AS INTEGER) AS hour, season, CAST(s AS INTEGER) AS stage, backup
      FROM range(0, 24) AS a(h), (VALUES ('Winter'), ('Summer'), ('Spring'), ('Autumn')) AS b(season), range(0, 7) AS c(s),
           (VALUES (true), (false)) AS d(backup)) g
LEFT JOIN e ON e.hour = g.hour AND e.season = g.season AND e.load_shedding_stage = g.stage AND e.backup_power = g.backup
GROUP BY ALL"""


@register("scenario_actuals", with_ctes(ORDERS_READINGS, ENRICH, body=_GRID.format(more=f", {R('avg(e.energy_consumption)')} AS actual_kwh")))
def q_scenario_actuals(spark, sf):
    return scoring.scenario_actuals(orders(spark, sf), scoring.scenario_grid(spark)).select(
        "hour", "season", "load_shedding_stage", "has_backup_power", "n_readings", "actual_kwh")


@register("scenario_grid", note="R")
def q_scenario_grid(spark, sf):
    """Every scenario's prediction beside what the readings of that scenario used."""
    return scoring.score_scenarios(_model(spark, sf, "boosted"), scoring.scenario_actuals(orders(spark, sf), scoring.scenario_grid(spark)))


def _responses(spark, sf):
    models = _models(spark, sf, "boosted", "forest")
    return scoring.score_requests(models["boosted"], models["forest"], requests_from_events(spark, sf))


@register("score_requests", note="R")
def q_score_requests(spark, sf):
    return _responses(spark, sf).select("request_id", "status", "error", F.to_json(F.struct(
        "prediction", "input_context", "top_drivers")).alias("response"))


@register("response_context", with_ctes(REQUEST_CTES, body=f"""
SELECT request_id, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error,
       CASE WHEN error IS NULL THEN hour END AS hour, CASE WHEN error IS NULL THEN day_type END AS day_type,
       CASE WHEN error IS NULL THEN season END AS season,
       CASE WHEN error IS NULL THEN load_shedding_stage END AS load_shedding_stage,
       CASE WHEN error IS NULL THEN has_backup_power END AS has_backup_power,
       CASE WHEN error IS NULL THEN household_id END AS household_id,
       error IS NULL AS has_prediction, CASE WHEN error IS NULL THEN 3 ELSE 0 END AS n_drivers
FROM (SELECT *, {VALIDATION} AS error FROM q)"""))
def q_response_context(spark, sf):
    """All of a response but the predicted value."""
    keys = ("hour", "day_type", "season", "load_shedding_stage", "has_backup_power", "household_id")
    drivers = F.when(F.col("top_drivers").isNull(), F.lit(0)).otherwise(F.size("top_drivers"))
    return _responses(spark, sf).select("request_id", "status", "error", *[F.col(f"input_context.{k}").alias(k) for k in keys],
                                        F.col("prediction.expected_consumption_kwh").isNotNull().alias("has_prediction"),
                                        drivers.alias("n_drivers"))


def _sample_sql(n: int, rows: str) -> str:
    return f"""
SELECT reading_id FROM (SELECT reading_id FROM {rows} ORDER BY md5('{C.SEED}:' || CAST(reading_id AS VARCHAR)), reading_id LIMIT {n})"""


@register("sample_fixed_n", with_ctes(ORDERS_READINGS, body=_sample_sql(2000, """(SELECT * FROM (
  SELECT reading_id, abs((energy_consumption - avg(energy_consumption) OVER ()) / stddev_samp(energy_consumption) OVER ()) AS z FROM r)
  WHERE z <= 2.5)""")))
def q_sample_fixed_n(spark, sf):
    """2,000 normal readings (the feature is the fixed size)."""
    return sample_fixed_n(with_z_score(orders(spark, sf)).where(~F.col("is_anomaly")), 2000).select("reading_id")


@register("sample_scored_5000", with_ctes(ORDERS_READINGS, body=_sample_sql(5000, "r")))
def q_sample_scored_5000(spark, sf):
    """The 5,000 scored readings that the scatter of actual against predicted shows."""
    return sample_fixed_n(_predicted(spark, sf), 5000).select("reading_id")


@register("sample_scored_3000", with_ctes(ORDERS_READINGS, body=_sample_sql(3000, "r")))
def q_sample_scored_3000(spark, sf):
    """The 3,000 scored readings that the residual plot shows."""
    return sample_fixed_n(_predicted(spark, sf), 3000).select("reading_id")
