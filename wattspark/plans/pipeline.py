"""End-to-end plans: the training pipeline and the dashboard views.

``train_and_evaluate`` is the batch counterpart of generate -> features ->
split -> fit three regressors -> evaluate -> save; ``dashboard_views`` is the
slice -> rollups -> KPIs / pivots / forecast flow. Both return lazy
DataFrames (and fitted models); nothing is collected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.models import training
from wattspark.operators import filters, reshape, rollups, trends
from wattspark.operators.enrich import enrich
from wattspark.operators.features import with_features
from wattspark.operators.sampling import train_test_split
from wattspark.session import checkpoint_dir


def train_and_evaluate(readings: DataFrame, model_dir: str | None = None, forest_params: dict | None = None,
                       boosted_params: dict | None = None):
    """Fit linear, forest and boosted models on an 80/20 key split.

    Returns ``(models, comparison)``; ``models`` maps linear / forest / boosted
    to fitted pipelines (saved under ``model_dir`` when given) and
    ``comparison`` is the one-row-per-model evaluation table, one scoring pass
    over the feature rows, which are written to the shared checkpoint folder:
    one neighbour shuffle for all fits, and a lost executor costs a re-read.
    """
    spark = readings.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/features-{uuid.uuid4().hex}"
    feats = train_test_split(with_features(readings))
    feats.write.parquet(path)
    feats = spark.read.schema(feats.schema).parquet(path)
    train, test = feats.where(F.col("split") == "train"), feats.where(F.col("split") == "test")
    pipes = {"linear": training.linear_pipeline(),
             "forest": training.forest_pipeline(**(forest_params or {})),
             "boosted": training.boosted_pipeline(**(boosted_params or {}))}
    models = {k: training.fit(p, train) for k, p in pipes.items()}
    if model_dir:
        for k, m in models.items():
            training.save(m, f"{model_dir.rstrip('/')}/{k}")
    return models, training.compare(models, feats)


def dashboard_views(readings: DataFrame, **slicer) -> dict[str, DataFrame]:
    """The overview tab: slice (falling back to all rows when empty), then the daily
    summary, KPI cards, hourly profile, day x hour scatter, day totals, heatmap and
    7-day forecast of the slice."""
    e = enrich(filters.slicer_with_fallback(readings, **slicer))
    daily = rollups.daily_summary(e)
    return {
        "daily_summary": daily,
        "daily_kpis": rollups.daily_kpis(daily),
        "avg_by_hour": rollups.avg_by_hour(e),
        "day_hour_distribution": rollups.day_hour_distribution(e),
        "day_totals": rollups.day_totals(e),
        "heatmap_day_hour": reshape.heatmap_day_hour(e),
        "forecast_7d": trends.forecast_7d(e),
    }
