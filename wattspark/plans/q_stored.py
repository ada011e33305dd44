"""Registered queries over stored, mergeable tables (M1-M3, P9, W1-W5, A21-A25, F1-F3, S1), and the schedule with part hours.

Each builds its small table from the whole readings, writes it to the shared
checkpoint folder and answers from what it reads back; most share the oracle
of the query that reads the readings themselves.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from wattspark import constants as C
from wattspark.models import gram, training, trees
from wattspark.operators import daily_flags, error_moments, interval_overlay, slice_rollup
from wattspark.operators.baseline import with_expected_load
from wattspark.operators.enrich import enrich
from wattspark.operators.features import with_features
from wattspark.operators.sampling import train_test_split
from wattspark.operators.target_encoding import FOLDS, WEIGHT, with_encoding
from wattspark.plans import q_features, q_models, q_rollups, q_windows  # noqa: F401 - their oracles are shared
from wattspark.plans.registry import REGISTRY, events, orders, orders_enriched, register
from wattspark.plans.sql import ENRICH, EVENTS_READINGS, ORDERS_BY_CUSTOMER, ORDERS_READINGS, R, with_ctes
from wattspark.session import checkpoint_dir
from wattspark.sources.adapters import events_outage_intervals, orders_by_customer, orders_csv_lines
from wattspark.sources.quarantine import counts_by_reason, read_sorted


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored(df, name: str):
    path = _folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(name: str) -> str:
    return REGISTRY[name].sql


# --- least squares from sufficient statistics (M1) ----------------------------------------------
def _gram(spark, sf):
    """The stored Gram table of the training rows, a row a day."""
    return _stored(gram.gram_table(q_models._features(spark, sf).where(F.col("split") == "train")), "gram")


_PAIRS = gram.pairs()
_NAME = {gram.ONE: "1.0::DOUBLE"}


@register("ols_gram", f"""
WITH f AS ({q_features._FEATURE_SQL.replace('round(', '(').replace(', 6)', ')')}),
t AS (SELECT * FROM f WHERE reading_id % 5 <> 0)
SELECT unnest({[a for a, _ in _PAIRS]}) AS feature_a, unnest({[b for _, b in _PAIRS]}) AS feature_b,
       round(unnest([{', '.join(f'avg(CAST({_NAME.get(a, a)} AS DOUBLE) * CAST({_NAME.get(b, b)} AS DOUBLE))' for a, b in _PAIRS)}]), 6) AS mean_product
FROM t""")
def q_ols_gram(spark, sf):
    """Mean product of every two of (1, features, label) over the training rows, from the stored days."""
    sums = gram.totals(_gram(spark, sf))
    n = sums.where((F.col("feature_a") == gram.ONE) & (F.col("feature_b") == gram.ONE)).select("total").scalar()
    return sums.select("feature_a", "feature_b", (F.col("total") / n).alias("mean_product"))


@register("train_linear_gram", note="R: the metrics of train_linear, from the stored sums")
def q_train_linear_gram(spark, sf):
    return training.evaluate_split(gram.solve(_gram(spark, sf)), q_models._features(spark, sf), training.MODEL_NAMES["linear"])


@register("ols_gram_equations", _same("ols_normal_equations"))
def q_ols_gram_equations(spark, sf):
    """The normal equations hold for the line solved from the stored sums."""
    moments = training.normal_equations(gram.solve(_gram(spark, sf)), q_models._features(spark, sf).where(F.col("split") == "train"))
    return moments.select("feature", (F.round("moment", 5) + F.lit(0.0)).alias("moment"))


# --- trees as node tables (M2, M3) --------------------------------------------------------------
def _nodes(spark, sf, kind):
    """The node table of a fitted model, read from its saved form once, with the number of trees and their depth.

    A forest that no query of the session has fitted yet is saved while it grows: 100 trees of depth 15 are some millions
    of nodes, which the driver would hold for nothing but to write them out."""
    def make():
        path = _folder(spark, f"model-{kind}")
        if kind == "forest" and q_models._kept(spark, sf, kind) is None:
            weights, depth = training.fit_saved_forest(training.forest_pipeline(), q_models._train(spark, sf), path)
        else:
            model = q_models._model(spark, sf, kind)
            training.save_trees(model, path)
            weights, (_, depth) = model.stages[-1].treeWeights, trees.shape(model)
        return _stored(trees.node_table_by_tree(spark, path, weights), f"nodes-{kind}"), len(weights), depth
    return q_models._once(spark, sf, f"nodes-{kind}", make)


@register("boosted_routed", """
SELECT CAST(sum(CASE WHEN reading_id % 5 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS train_rows, count(*) AS all_rows, 0.0::DOUBLE AS largest_difference
FROM (SELECT o_orderkey AS reading_id FROM orders)""")
def q_boosted_routed(spark, sf):
    """Predictions routed through the node table of the boosted model against those of the model itself."""
    vecs = _stored(trees.vectors(q_models._features(spark, sf), C.FEATURES, C.LABEL, "split", *C.FEATURES), "vectors")
    routed = trees.predictions(vecs.drop(*C.FEATURES), *_nodes(spark, sf, "boosted"), mean=False)
    own = q_models._model(spark, sf, "boosted").transform(vecs).select("x", "split", F.col("predicted").alias("own"))
    both = routed.join(own, ["x", "split"])
    difference = F.round(F.max(F.abs(F.col("predicted") - F.col("own"))), 6)
    return both.agg(F.sum(F.when(F.col("split") == "train", F.col("n"))).alias("train_rows"), F.sum("n").alias("all_rows"),
                    difference.alias("largest_difference"))


@register("tree_leaf_rows", """
SELECT model, CAST(tree AS INTEGER) AS tree, (SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0) AS train_rows
FROM (VALUES ('boosted'), ('forest')) AS m(model), range(0, 100) AS t(tree)""")
def q_tree_leaf_rows(spark, sf):
    """The leaves of every tree of both models hold every training row once."""
    vecs = trees.vectors(q_models._features(spark, sf).where(F.col("split") == "train"))
    out = [trees.route(vecs, *_nodes(spark, sf, kind)).groupBy("tree").agg(F.sum("n").alias("train_rows")).select(
        F.lit(kind).alias("model"), "tree", "train_rows") for kind in ("boosted", "forest")]
    return out[0].unionByName(out[1])


@register("min_split_effect", note="R: what the original's minimum split size changes")
def q_min_split_effect(spark, sf):
    """Per model: inner nodes, those with too few training rows, those left after folding (none), and errors before and after."""
    rows = q_models._features(spark, sf)
    vecs = _stored(trees.vectors(rows, C.FEATURES, C.LABEL, "split"), "vectors")
    train = vecs.where(F.col("split") == "train")
    out = []
    for kind in ("boosted", "forest"):
        nodes, n, depth = _nodes(spark, sf, kind)
        counts = _stored(trees.rows_per_node(train, nodes, n, depth), "node-rows")
        folded = _stored(trees.with_min_split(nodes, counts, C.MIN_SPLIT), "folded")
        parts = [nodes.agg(F.lit(kind).alias("model"), F.count_if(F.col("left") != trees.LEAF).alias("inner_nodes")),
                 trees.too_small(nodes, counts, C.MIN_SPLIT).agg(F.count(F.lit(1)).alias("too_small")),
                 trees.too_small(folded, counts, C.MIN_SPLIT).agg(F.count(F.lit(1)).alias("too_small_after"))]
        for name, table in (("before", nodes), ("after", folded)):
            p = trees.predictions(vecs, table, n, depth, mean=kind == "forest")
            parts.append(p.agg(trees.rmse(F.col("split") == "train").alias(f"train_rmse_{name}"), trees.rmse(F.col("split") == "test").alias(f"test_rmse_{name}")))
        rows_ = [_stored(part, "min-split") for part in parts]  # a row each
        out.append(rows_[0].select("*", *[r.select(c).scalar().alias(c) for r in rows_[1:] for c in r.columns]))
    return out[0].unionByName(out[1])


# --- open households (P9) -----------------------------------------------------------------------
_OTHERS = " UNION ALL ".join(f"SELECT * EXCLUDE (f), {f} AS f FROM t WHERE f <> {f}" for f in range(FOLDS)) + f" UNION ALL SELECT * EXCLUDE (f), {FOLDS} FROM t"


@register("household_encoding", with_ctes(ORDERS_BY_CUSTOMER, f"""
s AS (SELECT *, CASE WHEN reading_id % 5 = 0 THEN {FOLDS} ELSE (reading_id // 5) % {FOLDS} END AS f FROM r),
t AS (SELECT household_id, energy_consumption AS y, f FROM s WHERE f < {FOLDS} AND energy_consumption IS NOT NULL),
o AS ({_OTHERS}),
m AS (SELECT f, avg(y) AS mean FROM o GROUP BY f),
h AS (SELECT household_id, f, sum(y) AS s, count(*) AS n FROM o GROUP BY household_id, f)""", body=f"""
SELECT s.reading_id, s.household_id, {R(f'(coalesce(h.s, 0) + {WEIGHT} * m.mean) / (coalesce(h.n, 0) + {WEIGHT})')} AS household_encoding
FROM s JOIN m ON m.f = s.f LEFT JOIN h ON h.household_id = s.household_id AND h.f = s.f"""))
def q_household_encoding(spark, sf):
    """Every customer is a household: a number each instead of a column each."""
    rows = train_test_split(orders_by_customer(spark, sf))
    return with_encoding(rows, rows.where("split = 'train'")).select("reading_id", "household_id", "household_encoding")


@register("train_linear_open", note="R: fit on the encoding of an open set of households")
def q_train_linear_open(spark, sf):
    rows = _stored(train_test_split(with_features(orders_by_customer(spark, sf))), "open-features")
    rows = _stored(with_encoding(rows, rows.where("split = 'train'")), "open-encoded")
    features = [f for f in C.FEATURES if not f.startswith("household_")] + ["household_encoding"]
    model = gram.solve(gram.gram_table(rows.where("split = 'train'"), features), features)
    return training.evaluate_split(model, rows, "Linear Regression, open households")


# --- flags kept up batch by batch (W1-W5) -------------------------------------------------------
@register("outage_flags_incremental", _same("outage_flags"))
def q_outage_flags_incremental(spark, sf):
    """Year by year, each batch with the state that the one before left."""
    r = orders(spark, sf)
    years = [y[0] for y in r.select(F.year("timestamp")).where("timestamp is not null").distinct().orderBy(F.year("timestamp")).collect()]
    ends = [dt.datetime(y + 1, 1, 1) for y in years[:-1]]
    f = daily_flags.run(r, ends, _folder(spark, "flags"))
    return f.select("reading_id", "is_outage", "before_outage", "after_outage", "prev_stage", "next_stage")


# --- errors from daily moments (A21-A25) --------------------------------------------------------
def _moments(spark, sf):
    return _stored(error_moments.moments(enrich(with_expected_load(orders(spark, sf)))), "moments")


@register("error_metrics_stored", _same("error_metrics"))
def q_error_metrics_stored(spark, sf):
    return error_moments.error_metrics(_moments(spark, sf))


@register("prediction_bands_stored", _same("prediction_bands"))
def q_prediction_bands_stored(spark, sf):
    return error_moments.prediction_bands(_moments(spark, sf))


@register("scenario_errors_stored", _same("scenario_errors"))
def q_scenario_errors_stored(spark, sf):
    return error_moments.scenario_errors(_moments(spark, sf))


@register("residual_normal_fit_stored", _same("residual_normal_fit"))
def q_residual_normal_fit_stored(spark, sf):
    return error_moments.residual_normal_fit(_moments(spark, sf))


# --- slices from the rollup (F1-F3, A10, A14, A15) ----------------------------------------------
def _slices(spark, sf):
    path = _folder(spark, "rollup")
    slice_rollup.write(slice_rollup.rollup(orders_enriched(spark, sf)), path)
    return slice_rollup.read(spark, path)


_SLICE_SQL = """WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-10-31'
  AND day_name IN ('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday') AND hour BETWEEN 6 AND 21"""


@register("avg_by_hour_stored", _same("avg_by_hour_sliced"))
def q_avg_by_hour_stored(spark, sf):
    return slice_rollup.avg_by_hour(slice_rollup.sliced(_slices(spark, sf), **q_rollups._SLICE))


@register("daily_summary_stored", with_ctes(ORDERS_READINGS, ENRICH, body=f"""
SELECT date, {R('sum(energy_consumption)')} AS total_kwh, {R('avg(energy_consumption)')} AS avg_kwh,
       {R('max(energy_consumption)')} AS max_kwh, {R('min(energy_consumption)')} AS min_kwh, dayname(date) AS day_name
FROM e {_SLICE_SQL} GROUP BY date"""))
def q_daily_summary_stored(spark, sf):
    return slice_rollup.daily_summary(slice_rollup.sliced(_slices(spark, sf), **q_rollups._SLICE))


@register("day_hour_stored", with_ctes(ORDERS_READINGS, ENRICH, body=f"""
SELECT day_name, hour, {R('avg(energy_consumption)')} AS avg_kwh, {R('sum(energy_consumption)')} AS total_kwh
FROM e {_SLICE_SQL} AND household_id IN ('House_2', 'House_5') GROUP BY day_name, hour"""))
def q_day_hour_stored(spark, sf):
    return slice_rollup.day_hour_distribution(slice_rollup.sliced(_slices(spark, sf), households=["House_2", "House_5"], **q_rollups._SLICE))


@register("slicer_fallback_stored", _same("slicer_fallback"))
def q_slicer_fallback_stored(spark, sf):
    return slice_rollup.daily_summary(slice_rollup.with_fallback(_slices(spark, sf), start_date="1990-01-01", end_date="1990-12-31"))


@register("kpi_cards_stored", _same("kpi_cards"))
def q_kpi_cards_stored(spark, sf):
    return slice_rollup.kpi_cards(_slices(spark, sf))


# --- bad rows of a CSV (S1) ---------------------------------------------------------------------
def _sorted_csv(spark, sf):
    path = _folder(spark, "readings-csv")
    orders_csv_lines(spark, sf).write.text(path)
    return read_sorted(spark, path, header=False)


@register("readings_quarantine", with_ctes(ORDERS_READINGS, body="""
SELECT reason, count(*) AS lines FROM (
  SELECT CASE reading_id % 97 WHEN 1 THEN 'timestamp unreadable' WHEN 2 THEN 'energy_consumption unreadable'
              WHEN 3 THEN 'load_shedding_stage out of range' WHEN 4 THEN 'wrong number of fields' WHEN 5 THEN 'wrong number of fields'
              WHEN 6 THEN 'backup_power unreadable' WHEN 8 THEN 'energy_consumption out of range' END AS reason FROM r)
WHERE reason IS NOT NULL GROUP BY reason"""))
def q_readings_quarantine(spark, sf):
    return counts_by_reason(_sorted_csv(spark, sf).bad)


@register("readings_recovered", with_ctes(ORDERS_READINGS, body=f"""
SELECT household_id, count(*) AS readings, count(CASE WHEN reading_id % 97 <> 7 THEN energy_consumption END) AS with_kwh,
       {R('sum(CASE WHEN reading_id % 97 <> 7 THEN energy_consumption END)')} AS total_kwh,
       max("timestamp") AS last, CAST(count_if(load_shedding_stage > 0) AS BIGINT) AS outages, CAST(count_if(backup_power) AS BIGINT) AS backups
FROM r WHERE reading_id % 97 NOT IN (1, 2, 3, 4, 5, 6, 8) GROUP BY household_id"""))
def q_readings_recovered(spark, sf):
    """What the lines that fit the schema hold."""
    return _sorted_csv(spark, sf).good.groupBy("household_id").agg(
        F.count(F.lit(1)).alias("readings"), F.count("energy_consumption").alias("with_kwh"), F.sum("energy_consumption").alias("total_kwh"),
        F.max("timestamp").alias("last"), F.count_if(F.col("load_shedding_stage") > 0).alias("outages"), F.count_if("backup_power").alias("backups"))


# --- schedule with part hours (X2) --------------------------------------------------------------
@register("outage_overlay_minutes", with_ctes(EVENTS_READINGS, """
s AS (SELECT event_id AS seq, ts AS start, ts + to_minutes(CAST((k % 4 + 2) * 37 AS INTEGER)) AS stop, k % 6 + 1 AS stage
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error'))""", """
h AS (SELECT reading_id, arg_max(s.stage, s.seq) AS stage FROM r JOIN s ON r."timestamp" >= s.start AND r."timestamp" < s.stop GROUP BY reading_id)""",
body="""
SELECT r.reading_id, r.household_id, r."timestamp", CAST(coalesce(h.stage, 0) AS INTEGER) AS load_shedding_stage FROM r LEFT JOIN h USING (reading_id)"""))
def q_outage_overlay_minutes(spark, sf):
    """Entries begin and end at any moment; the latest one holds."""
    out = interval_overlay.overlay(events(spark, sf), events_outage_intervals(spark, sf))
    return out.select("reading_id", "household_id", "timestamp", "load_shedding_stage")
