"""Mixing sources to target weights by Poisson replication.

The repetition rate of a source is its target share of the corpus divided by
its own share (in bytes). Each document gets a number of copies drawn from the
Poisson distribution with that mean: a uniform number is taken from a hash of
the seed, the doc_id and the text and looked up in the inverse of the distribution
function, so a retry or a re-run draws the same. Every document is exploded by
its count and all copies are shuffled globally on a hash key.

Only one row per source is aggregated (with map-side combining, so a source
with a third of all rows costs nothing extra); documents move once.

Defined cases: null is a source of its own; a null or empty text counts one
byte; rows that repeat doc_id and text draw the same count, documents without a
doc_id (or with one that others have too) draw each for their own text; a source
without a weight or with weight zero is left out of the mixture.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wattspark.llm.shared import free_name, stage_table

SEED = "mix-1"
#: Temperature weights: the square root of a source's bytes, as an integer of thousandths (integers add up exactly).
TEMPERED = "cast(floor(sqrt(units) * 1000) as bigint)"


def poisson_quantile(u: np.ndarray, rate: float) -> np.ndarray:
    """The least k with P(X <= k) > u for X of a Poisson distribution with this mean."""
    if not rate > 0:
        return np.zeros(len(u), np.int64)
    spread = 12 * math.sqrt(rate) + 40  # what lies outside is less than the resolution of u
    first, last = max(0, math.floor(rate - spread)), math.ceil(rate + spread)
    k = np.arange(first, last + 1)
    logs = first * math.log(rate) - rate - math.lgamma(first + 1) + np.concatenate(
        ([0.0], np.cumsum(math.log(rate) - np.log(k[1:]))))
    return first + np.searchsorted(np.cumsum(np.exp(logs)), u, side="right")


@F.pandas_udf(LongType())
def _copies(u: pd.Series, rate: pd.Series) -> pd.Series:
    out = np.zeros(len(u), np.int64)
    rates, which = np.unique(rate.to_numpy(), return_inverse=True)
    for i, r in enumerate(rates):
        own = which == i
        out[own] = poisson_quantile(u.to_numpy()[own], float(r))
    return pd.Series(out)


def _digest(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def source_rates(documents: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(src, rate): mean number of copies of a document of each source. weights: (source, weight long), default tempered."""
    units = documents.groupBy(F.col("source").alias("src")).agg(
        F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("units"))
    if weights is None:
        units = units.withColumn("weight", F.expr(TEMPERED))
    else:
        w = weights.select(F.col("source").alias("w_src"), F.col("weight").cast("long").alias("weight"))
        units = units.join(w, F.col("src").eqNullSafe(F.col("w_src"))).drop("w_src")
    units = stage_table(units, "mix-units")
    all_units, all_weight = (units.select(F.sum(c)).scalar().cast("double") for c in ("units", "weight"))
    rate = F.col("weight").cast("double") * all_units / (all_weight * F.col("units").cast("double"))
    return units.select("src", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix(documents: DataFrame, weights: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """All columns of ``documents`` plus copy, copies, rate and shuffle_key (underscored where taken), in shuffled order."""
    rates = stage_table(source_rates(documents, weights), "mix-rates")  # its file size decides on a broadcast
    doc = F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("doc")
    text = F.md5(F.coalesce(documents["text"], F.lit("")))
    u = F.conv(F.substring(_digest(seed, documents["doc_id"], text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    drawn = documents.select(doc, u.alias("u"), text.alias("tkey"), F.monotonically_increasing_id().alias("row")).join(
        rates, F.col("doc.source").eqNullSafe(F.col("src")))
    # the generator keeps the optimiser from drawing again in a filter; no copies, no row
    rows = drawn.select("doc", "rate", "tkey", "row", F.explode(F.array(_copies("u", "rate"))).alias("copies")).select(
        "*", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies")))).alias("copy"))
    rows = rows.withColumn("key", _digest(seed + "-order", F.col("doc.doc_id"), F.col("tkey"), F.col("copy")))
    # the row number deals out rows that repeat doc_id and text; it stands in no result
    rows = rows.repartition("key", "row").sortWithinPartitions("key")
    add = {"copy": F.col("copy"), "copies": F.col("copies"), "rate": F.col("rate"), "shuffle_key": F.col("key")}
    return rows.select(*[F.col(f"doc.`{c}`").alias(c) for c in documents.columns],
                       *[v.alias(free_name(documents, k)) for k, v in add.items()])
