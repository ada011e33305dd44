"""Exact grouped quantiles without collecting a group into one task.

``percentile`` keeps a map of every distinct value of a group in one
aggregation buffer, and a window ``row_number() over (partition by group)``
sorts a whole group in one task: both break when one group holds a third of
the data. Here ranks come from counts instead:

1. first pass: bucket the values by a monotone function of the value alone
   (``BUCKETS_PER_E`` buckets for each factor e) and count each bucket, with a
   map-side combine: what is shuffled is at most one row a bucket and task. A
   running sum over this small table gives each bucket's rank offset, and so the
   buckets that hold the wanted ranks (at most two per quantile and group);
2. second pass: rows outside those buckets (a broadcast table of that bounded
   size) are left out in the scan's own stage. Equal values of the rest are
   counted (a value that fills half a group is one row from here on) and
   ordered, each bucket by itself, and the values at the floor and ceiling
   ranks interpolated linearly, the ``quantile_cont`` / ``percentile``
   definition: position p x (n - 1).

Every key is a function of the row, so the result does not depend on how (or
how often) Spark evaluates, splits or reuses any exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_E = 1024
#: Values below this in size share the buckets next to zero.
SMALLEST = 2.0 ** -30


def _bucket(v: Column) -> Column:
    size = F.floor(F.log1p(F.abs(v) / SMALLEST) * BUCKETS_PER_E)
    return F.when(F.isnan(v), F.lit((1 << 63) - 1)).when(v < 0, -size).otherwise(size).cast("long")


def grouped_quantiles(df: DataFrame, group: str, value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with a column per named probability; null groups and null values are left out."""
    v = df.select(F.col(group).alias("_g"), (F.col(value).cast("double") + 0.0).alias("_v")) \
        .where(F.col("_g").isNotNull() & F.col("_v").isNotNull())
    v = v.withColumn("_b", _bucket(F.col("_v")))
    in_group = Window.partitionBy("_g")
    before = in_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = v.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_bc")).select(
        F.col("_g").alias("_bg"), F.col("_b").alias("_bb"), "_bc",
        F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_before"), F.sum("_bc").over(in_group).alias("_n"))

    def ranks(p: float) -> tuple[Column, Column]:
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        return F.floor(pos), F.ceil(pos)

    wanted = [r for p in probs.values() for r in ranks(p)]
    holds = reduce(lambda a, b: a | b, [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_bc")) for r in wanted])
    held = F.broadcast(buckets.where(holds))  # two rows a quantile and group
    rows = v.join(held, (F.col("_g") == F.col("_bg")) & (F.col("_b") == F.col("_bb"))).groupBy("_g", "_b", "_v").agg(
        F.count(F.lit(1)).alias("_c"), F.first("_before").alias("_before"), F.first("_n").alias("_n"))
    earlier = Window.partitionBy("_g", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_c").over(earlier), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_first")) & (rank < F.col("_first") + F.col("_c")), F.col("_v")))

    exprs = []
    for name, p in probs.items():
        lo, hi = ranks(p)
        frac = F.max(F.lit(float(p)) * (F.col("_n") - 1) - lo)
        exprs.append((at(lo) + frac * (at(hi) - at(lo))).alias(name))
    return rows.groupBy(F.col("_g").alias(group)).agg(*exprs)


def season_box(e: DataFrame, approximate: bool = False, accuracy: int = 10000) -> DataFrame:
    """Box summary per season: min, q1, median, q3, max, mean, sample sd.

    ``approximate=True`` uses ``percentile_approx`` (one pass, bounded memory)
    instead of the exact rank computation.
    """
    kwh = F.col("energy_consumption")
    stats = e.where(F.col("season").isNotNull()).groupBy("season").agg(
        F.min(kwh).alias("min_kwh"), F.max(kwh).alias("max_kwh"),
        F.avg(kwh).alias("mean_kwh"), F.stddev_samp(kwh).alias("sd_kwh"))
    probs = {"q1_kwh": 0.25, "median_kwh": 0.5, "q3_kwh": 0.75}
    if approximate:
        q = e.groupBy("season").agg(*[F.percentile_approx(kwh, p, accuracy).alias(n) for n, p in probs.items()])
    else:
        q = grouped_quantiles(e, "season", "energy_consumption", probs)
    return stats.join(q, "season")
