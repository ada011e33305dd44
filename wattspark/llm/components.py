"""Connected components of a link table by alternating large-star and small-star rounds.

Only links move; nothing is collected. Each round takes the minimum neighbour
with a map-side combined aggregate and joins it back, so a node with very many
links is split by the adaptive skew join and never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.llm.shared import stage_table


def _star(both: DataFrame, small: bool) -> DataFrame:
    """both: (u, v). Large star links larger neighbours of u to the least of u and its neighbours; small star the smaller ones and u."""
    own = both.where("v < u") if small else both
    least = own.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if small:
        linked = own.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        linked = linked.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        linked = own.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # u itself keeps a link to its least neighbour
        linked = linked.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def roots(links: DataFrame) -> DataFrame:
    """links (a, b) of one orderable type -> (node, root): root is the least node reachable; unlinked nodes have no row."""
    edges = stage_table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                        "links")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, small=False)
        edges = stage_table(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), small=True), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
