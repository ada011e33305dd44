"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Documents with equal texts form a group. A group is placed on the shard where
the weighted dot product of its size vector (bytes, tokens, rows, each as a
share of the total) with the shard's residual capacity is highest.

* A group with more than a fiftieth of a shard is split by a hash of its
  doc_ids into parts of about that size, so a group of copies that holds a
  third of all rows fills several shards evenly; where rows of it repeat the
  doc_id too, they are split by their number in the written table of sizes.
  Every other group stays whole.
* Parts that are large for a lane (at most ``12 * shards * lanes`` of them, four
  for each measure, by their definition) are packed first, on the driver.
* All others are packed in parallel lanes: a lane takes the groups of one hash
  value and its proportional share of each shard's residual capacity, largest
  group first. A lane is one task with bounded rows.
* Slots count from 0 without a gap in each shard: rows are numbered within
  (shard, hash bucket), and the buckets' sizes give the offsets.

Defined cases: a null text has no bytes and no tokens and equals the empty
text; repeated rows are separate rows of one group, alike in all but their
slots, and split like others; so are rows with a null doc_id; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark.llm.shared import free_name, stage_table

SPACE = r"[\x09-\x0D\x20]+"
OVERHEAD = 16
LANE_ROWS, MAX_LANES = 20_000, 4_096
PARTS_PER_SHARD = 50
#: Weight of bytes, tokens and rows in the dot product; the law that holds is near-equal bytes.
WEIGHTS = np.array([8.0, 1.0, 1.0])
BUCKET_ROWS = 20_000
#: Rows equal in doc_id and text are told apart if they are more than this and more than one in MOST_SAME of all.
SAME_ROWS, MOST_SAME = 50, 20_000


def n_tokens(text: Column) -> Column:
    """White-space separated words of a text."""
    return F.size(F.array_remove(F.split(text, SPACE), ""))


def pack(units: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each unit (rows of shares), largest first; ``residual`` (shards x shares) is reduced in place."""
    out = np.empty(len(units), np.int32)
    weighted = units * WEIGHTS
    for i in np.lexsort((-units[:, 0], -units.max(axis=1))):
        out[i] = best = int(np.argmax(residual @ weighted[i]))
        residual[best] -= units[i]
    return out


def measured(documents: DataFrame, carry: list[str]) -> DataFrame:
    """(doc, dkey, gkey, size, crc, tokens) of every row, written once. dkey: a hash of the doc_id and, where many rows
    repeat doc_id and text, of the row's number, so that it deals out any group."""
    text = F.coalesce("text", F.lit(""))
    rows = stage_table(documents.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)).alias("dkey"),
        F.md5(text).alias("gkey"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), n_tokens(text).cast("long").alias("tokens"),
        F.monotonically_increasing_id().alias("row")), "shard-rows")
    same = rows.groupBy("gkey", "dkey").agg(F.count(F.lit(1)).alias("same")).where(
        (F.col("same") > SAME_ROWS) & (F.col("same") * MOST_SAME > rows.select(F.count(F.lit(1))).scalar()))
    # of rows that add up to all: fewer than MOST_SAME
    return rows.join(F.broadcast(same), ["gkey", "dkey"], "left").withColumn(
        "dkey", F.when(F.col("same").isNull(), F.col("dkey")).otherwise(F.xxhash64("dkey", "row"))).drop("same", "row")


def place(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """rows of ``measured`` -> (rows with their part, the shard of every (gkey, part))."""
    totals = rows.agg(F.count(F.lit(1)), F.sum("size"), F.sum("tokens")).first()
    n, size, tokens = (max(1, int(x or 0)) for x in totals)
    groups = rows.groupBy("gkey").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("tokens").alias("tokens"))
    share = F.greatest(F.col("n") / n, F.col("size") / size, F.col("tokens") / tokens)
    parts = F.ceil(share * shards * PARTS_PER_SHARD).cast("int")
    # a group with over 1/(shards * PARTS_PER_SHARD) of a total: at most 3 * shards * PARTS_PER_SHARD groups
    hot = groups.select("gkey", parts.alias("parts")).where("parts > 1")
    dealt = rows.join(F.broadcast(hot), "gkey", "left").withColumn(
        "part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.col("dkey"), F.col("parts")).cast("int"))).drop("parts")
    lanes = min(MAX_LANES, max(1, n // LANE_ROWS))
    unit = F.greatest(F.col("n") / n, F.col("size") / size, F.col("tokens") / tokens)
    units = stage_table(
        dealt.groupBy("gkey", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("tokens").alias("tokens"))
        .select("gkey", "part", (F.col("size") / size).alias("a"), (F.col("tokens") / tokens).alias("b"), (F.col("n") / n).alias("c"),
                (unit > 1 / (4 * shards * lanes)).alias("large"),
                F.pmod(F.xxhash64("gkey", "part"), F.lit(lanes)).alias("lane")), "shard-units")
    large = units.where("large").select("gkey", "part", "a", "b", "c").toPandas().sort_values(["gkey", "part"])
    residual = np.full((shards, 3), 1 / shards)
    large["shard"] = pack(large[["a", "b", "c"]].to_numpy(), residual) if len(large) else np.empty(0, np.int32)
    room = residual / np.maximum(residual.sum(axis=0), 1e-300)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("gkey", "ascending"), ("part", "ascending")])
        u = np.column_stack([group[c].to_numpy() for c in "abc"])
        return pa.table({"gkey": group["gkey"], "part": group["part"], "shard": pack(u, room * u.sum(axis=0))})

    small = units.where("not large").groupBy("lane").applyInArrow(run, "gkey string, part int, shard int")
    spark = rows.sparkSession
    placed = spark.createDataFrame(large[["gkey", "part", "shard"]], "gkey string, part int, shard int") if len(large) else None
    return dealt, small.unionAll(placed) if placed is not None else small


def shard(documents: DataFrame, shards: int = 40, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) plus size, text_crc32, law, shard, slot and grown_shard (null: this law has none).

    Appended columns whose name is taken get a trailing underscore.
    """
    carry = documents.columns if carry is None else carry
    rows = measured(documents, carry)
    dealt, placed = place(rows, shards)
    mine = dealt.join(stage_table(placed, "shard-places"), ["gkey", "part"])
    buckets = max(1, rows.count() // (shards * BUCKET_ROWS))
    mine = mine.withColumn("bucket", F.pmod(F.xxhash64("dkey", "gkey"), F.lit(buckets)))
    sizes = stage_table(mine.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")), "shard-buckets")
    offsets = sizes.selectExpr("shard", "bucket", "sum(n) over (partition by shard order by bucket) - n as offset")
    numbered = mine.withColumn("at", F.expr("row_number() over (partition by shard, bucket order by dkey, gkey)"))
    out = numbered.join(offsets, ["shard", "bucket"])
    first = documents.select(*[F.col(f"`{c}`") for c in carry])
    add = {"size": F.col("size"), "text_crc32": F.col("crc"), "law": F.lit("bytes"), "shard": F.col("shard"),
           "slot": (F.col("offset") + F.col("at") - 1).cast("long"), "grown_shard": F.lit(None).cast("int")}
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in carry], *[v.alias(free_name(first, k)) for k, v in add.items()])
