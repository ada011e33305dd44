"""Approximate nearest neighbours with an inverted multi-index (largest cosine).

Unit vectors are cut into two halves, each quantised with its own codebook, so
many cells come from two small codebooks: the number of centroids grows with the
root of the table, to about ``PER_CELL`` entries a cell, up to ``MOST``. A query walks the
pairs of centroids by summed distance, nearest pair first, with a heap (the
multi-sequence walk), until the cells it has met hold the asked share of all
entries; those entries are ranked by their exact cosine in double precision.

* Codebooks are fitted on a sample of ``SAMPLE`` vectors on average, chosen by
  a hash of id and vector. On the same sample the smallest share of entries is measured that
  reaches ``TARGET`` recall against brute force; where vectors have structure
  it is small, on vectors without any it is large. Every row is indexed.
* Entries are dealt by cell into blocks of about ``BLOCK`` rows; a cell with
  more (many copies of one vector) is split over several blocks by a hash.
* Queries are put into groups of at most ``QUERIES`` that start from the same
  cells. A query group meets only the blocks that one of its queries visits,
  one task a pair (group, block), which returns each query's best ``k``.

What the driver sees: the sample, the number of entries of each cell (at most
``MOST`` squared), and both codebooks, whatever the size of the table.

Defined cases: null, zero or other-sized vectors and those with null or
non-finite components take no part, nor do rows without a vec_id (the size is
the most frequent one); rows that repeat vec_id and vector count once; a query
never finds its own vec_id; with fewer candidates than k all are returned.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattspark.llm.shared import stage_table

LEAST, MOST, PER_CELL = 16, 256, 16
SAMPLE, SAMPLE_QUERIES, ROUNDS, TARGET = 8_000, 150, 12, 0.97
BLOCK, QUERIES, SEED = 4_096, 1_024, 29


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def distances(half: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((half * half).sum(axis=1)[:, None] - 2 * half @ book.T + (book * book).sum(axis=1), 0)


def codebook(half: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from spread-out rows; an empty centroid keeps its place."""
    rows = np.unique(half, axis=0)
    book = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = distances(half, book).argmin(axis=1)
        n = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, half)
        book[n > 0] = total[n > 0] / n[n > 0, None]
    return book


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells by summed distance of their two centroids until they hold ``wanted`` entries. counts: entries by (left, right)."""
    i_by, j_by = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    left, right, counts = left.tolist(), right.tolist(), counts.tolist()
    width, have, cells = len(right), 0, []
    heap, reached = [(left[i_by[0]] + right[j_by[0]], 0, 0)], [0] * len(left)
    while heap and have < wanted:
        _, a, b = heapq.heappop(heap)
        i, j = i_by[a], j_by[b]
        if counts[i][j]:
            cells.append(i * width + j)
            have += counts[i][j]
        reached[a] = b + 1
        # a pair is due once the pair before it in either list has been met
        if b + 1 < len(j_by) and (a == 0 or reached[a - 1] > b + 1):
            heapq.heappush(heap, (left[i] + right[j_by[b + 1]], a, b + 1))
        if a + 1 < len(i_by) and reached[a + 1] == b:
            heapq.heappush(heap, (left[i_by[a + 1]] + right[j], a + 1, b))
    return cells


@dataclass
class Index:
    left: np.ndarray
    right: np.ndarray
    share: float

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.left.shape[1]
        return distances(units[:, :cut], self.left), distances(units[:, cut:], self.right)

    def cells(self, units: np.ndarray) -> np.ndarray:
        a, b = self.distances(units)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)


def centroids_for(total: int) -> int:
    """Centroids of each half for so many entries: the power of two next to the root of their number over PER_CELL."""
    return int(min(MOST, max(LEAST, 2 ** round(math.log2(max(1.0, total / PER_CELL)) / 2))))


def fit(sample: np.ndarray, k: int = 5, centroids: int = LEAST, target: float = TARGET) -> Index:
    """Codebooks and the share of entries to visit, from sample vectors."""
    units = unit(sample)
    cut = max(1, units.shape[1] // 2)
    index = Index(codebook(units[:, :cut], centroids), codebook(units[:, cut:], centroids), 1.0)
    counts = np.bincount(index.cells(units), minlength=len(index.left) * len(index.right))
    table, cell = counts.reshape(len(index.left), -1), index.cells(units)
    asked = np.linspace(0, len(units) - 1, min(SAMPLE_QUERIES, len(units))).astype(int)
    near = units[asked] @ units.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-near, axis=1)[:, :k]
    needed = []
    for q, top, a, b in zip(asked, best, *index.distances(units[asked])):
        order = walk(a, b, table, len(units))
        met = np.full(len(counts), 1.0)
        met[order] = np.cumsum(counts[order]) / len(units)  # the share visited once a cell is met
        needed += met[cell[top]].tolist()
    index.share = float(min(1.0, np.quantile(needed, target) + 0.02)) if needed else 1.0
    return index


def _finite(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(ok)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0)).distinct()


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, centroids: int | None = None, target: float = TARGET) -> DataFrame:
    """For every row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score of the k nearest found."""
    rows = stage_table(_finite(vectors), "imi-rows")
    spark, schema = rows.sparkSession, "query_id long, rank int, vec_id long, score double"
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    million = 1_000_000
    draw = F.pmod(F.xxhash64("vec_id", "v", F.lit(SEED)), F.lit(million))
    sample = rows.where(draw < min(million, -(-SAMPLE * million // total))).select("v", "vec_id").toPandas()
    if sample.empty:
        sample = rows.limit(SAMPLE).select("v", "vec_id").toPandas()
    sample = sample.assign(order=sample["v"].map(tuple)).sort_values(["vec_id", "order"], kind="stable")
    index = fit(np.array(sample["v"].tolist()), k, centroids or centroids_for(total), target)
    shared = spark.sparkContext.broadcast(index)

    def to_cells(batches):
        for pdf in batches:
            yield pdf.assign(cell=shared.value.cells(unit(np.array(pdf["v"].tolist()))) if len(pdf) else np.empty(0, int))

    entries = stage_table(rows.mapInPandas(to_cells, "vec_id long, v array<double>, cell int"), "imi-entries")
    counts = np.zeros(len(index.left) * len(index.right), np.int64)
    for r in entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most centroids squared rows
        counts[r["cell"]] = r["n"]
    # cells in a row share a block; a cell larger than a block has several of its own
    parts = np.maximum(1, -(-counts // BLOCK))
    first, at, room = np.zeros(len(counts), np.int64), 0, BLOCK
    for c in np.flatnonzero(counts):
        if counts[c] > room:
            at, room = at + 1, BLOCK
        first[c] = at
        if parts[c] > 1:
            at, room = at + int(parts[c]), BLOCK
        else:
            room -= int(counts[c])
    plan = spark.sparkContext.broadcast((counts, first, parts))
    wanted = max(int(np.ceil(index.share * total)), 20 * k)

    def to_blocks(batches):
        _, first, parts = plan.value
        for pdf in batches:
            c, ids = pdf["cell"].to_numpy(), pdf["vec_id"].to_numpy()
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield pdf.assign(block=first[c] + spread % parts[c])

    def to_visits(batches):
        counts, first, parts = plan.value
        index = shared.value
        table = counts.reshape(len(index.left), -1)
        for pdf in batches:
            out = []
            for q, v, group, a, b in zip(pdf["vec_id"], pdf["v"], pdf["grp"], *index.distances(unit(np.array(pdf["v"].tolist()))) if len(pdf) else ([], [])):
                cells = np.array(walk(a, b, table, wanted))
                seen = np.zeros(len(counts), bool)
                seen[cells] = True
                blocks = np.unique(np.concatenate([first[c] + np.arange(parts[c]) for c in cells]))
                out.append((q, v, group, np.packbits(seen).tobytes(), blocks.tolist()))
            yield pd.DataFrame(out, columns=["query_id", "v", "grp", "seen", "blocks"])

    def search(key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if queries.empty or block.empty:
            return none
        x, q = np.array(block["v"].tolist()), np.array(queries["v"].tolist())
        ids, cell = block["vec_id"].to_numpy(), block["cell"].to_numpy()
        size_x, size_q = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        out = []
        rough = (q / size_q[:, None]) @ (x / size_x[:, None]).T
        for i, (qid, seen) in enumerate(zip(queries["query_id"], queries["seen"])):
            met = np.unpackbits(np.frombuffer(seen, np.uint8)).astype(bool)
            own = np.flatnonzero(met[cell] & (ids != qid))
            if len(own) > k:
                r = rough[i, own]
                own = own[r >= np.partition(r, len(r) - k)[len(r) - k] - 1e-9]
            exact = (x[own] * q[i]).sum(axis=1) / (size_q[i] * size_x[own])
            best = np.lexsort((ids[own], -exact))[:k]
            out += [(qid, int(ids[own[j]]), float(exact[j])) for j in best]
        return pd.DataFrame(out, columns=none.columns).astype(none.dtypes.to_dict()) if out else none

    blocks = entries.mapInPandas(to_blocks, "vec_id long, v array<double>, cell int, block long")
    asked = entries.where(F.col("vec_id") % every == 0)
    # groups of queries that start from neighbouring cells: rows are numbered within ranges of cells
    n_groups = max(1, -(-total // every // QUERIES))
    order = stage_table(asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "imi-query-cells").select(
        "cell", (F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))).alias("before"), "n")  # at most centroids squared rows
    grp = (F.coalesce("before", F.lit(0)) + F.pmod(F.xxhash64("vec_id"), F.col("n"))) * n_groups
    n_asked = F.greatest(F.lit(1), F.lit(asked.count()))
    asked = asked.join(order, "cell").select("vec_id", "v", F.floor(grp / n_asked).cast("long").alias("grp"))
    visits = stage_table(asked.mapInPandas(to_visits, "query_id long, v array<double>, grp long, seen binary, blocks array<long>"), "imi-visits")
    met = visits.select("query_id", "v", "grp", "seen", F.explode("blocks").alias("block"))
    pairs = met.select(F.col("grp").alias("to_grp"), F.col("block").alias("to_block")).distinct()
    sent = blocks.join(pairs, F.col("block") == F.col("to_block")).select("vec_id", "v", "cell", "to_grp", "to_block")
    found = met.groupBy("grp", "block").cogroup(sent.groupBy("to_grp", "to_block")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
