"""Prefix trie of conversations, its subtree totals by time-forward processing.

**Turns.** All turns are sorted once over the cluster (conversation, turn, content),
and numbered in their sorted runs; a conversation that goes on over several
runs gets the missing offset from a table of the runs' ends (two rows a run).
So no task holds a conversation, however long.

**Nodes.** A turn's content is a 128-bit digest, a prefix is the exclusive-or of two
64-bit hashes of (place, digest) of its turns. Running values are taken in
pieces of ``PIECE`` turns. Texts are never shuffled. Members, smallest member and
bytes of a node are one aggregation with map-side combining.

**Totals.** A node with one member has no branches below it: it has one leaf and
saves nothing. The shared nodes are worked off in reverse level order, deepest
first (Spark's external sort); each takes its children's totals off a priority
queue keyed by (level, node) and puts its own on it for its parent. The queue
holds ``HELD`` messages in memory and spills sorted runs beyond that. Nodes with
over ``1 / TOP`` of all nodes' members (at most ``TOP`` of them) are the top of the
trie; every subtree below them is a shard's, and shards run in parallel. The
sums of the shards' roots are added up for each parent, and the top is worked
off in the same way.

Ends of a node are hashed in ranges of ``ENDS`` conversation ids, which are joined
first and then streamed through SHA-256 in order.

Defined cases: rows with a null conv_id are no conversation; a null turn comes
first; equal turns of a conversation stand in the order of their content's
digest, so repeated rows stand next to each other; null role or text is empty;
conv_id modulo five is never negative; an empty table gives no rows, also no root.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.llm.shared import stage_table

PIECE, ENDS = 4_096, 65_536
TOP, LEAST_TOP = 10_000, 1_000
HELD = 1 << 18
FAMILY, MOST_BORROWED = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "x1", "x2"]


class SpillingQueue:
    """A priority queue of tuples of integers; what is over ``held`` in memory goes to sorted runs in the task's own spill file."""

    def __init__(self, held: int | None = None):
        self._held = held or HELD
        self._heap: list[tuple[int, ...]] = []
        #: Next item, number of the run, the rest of it; no two runs have one number, so rests are never compared.
        self._runs: list[tuple[tuple[int, ...], int, Iterator[tuple[int, ...]]]] = []
        self._spills = 0
        self._file = None

    def push(self, item: tuple[int, ...]) -> None:
        heapq.heappush(self._heap, item)
        if len(self._heap) > self._held:
            self._spill()

    def _spill(self) -> None:
        """The larger half becomes a run."""
        self._heap.sort()
        half = len(self._heap) // 2
        rest = np.array(self._heap[half:], np.int64)
        del self._heap[half:]
        if self._file is None:
            self._file = tempfile.TemporaryFile()  # nameless: gone with the task, as Spark's own spills are
        self._file.seek(0, 2)
        at = self._file.tell()
        self._file.write(rest.tobytes())
        run = self._read(at, *rest.shape)
        heapq.heappush(self._runs, (next(run), self._spills, run))
        self._spills += 1

    def _read(self, at: int, n: int, width: int) -> Iterator[tuple[int, ...]]:
        step = 4_096
        for i in range(0, n, step):
            self._file.seek(at + i * width * 8)
            rows = np.frombuffer(self._file.read(min(step, n - i) * width * 8), np.int64).reshape(-1, width)
            yield from map(tuple, rows.tolist())

    def take(self, prefix: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """The items that begin with ``prefix``; lesser ones, for nodes that are not here, are dropped."""
        size = len(prefix)
        while True:
            run = self._runs and (not self._heap or self._runs[0][0] < self._heap[0])
            if not run and not self._heap:
                return
            item = self._runs[0][0] if run else self._heap[0]
            if item[:size] > prefix:
                return
            if run:
                _, number, rest = self._runs[0]
                ahead = next(rest, None)
                if ahead is None:
                    heapq.heappop(self._runs)
                else:
                    heapq.heapreplace(self._runs, (ahead, number, rest))
            else:
                heapq.heappop(self._heap)
            if item[:size] == prefix:
                yield item


# --- turns --------------------------------------------------------------------

def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, digest, bytes): the place of every turn in its conversation, from 0. Stored."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    # the row only parts repeated rows, which are alike, so a third of all rows may be equal
    ordered = turns.sort(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")).select("conv_id", "digest", "bytes")

    def run(batches):
        part, before, number, begun = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            conv = b.column(0).to_numpy()
            if not len(conv):
                continue
            new = np.concatenate(([before is None or conv[0] != before], conv[1:] != conv[:-1]))
            starts = np.flatnonzero(new)
            at = np.arange(len(conv)) + number
            if len(starts):
                at[starts[0]:] = np.arange(starts[0], len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
            which = begun + np.cumsum(new)
            before, number, begun = conv[-1], int(at[-1]) + 1, int(which[-1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(at), b.column(1), b.column(2), pa.array(np.full(len(conv), part), pa.int32()), pa.array(which == 1)],
                ["conv_id", "at", "digest", "bytes", "part", "first"])

    out = stage_table(ordered.mapInArrow(run, "conv_id long, at long, digest string, bytes long, part int, first boolean"), "trie-turns")
    runs = out.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max(F.struct("conv_id", "at")).alias("hi"))
    offsets, carried, conv = [], 0, None
    for r in runs.orderBy("part").collect():  # a row a sorted run: as many as the session has shuffle partitions
        own = carried if r.lo == conv else 0
        if own:
            offsets.append((r.part, own))
        carried = (own if r.hi.conv_id == r.lo else 0) + r.hi["at"] + 1
        conv = r.hi.conv_id
    if not offsets:
        return out.select("conv_id", "at", "digest", "bytes")
    shift = out.sparkSession.createDataFrame(offsets, "part int, offset long")
    return out.join(F.broadcast(shift), "part", "left").selectExpr(
        "conv_id", "at + if(first, coalesce(offset, 0L), 0L) as at", "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, digest, bytes, size) of the rebuilt conversations, and all conversations (conv_id, size)."""
    family = F.pmod(F.col("conv_id"), F.lit(FAMILY).cast("long"))
    heads = turns.where((F.col("at") < MOST_BORROWED) & (family == 0))
    has = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("has"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.col("conv_id") - family).withColumn(
        "h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_BORROWED)
    convs = stage_table(convs.join(has, "base", "left").withColumn("k", F.least("h", F.coalesce("has", F.lit(0)))).selectExpr(
        "conv_id", "base", "h", "k", "n", "k + greatest(n - h, 0L) as size"), "trie-conversations")
    # at most five conversations of a base borrow at most nine of its turns
    lent = heads.withColumnRenamed("conv_id", "base").join(convs.where("k > 0").select("base", "conv_id", "k", "size"), "base").where(
        "at < k").select("conv_id", "at", "digest", "bytes", "size")
    limit = max(LEAST_TOP, (convs.agg(F.sum("n")).first()[0] or 0) // TOP)
    of = convs.select("conv_id", "h", "k", "size", "n")
    long = turns.join(F.broadcast(of.where(F.col("n") > limit)), "conv_id", "left")  # their n add up to all turns: fewer than TOP rows
    short = long.where("h is null").select(*turns.columns).join(of.where(F.col("n") <= limit), "conv_id")
    own = long.where("h is not null").unionByName(short).where("at >= h").selectExpr(
        "conv_id", "at - h + k as at", "digest", "bytes", "size")
    return lent.unionByName(own), convs.select("conv_id", "size")


# --- nodes --------------------------------------------------------------------

def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, size, bytes, depth, x1, x2, p1, p2): every turn with the key of its prefix and of the one before. Stored."""
    e = [F.xxhash64(F.lit(seed), F.col("at"), F.col("digest")).alias(f"e{seed}") for seed in (1, 2)]
    rows = turns.select("conv_id", "at", "size", "bytes", F.expr(f"at div {PIECE}").alias("piece"), *e)
    over = "over (partition by conv_id, piece order by at)"
    rows = stage_table(rows.selectExpr("*", f"bit_xor(e1) {over} as x1", f"bit_xor(e2) {over} as x2"), "trie-prefixes")
    later = rows.where("piece > 0")
    if not later.isEmpty():  # the pieces of a long conversation start from what lies before them
        sums = rows.where(f"size > {PIECE}").groupBy("conv_id", "piece").agg(F.bit_xor("e1").alias("s1"), F.bit_xor("e2").alias("s2"))
        before = "over (partition by conv_id order by piece rows between unbounded preceding and 1 preceding)"
        start = sums.selectExpr("conv_id", "piece", f"bit_xor(s1) {before} as b1", f"bit_xor(s2) {before} as b2").where("piece > 0")
        later = later.join(start, ["conv_id", "piece"]).selectExpr(
            "conv_id", "at", "size", "bytes", "piece", "e1", "e2", "x1 ^ b1 as x1", "x2 ^ b2 as x2")
        rows = stage_table(rows.where("piece = 0").unionByName(later), "trie-prefixes")
    return rows.selectExpr("conv_id", "size", "bytes", "at + 1 as depth", "x1", "x2", "x1 ^ e1 as p1", "x2 ^ e2 as p2")


def forward(nodes: DataFrame) -> DataFrame:
    """Time-forward processing of each partition of (depth, x1, x2, p1, p2, saved, n_children, n_leaves).

    The last three are a node's own part and what it got from elsewhere; its shared children in the same
    partition add to them. Gives depth, x1, x2, p1, p2, n_children, n_leaves, saved_tokens.
    """
    names = ["depth", "x1", "x2", "p1", "p2", "n_children", "n_leaves", "saved_tokens"]

    def run(batches):
        queue = SpillingQueue()
        for b in batches:
            out = [[], [], []]
            for depth, x1, x2, p1, p2, saved, children, leaves in zip(*(c.to_pylist() for c in b.columns)):
                for item in queue.take((-depth, x1, x2)):
                    children += 1
                    leaves += item[-2]
                    saved += item[-1]
                leaves = leaves or 1
                if depth:
                    queue.push((1 - depth, p1, p2, leaves, saved))
                for c, v in zip(out, (children, leaves, saved)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *[pa.array(c, pa.int64()) for c in out]], names)

    ordered = nodes.sortWithinPartitions(F.col("depth").desc(), "x1", "x2").select(
        "depth", "x1", "x2", "p1", "p2", "saved", "n_children", "n_leaves")
    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def totals(nodes: DataFrame, paths: DataFrame, limit: int) -> DataFrame:
    """(depth, x1, x2, n_children, n_leaves, saved_tokens) of the shared nodes: those with several members."""
    shared = nodes.where("n_convs > 1").selectExpr(*KEY, "p1", "p2", "conv_id", "n_convs", "(n_convs - 1) * bytes as saved")
    # the first node of a tail that a conversation has for itself sends its parent one child with one leaf
    tails = nodes.where("n_convs = 1").groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2")).alias("t")).selectExpr(
        "t.depth - 1 as depth", "t.p1 as x1", "t.p2 as x2").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    shared = stage_table(shared.join(tails, KEY, "left").fillna(0, ["n_children"]), "trie-shared")
    heavy = F.broadcast(shared.where(F.col("n_convs") > limit).select(*KEY))
    above = F.broadcast(heavy.selectExpr("depth + 1 as depth", "x1 as p1", "x2 as p2"))
    # a conversation leaves the top at one node, the root of its shard (no top: all is one shard)
    shards = paths.join(above, ["depth", "p1", "p2"]).join(heavy, KEY, "left_anti").select("conv_id", F.xxhash64(*KEY).alias("shard"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = shared.where(F.col("n_convs") <= limit).join(shards, "conv_id", "left").withColumn("n_leaves", F.col("n_children"))
    below = stage_table(forward(light.repartition(parts, F.coalesce("shard", F.lit(0)))), "trie-below")
    sent = below.join(above, ["depth", "p1", "p2"]).groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    top = shared.where(F.col("n_convs") > limit).join(sent, KEY, "left").fillna(0, ["c", "l", "s"]).selectExpr(
        *KEY, "p1", "p2", "saved + s as saved", "n_children + c as n_children", "n_children + l as n_leaves")
    return below.unionByName(stage_table(forward(top.repartition(1)), "trie-top")).drop("p1", "p2")


def ends(last: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of (depth, x1, x2, conv_id): the hash of each node's conv_ids in order, comma-joined."""
    ranges = last.groupBy(*KEY, F.expr(f"conv_id - pmod(conv_id, {ENDS}L)").alias("range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        key = digest = None
        for b in batches:
            done = []
            for *own, _, ids in zip(*(c.to_pylist() for c in b.columns)):
                if own == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256(ids.encode())
            yield rows(done)
        if key is not None:
            yield rows([(*key, digest.hexdigest())])

    def rows(done):
        cols = list(zip(*done)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()])], [*KEY, "ends_sha256"])

    parts = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, *KEY).sortWithinPartitions(*KEY, "range").mapInArrow(
        run, "depth long, x1 long, x2 long, ends_sha256 string")


def with_parents(nodes: DataFrame, limit: int) -> DataFrame:
    """Adds parent_conv_id; parents with many members (a bounded number) are broadcast, all others have few children."""
    parents = nodes.selectExpr("depth + 1 as depth", "x1 as p1", "x2 as p2", "conv_id as parent_conv_id", "n_convs as m")
    on = ["depth", "p1", "p2"]
    known = nodes.join(F.broadcast(parents.where(F.col("m") > limit)), on, "left")
    rest = known.where("m is null").select(*nodes.columns).join(parents.where(F.col("m") <= limit), on, "left")
    return known.where("m is not null").unionByName(rest).drop("m")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(numbered(conversations))
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", "size", *[zero.alias(c) for c in ("bytes", *KEY, "p1", "p2")])
    paths = root.unionByName(prefixes(turns))
    nodes = stage_table(paths.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("conv_id", "bytes", "p1", "p2", "size")]), "trie-nodes")
    # every member of a node counts, so fewer than TOP nodes have more members than this
    limit = max(LEAST_TOP, (nodes.agg(F.sum("n_convs")).first()[0] or 0) // TOP)
    sums = totals(nodes, paths, limit)
    ended = ends(paths.where("depth = size").select(*KEY, "conv_id"))
    alone = F.col("n_convs") == 1
    return with_parents(nodes, limit).join(sums, KEY, "left").join(ended, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.when(alone, (F.col("depth") < F.col("size")).cast("long")).otherwise(F.col("n_children")).alias("n_children"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"),
        F.when(alone, zero).otherwise(F.col("saved_tokens")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
