"""Blocks of whole texts, and the question "which of my keys occur twice?" asked over all blocks.

``pack`` cuts a table into blocks of about ``BLOCK_BYTES`` of text (a longer
text is a block of its own), one compressed row a block, stored by hash of the
block number on shared storage, so that later joins on it move no text.

``ask`` lets every block name keys (hashes). A block sorts and deduplicates its
keys first, so a key that fills a block costs one entry, and deals them out by
their leading bits, a slice a row. The task of a slice range counts each key
over all blocks and answers one *bit* a key. Answers come back to the blocks
by block number: the traffic is the keys once, and an eighth of a byte each.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspark.session import checkpoint_dir

BLOCK_BYTES = 4 << 20


def pack(documents: DataFrame, block_bytes: int = BLOCK_BYTES, *, more: Callable[[np.ndarray, bytes], bytes] | None = None) -> DataFrame:
    """(block, ids, sizes, raw, more): block number, doc_ids, text sizes (int64), the texts end to end (compressed),
    and what ``more`` makes of sizes and texts, worked out once and stored with them."""
    spark = documents.sparkSession
    src = documents.select("doc_id", F.col("text").cast("binary").alias("raw"))

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def row():
            sizes, raw = np.array([len(t) for t in texts], np.int64), b"".join(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + n]), pa.array([ids], pa.list_(kind)), pa.array([sizes.tobytes()], pa.binary()),
                 pa.array([zstandard.compress(raw)], pa.binary()), pa.array([more and more(sizes, raw)], pa.binary())],
                ["block", "ids", "sizes", "raw", "more"])
        kind = None
        for b in batches:
            kind = b.column(0).type
            for i, raw in zip(b.column(0), b.column(1)):
                raw = raw.as_py() or b""
                if texts and size + len(raw) > block_bytes:
                    yield row()
                    ids, texts, size, n = [], [], 0, n + 1
                ids.append(i.as_py())
                texts.append(raw)
                size += len(raw)
        if texts:
            yield row()

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(src.schema["doc_id"].dataType)),
                           *[T.StructField(c, T.BinaryType()) for c in ("sizes", "raw", "more")]])
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    src.mapInArrow(run, schema).write.option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}").bucketBy(
        buckets, "block").sortBy("block").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved: the plan keeps the files and their buckets
    spark.sql(f"DROP TABLE {name}")  # an external table: only the catalogue entry goes
    return out


def texts_of(sizes: bytes, raw: bytes) -> list[bytes]:
    data, at, out = zstandard.decompress(raw), 0, []
    for n in np.frombuffer(sizes, np.int64).tolist():
        out.append(data[at:at + n])
        at += n
    return out


def dealing(blocks: DataFrame) -> tuple[int, int]:
    """Leading bits that deal keys out to about as many ranges as there are blocks, and a task for every four blocks."""
    n = blocks.count()
    return max(1, min(20, (n - 1).bit_length())), -(-n // 4)


def by_range(sent: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt out by range to so many tasks, or as many as the session has partitions."""
    return sent.repartition(max(tasks, int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "range")


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sorted_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (n x 1 or n x 2) in order, the number of each row's key, and how often each occurs."""
    if not len(keys):
        return keys, np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort(keys.T[::-1]) if keys.shape[1] > 1 else np.argsort(keys[:, 0])
    own = keys[order]
    new = np.concatenate(([True], (own[1:] != own[:-1]).any(axis=1)))
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return own[first], number, np.diff(np.append(first, len(keys)))


def ask(blocks: DataFrame, keys_of: Callable[..., np.ndarray], bits: int, width: int, many: int | None = None,
        tasks: int = 1) -> DataFrame:
    """(block, answers): for the sorted distinct keys of each block, packed bits of those that occur twice or more over all.

    keys_of takes a row of ``blocks`` as a dict and returns keys, n x ``width`` uint64; the first is dealt by its leading bits.
    many: if given, answers also have packed bits of the keys that occur more often than that, null where none does.
    """
    shift = np.uint64(64 - bits)

    def emit(batches):
        for b in batches:
            for row in b.to_pylist():
                keys, _, counts = sorted_keys(keys_of(row))
                if not len(keys):
                    continue
                dealt = (keys[:, 0] >> shift).astype(np.int64)
                ranges, first = np.unique(dealt, return_index=True)
                cut = np.append(first, len(keys))
                slices = [keys[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]
                twice = [np.packbits(counts[i:j] > 1).tobytes() for i, j in zip(cut[:-1], cut[1:])]
                # how often those that occur twice in the block do
                often = [c[c > 1].astype(np.uint32).tobytes() if many else None for c in np.split(counts, cut[1:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ranges, pa.int64()), pa.array([row["block"]] * len(ranges), pa.int64()), pa.array(slices, pa.binary()),
                     pa.array(twice, pa.binary()), pa.array(often, pa.binary())], ["range", "block", "slice", "twice", "often"])

    def judge(group: pa.Table) -> pa.Table:
        slices = [np.frombuffer(s, np.uint64).reshape(-1, width) for s in group["slice"].to_pylist()]
        twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(s)) for t, s in zip(group["twice"].to_pylist(), slices)]
        keys, number, counts = sorted_keys(np.concatenate(slices))
        again = counts > 1
        twice = np.concatenate(twice).astype(bool)
        np.logical_or.at(again, number, twice)
        cut = np.cumsum([len(s) for s in slices])[:-1]
        bits_ = [np.packbits(x).tobytes() for x in np.split(again[number], cut)]
        many_ = [None] * len(slices)
        if many:
            times = np.ones(len(number), np.int64)
            times[twice] = np.frombuffer(b"".join(group["often"].to_pylist()), np.uint32)
            above = (np.bincount(number, times, len(keys)) > many)[number]
            many_ = [np.packbits(x).tobytes() if x.any() else None for x in np.split(above, cut)]
        return pa.table({"block": group["block"], "range": group["range"], "n": pa.array([len(s) for s in slices], pa.int32()),
                         "bits": pa.array(bits_, pa.binary()), "many": pa.array(many_, pa.binary())})

    sent = blocks.mapInArrow(emit, "range long, block long, slice binary, twice binary, often binary")
    found = by_range(sent, tasks).groupBy("range").applyInArrow(judge, "block long, range long, n int, bits binary, many binary")
    own = ["range", "n", "bits"] + ["many"] * bool(many)
    return found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("answers"))


def answered(answers: list[dict] | None, name: str = "bits") -> np.ndarray:
    """The answers of one block, one for each of its sorted distinct keys."""
    parts = [np.unpackbits(np.frombuffer(a[name], np.uint8), count=a["n"]).astype(bool) if a[name] is not None else np.zeros(a["n"], bool)
             for a in answers or []]
    return np.concatenate(parts) if parts else np.empty(0, bool)


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
