"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance d <= 2r have a value in common that lies
within r bits of both, so every fingerprint emits all values within r bits
(its ball: 1 + 64 + 2016 values for r = 2) and equal values are links.

* Equal fingerprints are one node, so copies never multiply the variants.
* Variants are dealt out by their leading ``bits`` bits. A fingerprint is sent
  once to every prefix within r bits of its own, and the receiving task makes
  exactly its variants with that prefix: the shuffle moves tens of rows per
  fingerprint and not 2,081, and each variant is made in one place only.
* A prefix with many fingerprints is dealt to several tasks, each of which
  keeps the variants of its share of a second hash: memory per task is bounded.
* In a task equal variants are found by sorting; colliding pairs are
  deduplicated, verified by their distance, and reduced to a spanning forest,
  so a group of near copies gives links in proportion to its size.
* Components of the links are found over all tasks (see ``components``).

Defined cases: a null text and a text without words have fingerprint zero and
link like any other; rows with a null doc_id take part, but the component id
is the least doc_id that is not null (null if there is none); repeated rows
each get their result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.llm.components import roots
from wattspark.llm.shared import stage_table

SEED = 42
#: Variants that one task sorts at once.
TASK_VARIANTS = 6_000_000
#: Fingerprints per prefix that the number of leading bits aims at.
PER_PREFIX = 2_000
_CHUNK = 1 << 16


def fingerprint(raw: bytes | None, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of a text (UTF-8): a bit is set if it is set in over half the shingle hashes."""
    words = (raw or b"").lower().split()  # bytes: A-Z only, and white space 09-0D and 20 only
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(shingle, len(words))
    begins = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
    ends = (ends[k - 1:] - 1).tolist()
    h = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for i in range(0, len(begins), _CHUNK):
        part = [h(text[a:b], SEED) for a, b in zip(begins[i:i + _CHUNK], ends[i:i + _CHUNK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, tkey, fp): tkey is a hash of the text, fp the fingerprint as a signed long."""
    src = documents.select("doc_id", F.xxhash64("text").alias("tkey"), F.col("text").cast("binary").alias("raw"))

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "tkey", "fp"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, tkey long, fp long")


def _masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node reachable from each of n nodes by the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def links_within(fps: np.ndarray, prefix: int, bits: int, radius: int, share: int = 0, shares: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, fingerprint) among those whose balls meet in a value with this prefix and share."""
    low_bits = np.uint64(64 - bits)
    fps = np.unique(fps)
    away = np.bitwise_count((fps >> low_bits) ^ np.uint64(prefix))
    keep_low = np.uint64((1 << (64 - bits)) - 1)
    values, origin = [], []
    for used in range(radius + 1):
        own = np.flatnonzero(away == used)
        masks = _masks(64 - bits, radius - used)
        step = max(1, (1 << 20) // len(masks))
        for i in range(0, len(own), step):
            idx = own[i:i + step]
            low = fps[idx] & keep_low
            v = (low[:, None] ^ masks[None, :]).ravel()
            o = np.repeat(idx.astype(np.int32), len(masks))
            if shares > 1:
                mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shares) == share
                v, o = v[mine], o[mine]
            values.append(v)
            origin.append(o)
    none = np.empty(0, np.uint64)
    if not values:
        return none, none
    v, o = np.concatenate(values), np.concatenate(origin)
    order = np.argsort(v)
    v, o = v[order], o[order]
    meet = np.flatnonzero(v[1:] == v[:-1])
    pairs = np.unique(np.minimum(o[meet], o[meet + 1]).astype(np.int64) << 32 | np.maximum(o[meet], o[meet + 1]))
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    near = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * radius
    root = _forest(len(fps), a[near], b[near])
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def near_links(nodes: DataFrame, distance: int = 4, bits: int | None = None, task_variants: int = TASK_VARIANTS) -> DataFrame:
    """nodes (fp, distinct) -> (a, b): links that connect all fingerprints at ``distance`` or fewer bits."""
    if distance % 2:
        raise ValueError("balls of half the distance meet at even distances only")
    radius = distance // 2
    if bits is None:
        bits = min(20, max(4, (nodes.count() // PER_PREFIX).bit_length()))
    balls = [len(_masks(64 - bits, radius - r)) for r in range(radius + 1)]
    here = F.shiftrightunsigned("fp", 64 - bits).cast("int")
    reach = F.array(*[F.lit(int(m)) for m in _masks(bits, radius)])
    sent = nodes.select("fp", F.explode(reach).alias("flip")).select("fp", here.bitwiseXOR(F.col("flip")).alias("prefix"),
                                                                     F.bit_count("flip").alias("used"))
    load = sum(F.when(F.col("used") == r, F.lit(n)).otherwise(F.lit(0)) for r, n in enumerate(balls))
    shares = sent.groupBy("prefix").agg(F.ceil(F.sum(load) / task_variants).cast("int").alias("shares"))
    dealt = sent.join(shares, "prefix").select(
        "fp", "prefix", "shares", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def run(group: pa.Table) -> pa.Table:
        prefix, share, shares_ = (group[c][0].as_py() for c in ("prefix", "share", "shares"))
        a, b = links_within(group["fp"].to_numpy().view(np.uint64), prefix, bits, radius, share, shares_)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("prefix", "share").applyInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per document row: doc_id, tkey, fingerprint (16 hex digits), component_id, and keep (true for the group's representative)."""
    fps = stage_table(fingerprints(documents, shingle), "simhash-fps")
    rep = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("tkey").alias("tkey"))
    nodes = stage_table(fps.groupBy("fp").agg(F.min(rep).alias("rep")), "simhash-nodes")
    found = roots(near_links(nodes.select("fp"), distance))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("rep").alias("head"))
    named = rooted.join(heads, "root").select(F.col("fp").alias("node"), "head")
    return fps.join(named, fps.fp == named.node).select(
        "doc_id", "tkey", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head.id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("head.id")) & (F.col("tkey") == F.col("head.tkey"))).alias("keep"))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """``documents`` (all its columns) with one row of each near-duplicate group.

    Both sides have one key without nulls, so the join and the removal of
    repeated rows need one exchange of the texts.
    """
    def key(doc_id, tkey):
        return F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("null")), F.lit(":"), tkey.cast("string"))

    kept = near_duplicates(documents, **options).where("keep").select(key(F.col("doc_id"), F.col("tkey")).alias("k")).distinct()
    rows = documents.select(F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("doc"),
                            key(documents["doc_id"], F.xxhash64(documents["text"])).alias("k"))
    one = rows.join(kept, "k", "left_semi").dropDuplicates(["k"])
    return one.select(*[F.col(f"doc.`{c}`").alias(c) for c in documents.columns])
