"""Substring dedup of word windows by difference-cover anchors.

A word goes if a window of ``width`` consecutive words around it starts anywhere
else too. Windows are not all hashed: with a difference cover D modulo a period
p, any two window starts i and j have an offset d < p for which both i + d and
j + d are cover positions (a position modulo p in D), so equal windows share an
equal run of ``width - p + 1`` words that starts at cover positions of both.

1. Every block hashes such runs at cover positions only (5 of 21 positions for
   35 words) and asks which hashes occur twice (``blocks.ask``).
2. Around those anchors matches extend: each window that contains one is
   hashed (128 bits) and the blocks ask which windows occur twice.
3. The windows found cover the words that go.

Texts are stored once as compressed blocks and never shuffled; hashes that fill
a block (copies, repeated lines) are sent once a block.

Defined cases: null or empty texts have no words; a text of fewer words than
the window loses nothing; repeated rows are separate texts, so their windows
occur twice; a null doc_id is a value like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wattspark.llm import blocks as B
from wattspark.llm.shared import stage_table

#: Perfect difference sets: period -> cover.
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
REMEMBERED = 300_000


def period(width: int) -> int:
    """The longest period that leaves anchors of over a third of the window."""
    return max(p for p in COVERS if p == 1 or 3 * (width - p + 1) > width)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every run of ``width`` values, at its start."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(base, len(values) - 1), dtype=np.uint64)))
    back = _powers(pow(base, -1, 1 << 64), n - 1)
    return B.mixed((sums[width:] - sums[:-width]) * back)


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95)


class _Words:
    """The words of a block: their hashes end to end, and where each text's words begin and end."""

    def __init__(self, row: dict, known: _Hashes):
        self.texts = [t.split() for t in B.texts_of(row["sizes"], row["raw"])]
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        total = int(sizes.sum())
        self.values = np.fromiter((known[w] for t in self.texts for w in t), np.uint64, total)
        self.place = np.arange(total) - np.repeat(self.begins, sizes)
        self.left = np.repeat(self.ends, sizes) - np.arange(total)

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and keys of the anchors of all texts that have a window."""
        p = period(width)
        run = width - p + 1
        h = window_hashes(self.values, run, BASES[0])
        cover = np.zeros(p, bool)
        cover[list(COVERS[p])] = True
        at = np.flatnonzero(cover[self.place[:len(h)] % p] & (self.left[:len(h)] >= run) & ((self.place + self.left)[:len(h)] >= width))
        return at, h[at][:, None]

    def windows(self, width: int, answers) -> tuple[np.ndarray, np.ndarray]:
        """Starts and keys of the windows that contain an anchor found twice."""
        at, keys = self.anchors(width)
        again = B.answered(answers)
        hot = np.zeros(len(self.values) + width + 1, np.int64)
        if len(again):
            _, number, _ = B.sorted_keys(keys)
            hot[at[again[number]] + 1] = 1
        sums = np.cumsum(hot)
        starts = np.flatnonzero(self.left >= width)
        starts = starts[sums[starts + period(width)] > sums[starts]]
        both = [window_hashes(self.values, width, b)[starts] for b in BASES] if len(starts) else [np.empty(0, np.uint64)] * 2
        return starts, np.column_stack(both)


def drop_repeats(documents: DataFrame, width: int = 35, texts: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256, and if asked the kept text (words joined by a space)."""
    packed = B.pack(documents)
    bits, tasks = B.dealing(packed)
    caches: dict[int, _Hashes] = {}

    def words(row):  # one cache a worker
        return _Words(row, caches.setdefault(0, _Hashes()))

    first = stage_table(B.ask(packed, lambda row: words(row).anchors(width)[1], bits, 1, tasks=tasks), "words-anchors")
    known = packed.join(first, "block", "left")
    second = stage_table(B.ask(known, lambda row: words(row).windows(width, row["answers"])[1], bits, 2, tasks=tasks), "words-windows")
    both = known.join(second.withColumnRenamed("answers", "windows"), "block", "left")
    doc_type = packed.schema["ids"].dataType.elementType

    def cut(batches):
        for b in batches:
            for row in b.to_pylist():
                w = words(row)
                starts, keys = w.windows(width, row["answers"])
                again = B.answered(row["windows"])
                gone = np.zeros(len(w.values) + 1, np.int64)
                if len(again):
                    hit = starts[again[B.sorted_keys(keys)[1]]]
                    np.add.at(gone, hit, 1)
                    np.add.at(gone, hit + width, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = [b" ".join([x for x, g in zip(t, gone[i:j]) if not g]) if gone[i:j].any() else b" ".join(t)
                        for t, i, j in zip(w.texts, w.begins, w.ends)]
                removed = [int(gone[i:j].sum()) for i, j in zip(w.begins, w.ends)]
                out = [pa.array(row["ids"], b.schema.field("ids").type.value_type), pa.array([len(t) for t in w.texts], pa.int64()),
                       pa.array(removed, pa.int64()), pa.array([B.sha256(k) for k in kept], pa.string()),
                       pa.array([k.decode("utf-8", "replace") if texts else None for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    schema = T.StructType([T.StructField("doc_id", doc_type), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())])
    out = both.select("block", "ids", "sizes", "raw", "answers", "windows").mapInArrow(cut, schema)
    return out if texts else out.drop("kept")
