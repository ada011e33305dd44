"""Removal of repeated byte strings with suffix arrays built by two-stage sorting.

A byte goes if a string of ``length`` bytes around it also starts anywhere else.

1. Every possible start of such a string belongs to an anchor: the leftmost
   least hash of ``ANCHOR`` bytes inside the string. Equal strings have equal
   anchors at equal offsets, and neighbouring starts mostly share one, so a
   text falls into segments (the starts of one anchor and their strings) whose
   borders depend on its content only. Blocks ask which anchors occur twice
   (``blocks.ask``); the starts of all others are unique.
2. The segments of the rest are dealt out by anchor. A task joins its distinct
   segments to one text and builds the suffix array of their starts by
   two-stage sorting: only suffixes smaller than their successors are sorted
   directly (to the depth of ``length``), all others are induced from them by
   one scan over the buckets of first bytes. Neighbours in the array with a
   common prefix of ``length`` or more are the repeated strings; so are all
   starts of a segment that came more than once. The answer is a bit a start.
3. Anchors with more than ``MANY`` segments (a passage of many texts in different
   surroundings: the strings over its edges are all different, yet their anchor
   lies in the passage) would fill one task. Their strings are dealt out one by
   one instead: a 128-bit hash of each string is the key of ``blocks.ask``.
4. Blocks turn the starts into covered bytes.

A segment is a few hundred bytes, and equal ones are sent once a block and
sorted once, so copies add nothing to a task; other segments of one anchor are
at most ``MANY``. Texts are stored once as compressed blocks and never shuffled.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing;
repeated rows are separate texts, so what is long enough repeats; a null doc_id
is a value like any other; strings never cross texts.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspark.llm import blocks as B
from wattspark.llm.shared import stage_table
from wattspark.llm.word_windows import BASES, window_hashes

ANCHOR = 32
BLOCK_BYTES = 2 << 20
#: Most segments of one anchor that one task sorts.
MANY = 5_000
CROWDED = "exists(answers, a -> a.many is not null)"
#: Symbols are bytes plus one, the end of a segment is zero; so many are compared at once.
_BITS, _AT_ONCE = 9, 7
_PLACE_BITS, _PIECE = np.uint64(20), 1 << 18


# --- two-stage suffix sorting -------------------------------------------------

def packed_symbols(x: np.ndarray) -> np.ndarray:
    """The next seven symbols from every position, as one number that compares like them."""
    wide = np.concatenate((x.astype(np.uint64), np.zeros(_AT_ONCE, np.uint64)))
    out = np.zeros(len(x), np.uint64)
    for j in range(_AT_ONCE):
        out = (out << np.uint64(_BITS)) | wide[j:j + len(x)]
    return out


def smaller_than_next(x: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it. x ends with the least symbol."""
    rising = np.concatenate((x[:-1] < x[1:], [True]))
    ends = np.flatnonzero(np.concatenate((x[:-1] != x[1:], [True])))  # a run of one symbol goes as its end goes
    return np.repeat(rising[ends], np.diff(np.concatenate(([-1], ends))))


def agree(pairs: np.ndarray, order: np.ndarray, keys: np.ndarray, at: int, depth: int) -> np.ndarray:
    """Those of ``pairs`` (i stands for order[i] and order[i + 1]) whose symbols from ``at`` to ``depth`` are equal."""
    for k in range(at, depth, _AT_ONCE):
        if not len(pairs):
            break
        k = max(0, min(k, depth - _AT_ONCE))  # the last look goes back to end at the depth
        last = len(keys) - 1
        pairs = pairs[keys[np.minimum(order[pairs] + k, last)] == keys[np.minimum(order[pairs + 1] + k, last)]]
    return pairs


def sort_directly(pos: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` symbols.

    Only ties are looked at again; now and then groups of ties that agree to
    the full depth are found by comparing neighbours, and left as they are.
    """
    order = pos[np.argsort(keys[pos], kind="stable")]
    k = keys[order]
    same = k[1:] == k[:-1]
    for round_, at in enumerate(range(_AT_ONCE, depth, _AT_ONCE), 1):
        if not same.any():
            break
        if round_ & (round_ - 1) == 0:  # after 1, 2, 4, 8 ... rounds
            tied = np.flatnonzero(same)
            group = np.cumsum(np.concatenate(([True], ~same)))
            differs = same.copy()
            differs[agree(tied, order, keys, at, depth)] = False
            open_ = np.zeros(group[-1] + 1, bool)
            open_[group[np.flatnonzero(differs)]] = True
            same &= open_[group[:-1]]
        tied = np.concatenate((same, [False])) | np.concatenate(([False], same))
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(np.concatenate(([True], ~same)))[where]
        own = order[where]
        ahead = keys[np.minimum(own + at, len(keys) - 1)]
        _, rank = np.unique(ahead, return_inverse=True)
        by = np.argsort((group << 32) | rank, kind="stable")
        order[where] = own[by]
        ahead, group = ahead[by], group[by]
        again = np.zeros(len(order), bool)
        again[where[1:]] = (ahead[1:] == ahead[:-1]) & (group[1:] == group[:-1]) & (where[1:] == where[:-1] + 1)
        same = again[1:]
    return order


def induce(x: np.ndarray, small: np.ndarray, wanted: np.ndarray, sorted_small: np.ndarray) -> np.ndarray:
    """All wanted suffixes in order, from the sorted ones that are smaller than their successors.

    Buckets of first symbols are scanned in order. In a bucket the larger suffixes
    come first; each suffix met puts its predecessor, if that is a larger one, at
    the next free place of the predecessor's bucket.
    """
    firsts = x[sorted_small]
    symbols = np.arange(int(x.max()) + 2)
    cut = np.searchsorted(firsts, symbols)
    larger: list[list[np.ndarray]] = [[] for _ in symbols]
    out = []
    for c in symbols[:-1]:
        front = larger[c]
        due = np.concatenate(front) if front else np.empty(0, np.int64)
        done = []
        while len(due):  # predecessors in the same bucket follow their successors
            done.append(due)
            before = due - 1
            before = before[before >= 0]
            due = before[(x[before] == c) & wanted[before]]
        bucket = np.concatenate([*done, sorted_small[cut[c]:cut[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[wanted[before] & ~small[before] & (x[before] > c)]
        if len(before):
            to = x[before]
            by = np.argsort(to, kind="stable")
            before, to = before[by], to[by]
            places = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            for part, s in zip(np.split(before, places[1:]), to[places]):
                larger[s].append(part)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def suffix_order(x: np.ndarray, starts: np.ndarray, depth: int, keys: np.ndarray) -> np.ndarray:
    """``starts`` in the order of the first ``depth`` symbols of their suffixes."""
    small = smaller_than_next(x)
    wanted = np.zeros(len(x), bool)
    wanted[starts] = True
    # a larger suffix is induced from the next smaller one: the chains that leave the starts are wanted too
    next_small = np.minimum.accumulate(np.where(small, np.arange(len(x)), len(x))[::-1])[::-1]
    edge = starts[~small[starts]]
    ahead = edge[~wanted[np.minimum(edge + 1, len(x) - 1)]]
    for a, b in zip(ahead.tolist(), next_small[ahead].tolist()):
        wanted[a:b + 1] = True
    order = induce(x, small, wanted, sort_directly(np.flatnonzero(small & wanted), keys, depth))
    is_start = np.zeros(len(x), bool)
    is_start[starts] = True
    return order[is_start[order]]


def shared_prefix(order: np.ndarray, keys: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix in order has its first ``depth`` symbols in common with the one before it."""
    same = np.zeros(len(order), bool)
    pairs = np.arange(len(order) - 1)
    if depth >= _AT_ONCE:
        pairs = agree(pairs, order, keys, 0, depth)
    else:
        for at in range(depth):
            pairs = pairs[x[order[pairs] + at] == x[order[pairs + 1] + at]]
    same[pairs + 1] = True
    return same


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For distinct segments: whether the string at each start (of len - length + 1) also starts at another place."""
    sizes = np.array([len(s) + 1 for s in segments])
    ends = np.cumsum(sizes)
    x = np.concatenate((np.frombuffer(b"\0".join(segments), np.uint8).astype(np.uint16) + 1, np.zeros(1, np.uint16)))
    x[ends - 1] = 0
    keys = packed_symbols(x)
    inside = np.ones(len(x), bool)
    inside[ends - 1] = False
    for k in range(1, length):
        inside[np.maximum(ends - 1 - k, 0)] = False
    starts = np.flatnonzero(inside)
    order = suffix_order(x, starts, length, keys)
    same = shared_prefix(order, keys, x, length)
    hit = np.zeros(len(x), bool)
    hit[order[same]] = True
    hit[order[np.flatnonzero(same) - 1]] = True
    return [hit[e - n:e - length] for e, n in zip(ends.tolist(), sizes.tolist())]


# --- blocks -------------------------------------------------------------------

_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values (running minima from both ends of pieces of that width)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, values.dtype)
    pad = -len(values) % width
    grid = np.concatenate((values, np.full(pad, np.iinfo(values.dtype).max, values.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


class _Segments:
    """Finds the segments of a block: first and last start, and the anchor's hash. Worked off in pieces of ``_PIECE`` starts."""

    def __init__(self, sizes: np.ndarray, raw: bytes, length: int):
        self.raw, self.ends, self.length = raw, np.cumsum(sizes), length
        found = [np.empty((4, 0), np.int64)]
        for at in range(0, max(0, len(self.raw) - length + 1), _PIECE):
            piece = self._segments(at, min(at + _PIECE, len(self.raw) - length + 1))
            before = found[-1]
            if before.shape[1] and piece.shape[1] and before[2, -1] == piece[2, 0] and before[1, -1] + 1 == piece[0, 0]:
                before[1, -1] = piece[1, 0]  # a segment goes on over the end of a piece
                piece = piece[:, 1:]
            found += [piece] if piece.shape[1] else []
        self.found = np.concatenate(found, axis=1)[[0, 1, 3]]

    def _segments(self, lo: int, hi: int) -> np.ndarray:
        """First start, last start, anchor and its hash of the segments of the starts lo to hi."""
        gram = min(ANCHOR, self.length)
        h = window_hashes(_BYTE[np.frombuffer(self.raw, np.uint8, hi - lo + self.length - 1, lo)], gram, BASES[0])
        low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
        # the place in the low bits makes the leftmost of equal hashes the least
        least = sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), self.length - gram + 1)
        starts = np.arange(lo, hi)
        text = np.searchsorted(self.ends, starts, side="right")
        inside = starts + self.length <= self.ends[text]
        starts, text, anchor = starts[inside], text[inside], (least[inside] & low).astype(np.int64)
        if not len(starts):
            return np.empty((4, 0), np.int64)
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
        last = np.append(np.flatnonzero(new)[1:], len(starts)) - 1
        # anchors are the least hashes around: mixed again, their leading bits deal them out evenly
        return np.stack((starts[new], starts[last], anchor[new] + lo, B.mixed(~h[anchor[new]]).view(np.int64)))


def stored_segments(length: int):
    """For ``blocks.pack``: the segments of a block, to be stored with it."""
    return lambda sizes, raw: zstandard.compress(_Segments(sizes, raw, length).found.tobytes())


class _Block:
    """The bytes of a block and its stored segments."""

    def __init__(self, row: dict, length: int):
        sizes = np.frombuffer(row["sizes"], np.int64)
        self._raw = row["raw"]
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.length = length
        self.first, self.last, keys = np.frombuffer(zstandard.decompress(row["more"]), np.int64).reshape(3, -1)
        self.keys = keys.view(np.uint64)

    @cached_property
    def raw(self) -> bytes:
        return zstandard.decompress(self._raw)

    def different(self) -> np.ndarray:
        """The anchors' hashes, one of each different segment (twice where equal ones of the block are all there is)."""
        keys, number, counts = B.sorted_keys(self.keys[:, None])
        seen: dict[tuple[int, bytes], int] = {}
        left = np.ones(len(number), bool)
        for i in np.flatnonzero((counts > 2)[number]).tolist() if len(number) else ():
            own = (int(number[i]), self.raw[self.first[i]:self.last[i] + self.length])
            seen[own] = seen.get(own, 0) + 1
            left[i] = seen[own] <= 2
        return self.keys[left][:, None]

    def crowded(self, answers) -> np.ndarray:
        """Numbers of the segments whose anchor has too many."""
        above = B.answered(answers, "many")
        return np.flatnonzero(above[B.sorted_keys(self.keys[:, None])[1]]) if above.any() else np.empty(0, np.int64)

    def strings(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts of these segments, and two hashes of the string at each."""
        starts, keys = [np.empty(0, np.int64)], [np.empty((0, 2), np.uint64)]
        data = np.frombuffer(self.raw, np.uint8)
        for i in segments.tolist():
            values = _BYTE[data[self.first[i]:self.last[i] + self.length]]
            starts.append(np.arange(self.first[i], self.last[i] + 1))
            keys.append(np.column_stack([window_hashes(values, self.length, b) for b in BASES]))
        return np.concatenate(starts), np.concatenate(keys)

    def doubtful(self, answers) -> tuple[list[tuple[int, bytes]], dict[tuple[int, bytes], list[int]]]:
        """Distinct segments whose anchor occurs twice but not too often, in order, and the numbers of the segments equal to each."""
        again = B.answered(answers)
        if not len(again):
            return [], {}
        again &= ~B.answered(answers, "many")
        _, number, _ = B.sorted_keys(self.keys[:, None])
        found: dict[tuple[int, bytes], list[int]] = {}
        for i in np.flatnonzero(again[number]).tolist():
            found.setdefault((int(self.keys[i]), self.raw[self.first[i]:self.last[i] + self.length]), []).append(i)
        return sorted(found), found


def ask_anchors(blocks: DataFrame, length: int, bits: int, tasks: int = 1) -> DataFrame:
    """(block, answers): which anchors of each block occur twice, and which have more than ``MANY`` different segments."""
    return B.ask(blocks, lambda row: _Block(row, length).different(), bits, 1, MANY, tasks)


def send_segments(blocks: DataFrame, length: int, bits: int) -> DataFrame:
    """(range, block, sizes, twice, raw): the doubtful segments of each block, dealt out by anchor."""

    def emit(batches):
        for b in batches:
            for row in b.to_pylist():
                order, found = _Block(row, length).doubtful(row["answers"])
                dealt = np.array([k >> (64 - bits) for k, _ in order], np.int64)
                cut = np.flatnonzero(np.concatenate(([True], dealt[1:] != dealt[:-1]))).tolist() + [len(order)] if order else []
                for i, j in zip(cut[:-1], cut[1:]):
                    part = order[i:j]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(dealt[i])]), pa.array([row["block"]]),
                         pa.array([np.array([len(s) for _, s in part], np.int64).tobytes()], pa.binary()),
                         pa.array([np.packbits([len(found[p]) > 1 for p in part]).tobytes()], pa.binary()),
                         pa.array([zstandard.compress(b"".join(s for _, s in part))], pa.binary())],
                        ["range", "block", "sizes", "twice", "raw"])

    return blocks.mapInArrow(emit, "range long, block long, sizes binary, twice binary, raw binary")


def ask_segments(blocks: DataFrame, length: int, bits: int, tasks: int = 1) -> DataFrame:
    """(block, answers): for the doubtful segments of each block, packed bits of the starts that repeat."""

    def judge(group: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        twice: list[bool] = []
        own = []
        for sizes, flags, raw in zip(*(group[c].to_pylist() for c in ("sizes", "twice", "raw"))):
            texts = B.texts_of(sizes, raw)
            marks = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(texts))
            mine = []
            for s, m in zip(texts, marks):
                i = number.setdefault(s, len(number))
                if i == len(twice):
                    twice.append(bool(m))
                else:
                    twice[i] = True
                mine.append(i)
            own.append(mine)
        hits = repeated_starts(list(number), length)
        hits = [np.ones(len(h), bool) if t else h for h, t in zip(hits, twice)]
        out = [np.concatenate([hits[i] for i in mine]) for mine in own]
        return pa.table({"block": group["block"], "range": group["range"], "n": pa.array([len(o) for o in out], pa.int32()),
                         "bits": pa.array([np.packbits(o).tobytes() for o in out], pa.binary())})

    found = B.by_range(send_segments(blocks, length, bits), tasks).groupBy("range").applyInArrow(judge, "block long, range long, n int, bits binary")
    return found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "n", "bits"))).alias("answers"))


def ask_strings(blocks: DataFrame, length: int, bits: int) -> DataFrame:
    """(block, answers): for the different strings of each block's crowded segments, packed bits of those that occur twice."""

    def keys_of(row):
        block = _Block(row, length)
        return block.strings(block.crowded(row["answers"]))[1]
    return B.ask(blocks.where(CROWDED), keys_of, bits, 2)


def drop_repeats(documents: DataFrame, length: int = 400, texts: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and if asked the kept bytes."""
    packed = B.pack(documents, BLOCK_BYTES, more=stored_segments(length))
    bits, tasks = B.dealing(packed)
    first = stage_table(ask_anchors(packed, length, bits, tasks), "suffix-anchors")
    known = packed.join(first, "block", "left")
    second = stage_table(ask_segments(known, length, bits, tasks), "suffix-segments")
    both = known.join(second.withColumnRenamed("answers", "hits"), "block", "left")
    if first.where(CROWDED).isEmpty():
        both = both.withColumn("string_hits", F.lit(None))
    else:
        third = stage_table(ask_strings(known, length, min(20, bits + 3)), "suffix-strings")
        both = both.join(third.withColumnRenamed("answers", "string_hits"), "block", "left")

    def cut(batches):
        for b in batches:
            for row in b.to_pylist():
                block = _Block(row, length)
                order, found = block.doubtful(row["answers"])
                hits, at = B.answered(row["hits"]), 0
                data = np.frombuffer(block.raw, np.uint8)
                gone = np.zeros(len(data) + 1, np.int32)
                for segment in order if len(hits) and hits.any() else ():
                    n = len(segment[1]) - length + 1
                    own = np.flatnonzero(hits[at:at + n])
                    at += n
                    for i in found[segment] if len(own) else ():
                        gone[block.first[i] + own] += 1
                        gone[block.first[i] + own + length] -= 1
                starts, keys = block.strings(block.crowded(row["answers"]))
                if len(starts):
                    own = starts[B.answered(row["string_hits"])[B.sorted_keys(keys)[1]]]
                    np.add.at(gone, own, 1)
                    np.add.at(gone, own + length, -1)
                gone = np.cumsum(gone)[:-1] > 0
                before = np.concatenate(([0], np.cumsum(gone)))
                rows = []
                for i, j, n in zip(block.begins.tolist(), block.ends.tolist(), (before[block.ends] - before[block.begins]).tolist()):
                    g = gone[i:j]
                    kept = data[i:j][~g].tobytes() if n else block.raw[i:j]
                    rows.append((j - i, n, int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if n else 0, B.sha256(kept), kept if texts else None))
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], b.schema.field("ids").type.value_type), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = T.StructType([T.StructField("doc_id", packed.schema["ids"].dataType.elementType)] + [
        T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [
        T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])
    out = both.select("block", "ids", "sizes", "raw", "more", "answers", "hits", "string_hits").mapInArrow(cut, schema)
    return out if texts else out.drop("kept")
