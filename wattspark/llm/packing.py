"""Packing of token streams into sequences by order-preserving dynamic programming.

The documents of an input partition, in their order, form lanes: runs of whole
documents with about ``LANE`` tokens. A lane is one stream of tokens that is cut
into windows of at most ``length`` tokens. Windows may be cut at the end of a
document (free), at the end of a sentence (``SENTENCE`` tokens of penalty) and,
in sentences longer than ``STEP`` and in the last window's reach of a lane, also
inside a sentence (``INSIDE``). A window is padded to ``length`` unless its size is
a power of two. The cuts of a lane minimise padding plus penalties:

    cost(j) = penalty(j) + min over i of cost(i) + padding(j - i)

Padding is linear in i within reach, so a monotone queue over ``cost(i) + i``
gives that minimum in constant time a place; windows that are a power of two
are the few places i at such a distance, looked up beforehand.

Token ids are those of a ``tokenizers`` file. The file's normaliser and splitter
never look across white space, so ids of white-space separated chunks are kept
(of about ``REMEMBERED`` chunks) and joined; texts with one of the four control
characters that only Python takes for white space are encoded line by line.

One narrow pass: no shuffle, a lane's ids are all that a task holds. The file
(its size is checked) is broadcast.

Defined cases: a null text is empty; an empty text is the closing id alone;
repeated rows are documents of their own; a null doc_id is a value like any
other; a document longer than a lane is a lane; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import deque
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Ends of sentences, and what may follow them.
STOPS = frozenset(".!?…。！？")
CLOSERS = "\"'”’»)]}"
#: Penalties in tokens of padding.
SENTENCE, INSIDE = 16, 128
LANE, STEP, REMEMBERED = 1 << 21, 64, 1 << 20
MAX_FILE = 64 << 20
_ODD = re.compile("[\x1c-\x1f]")
#: How files of the known kind normalise and split texts.
KIND = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
#: Letters, which the file lower-cases, and punctuation, which is a piece of its own.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


class _Chunks(dict):
    """Numbers of the chunks met so far; a new one is encoded and stored."""

    def __init__(self, tokenizer):
        self._encode, self._model = tokenizer.encode, tokenizer.model
        # the file's own name of every plain letter's bytes
        letters = [c for c in map(chr, range(256)) if _PLAIN.fullmatch(c)]
        self._bytes = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        self.clear()

    def clear(self):
        super().clear()
        self.ids, self.begins, self.stops = array("I"), array("q", [0]), array("b")

    def __missing__(self, chunk: str) -> int:
        plain = _PLAIN.fullmatch(chunk)
        stop = False
        if plain and plain[2]:
            for number in [self[part] for part in plain.groups()]:
                self.ids.extend(self.ids[self.begins[number]:self.begins[number + 1]])
            stop = chunk[-1] in STOPS
        elif plain and chunk.islower():
            self.ids.extend([t.id for t in self._model.tokenize(chunk.translate(self._bytes))])
        elif plain:
            self[chunk] = number = self[chunk.lower()]
            return number
        else:
            self.ids.extend(self._encode(chunk, add_special_tokens=False).ids)
            stop = chunk.rstrip(CLOSERS)[-1:] in STOPS
        self.begins.append(len(self.ids))
        self.stops.append(stop)
        self[chunk] = number = len(self.stops) - 1
        return number


class Encoder:
    """Token ids of whole texts, and the places in them where sentences end."""

    def __init__(self, tokenizer: str, end: int):
        from tokenizers import Tokenizer
        spec = json.loads(tokenizer)
        if [x["type"] for x in spec["normalizer"]["normalizers"] + spec["pre_tokenizer"]["pretokenizers"]] != KIND:
            raise ValueError(f"the tokenizer does not normalise and split by {KIND}")
        self._chunks = _Chunks(Tokenizer.from_str(tokenizer))
        self._end = end

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        known = self._chunks
        if len(known) > REMEMBERED:
            known.clear()
        chunks: list[str] = []
        lines = []
        odd = _ODD.search(text) is not None
        for line in text.split("\n"):
            chunks += [line] if odd else line.split()
            lines.append(len(chunks))
        number = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        begins = np.frombuffer(known.begins, np.int64)
        sizes = begins[number + 1] - begins[number]
        ends = np.cumsum(sizes)
        stop = np.frombuffer(known.stops, np.int8)[number] > 0 if len(chunks) else np.zeros(0, bool)
        last = np.array(lines) - 1
        stop[last[last >= 0]] = True
        n = int(ends[-1]) if len(ends) else 0
        ids = np.empty(n + 1, "<u4")
        ids[:n] = np.frombuffer(known.ids, np.uint32)[np.arange(n) + np.repeat(begins[number] - (ends - sizes), sizes)] if n else 0
        ids[n] = self._end
        return ids, ends[stop]


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def encoder(tokenizer: str, end: int) -> Encoder:
    """The encoder of this Python worker, with the chunks it already knows."""
    key = (hash(tokenizer), end)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer, end)
    return _ENCODERS[key]


def places(doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a lane may be cut, in order from 0 to its end, and the penalty of each place."""
    n = int(doc_ends[-1])
    kind = np.zeros(n + 1, np.int8)  # 1: inside a sentence, 2: its end, 3: a document's end
    kind[sentence_ends] = 2
    kind[doc_ends] = kind[0] = 3
    fixed = np.flatnonzero(kind)
    gaps = np.diff(fixed)
    step = min(STEP, length)
    wide = np.flatnonzero(gaps > step)
    times = (gaps[wide] - 1) // step
    kind[np.repeat(fixed[wide], times) + step * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + 1)] = 1
    tail = kind[max(0, n - length):]
    tail[tail == 0] = 1
    at = np.flatnonzero(kind)
    return at, np.array([0, INSIDE, SENTENCE, 0])[kind[at]]


def cuts(at: np.ndarray, penalty: np.ndarray, length: int) -> np.ndarray:
    """The places (0 and the end among them) whose windows cost least; of equal costs the longest window."""
    number = np.full(int(at[-1]) + 1, -1, np.int32)
    number[at] = np.arange(len(at))
    exact: dict[int, list[int]] = {}
    for k in range(min(length.bit_length(), int(at[-1]).bit_length())):
        first = np.searchsorted(at, 1 << k)
        before = number[at[first:] - (1 << k)]
        own = np.flatnonzero(before >= 0)
        for j, i in zip((own + first).tolist(), before[own].tolist()):
            exact.setdefault(j, []).append(i)
    pos, pen = at.tolist(), penalty.tolist()
    cost, back, rank = [0] * len(pos), [0] * len(pos), [0] * len(pos)
    queue: deque[int] = deque([0])  # places in order, ranks (cost + place) rising
    for j in range(1, len(pos)):
        here = pos[j]
        while pos[queue[0]] < here - length:
            queue.popleft()
        best = queue[0]
        least = rank[best] + length - here
        for i in exact.get(j, ()):
            if cost[i] < least:
                best, least = i, cost[i]
        cost[j] = least = least + pen[j]
        back[j] = best
        rank[j] = own = least + here
        while queue and rank[queue[-1]] > own:
            queue.pop()
        queue.append(j)
    out, j = [], len(pos) - 1
    while j:
        out.append(pos[j])
        j = back[j]
    return np.array([0, *reversed(out)], np.int64)


def pieces(doc_ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last place, document and window of every piece: what a document and a window share."""
    edges = np.union1d(bounds, doc_ends)
    first, last = edges[:-1], edges[1:]
    return first, last, np.searchsorted(doc_ends, first, side="right"), np.searchsorted(bounds, first, side="right") - 1


def pack(documents: DataFrame, tokenizer: str, length: int = 4096, end: int = 2, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and if asked the ids.

    tokenizer: path of a ``tokenizers`` file, read by the driver. ``end`` closes every document.
    """
    if Path(tokenizer).stat().st_size > MAX_FILE:
        raise ValueError(f"{tokenizer} has over {MAX_FILE} bytes")
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(Path(tokenizer).read_text())
    src = documents.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType

    def run(batches):
        encode = encoder(shared.value, end)
        task, done = TaskContext.get().partitionId(), 0
        doc_ids, texts, sentences, size = [], [], [], 0
        arrow_kind = None

        def lane() -> pa.RecordBatch:
            nonlocal done
            stream = np.concatenate(texts)
            sizes = np.array([len(t) for t in texts], np.int64)
            doc_ends = np.cumsum(sizes)
            bounds = cuts(*places(doc_ends, np.concatenate(sentences), length), length)
            first, last, doc, window = pieces(doc_ends, bounds)
            crc = [zlib.crc32(stream[i:j]) for i, j in zip(first.tolist(), last.tolist())]
            cols = [pa.array(doc_ids, arrow_kind).take(pa.array(doc)), pa.array(first - (doc_ends - sizes)[doc]), pa.array(last - first),
                    pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array((task << 32) + done + window), pa.array(first - bounds[window])]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(first, last[-1]), pa.int32()), pa.array(stream.view(np.int32))))
            done += len(bounds) - 1
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            arrow_kind = b.column(0).type
            for i, text in zip(b.column(0), b.column(1)):
                own, ends = encode(text.as_py() or "")
                doc_ids.append(i.as_py())
                texts.append(own)
                sentences.append(ends + size)
                size += len(own)
                if size >= LANE:
                    yield lane()
                    doc_ids, texts, sentences, size = [], [], [], 0
        if texts:
            yield lane()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * ids
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(c, T.LongType()) for c in names[1:7]]
                          + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids)
    return src.mapInArrow(run, schema)
