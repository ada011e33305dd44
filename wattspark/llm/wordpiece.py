"""Token counts by a linear longest-match automaton.

A word's pieces are the greedy longest vocabulary entries from its start. The
vocabulary is a trie with failure links: where no edge continues, the pieces
that the greedy match must have completed are popped at once and the walk goes
on at the failure node, so every byte is looked at once. Only the *number* of
popped pieces is kept with each link; the pieces themselves are never built.

A vocabulary comes from a file named by the caller (token -> id, byte-level
spelling with a mark for a leading space); it is read on the driver, its size
is bounded by the file, and the automaton is broadcast. Words are the
white-space separated byte runs of the whole text, each matched with a leading
space. A word that the vocabulary cannot cover counts as one unknown piece.
Counts of words already seen by a task are remembered, up to a fixed number.

Defined cases: a null or empty text has no words and no tokens; repeated rows
each get their result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
REMEMBERED = 500_000


def byte_spelling() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, as character -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a tokenizer file as bytes; special pieces that spell no bytes are left out."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    spelled = byte_spelling()
    return sorted(bytes(spelled[c] for c in token) for token in vocab if token and all(c in spelled for c in token))


class Automaton:
    """Trie over pieces; ``fail`` and ``pops``: where to go on and how many pieces are complete by then."""

    def __init__(self, pieces: list[bytes]):
        self.edges: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            at = 0
            for b in piece:
                nxt = self.edges[at].get(b)
                if nxt is None:
                    nxt = self.edges[at][b] = len(self.edges)
                    self.edges.append({})
                    ends.append(False)
                at = nxt
            ends[at] = at != 0
        self.fail = [-1] * len(self.edges)
        self.pops = [0] * len(self.edges)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for b, child in self.edges[at].items():
                queue.append(child)
                if ends[child]:  # the whole path is the longest match: pop it and start anew
                    self.fail[child], self.pops[child] = 0, 1
                    continue
                back, popped = self.fail[at], self.pops[at]
                while back >= 0 and b not in self.edges[back]:
                    popped += self.pops[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[child], self.pops[child] = self.edges[back][b], popped

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces; -1 if they do not cover the word."""
        at, n, edges, fail, pops = 0, 0, self.edges, self.fail, self.pops
        for b in word:
            while (nxt := edges[at].get(b)) is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return -1
            at = nxt
        while at:  # what is left must end in complete pieces
            n += pops[at]
            at = fail[at]
            if at < 0:
                return -1
        return n


class _Counts(dict):
    """Word -> pieces (an unknown word is one), filled on demand and emptied when it has grown to a bound."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(b" " + word)
        if len(word) <= 64:
            self[word] = n
        return n


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document row: doc_id, n_words, n_tokens and n_unknown (words that count as one unknown piece)."""
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    src = documents.select("doc_id", F.col("text").cast("binary").alias("raw"))

    def run(batches):
        counts = _Counts(Automaton(shared.value))
        for b in batches:
            words, tokens, unknown = [], [], []
            for x in b.column(1):
                got = [counts[w] for w in (x.as_py() or b"").split()]
                bad = got.count(-1)
                words.append(len(got))
                tokens.append(sum(got) + 2 * bad)
                unknown.append(bad)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, pa.int64()) for v in (words, tokens, unknown)]],
                                             ["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
