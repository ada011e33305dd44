"""Language identification with a linear-chain conditional random field over words.

Every word has features: affixes of up to three letters, letter n-grams with
word boundaries, and membership in lexicons learned per language. Their
weights give the emission of a word; learned transitions link neighbouring
words; forward-backward gives each word its posterior over languages, so
code-switched text is labelled word by word. A document's language is the one
with the largest mean posterior over *all* its words, and that mean is its
score.

Training: labelled documents are sampled by a hash of their id, on average
``SAMPLE_DOCUMENTS`` for each language (a documented bound; the counts behind it
cover all rows). ``SEGMENTS`` runs of ``SEGMENT_WORDS`` words at hashed places of a
sampled text are joined with runs of other texts to code-switched sequences,
from which emissions and transitions are fitted by maximum likelihood with an
L2 penalty. The sample does not grow with the data; the model is broadcast.

Decoding: one narrow pass without a shuffle. Texts are decoded whole, each as one
chain, in blocks of ``BLOCK`` words side by side: what reaches a block from its
neighbours is worked out beforehand. Emissions of words already seen by a
task are kept, up to a fixed number.

Defined cases: null text or text without a letter is ``und`` with score 0;
without any label in the training rows every text is ``und``; repeated rows
each get their result; a null doc_id is not held out.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspark.llm.shared import free_name

SAMPLE_DOCUMENTS, SEGMENTS, SEGMENT_WORDS, SEQUENCE = 400, 4, 12, 5
BUCKETS = 1 << 16
ROUNDS, RATE, L2 = 80, 0.3, 1e-4
BLOCK, BATCH_CHARS, REMEMBERED, NEW_WORDS = 2_048, 4_000_000, 400_000, 20_000
UNDETERMINED = "und"
_LETTERS = r"[^\W\d_]+"
#: Combining marks stay inside the words of the scripts that write them.
_MARKS = "".join(chr(c) for c in range(0x300, 0x20000) if unicodedata.category(chr(c))[0] == "M")
_PLAIN, _MARKED = re.compile(_LETTERS), re.compile(rf"{_LETTERS}(?:[{_MARKS}]+[^\W\d_]*)*")


def words_of(text: str) -> list[str]:
    text = text.lower()
    try:
        text.encode("latin-1")  # no marks: the plain pattern finds the same words faster
    except UnicodeEncodeError:
        return _MARKED.findall(text)
    return _PLAIN.findall(text)


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed features of a word; a word with no letter has none."""
    if not any(map(str.isalpha, word)):
        return []
    bound = f"^{word}$"
    names = {f"p{word[:k]}" for k in (1, 2, 3)} | {f"s{word[-k:]}" for k in (1, 2, 3)}
    names |= {bound[i:i + k] for k in (2, 3) for i in range(len(bound) - k + 1)}
    if word in lexicon:
        names.add(f"lexicon {lexicon[word]}")
    return sorted({zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names} | {BUCKETS})


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, 0), np.float32))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    lexicon: dict[str, int] = field(default_factory=dict)

    def emissions(self, words: list[str]) -> tuple[np.ndarray, list[bool]]:
        """Positive emission factors (words x labels) and whether a word has a letter; one without is neutral."""
        own = [features(w, self.lexicon) for w in words]
        sizes = np.array([max(1, len(x)) for x in own])
        entry = np.concatenate([np.array(x or [BUCKETS]) for x in own])
        scores = np.add.reduceat(self.weights[entry].astype(np.float64), np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
        letters = [bool(x) for x in own]
        factors = np.maximum(np.exp(scores - scores.max(axis=1, keepdims=True)), 1e-30)
        factors[~np.array(letters)] = 1.0
        return factors, letters


def forward_backward(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray, enter: np.ndarray | None = None,
                     leave: np.ndarray | None = None) -> np.ndarray:
    """Posteriors (words x labels) of sequences laid end to end, longest first. emit and trans are positive factors.

    enter, leave: the message that reaches the first word of each sequence from the left, its last word from the right; default ones.
    """
    ones = np.ones((len(lengths), emit.shape[1]))
    enter, leave = ones if enter is None else enter, ones if leave is None else leave
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    post = np.empty_like(emit)
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    for t in range(steps):
        at = starts[:active[t]] + t
        f = (enter if t == 0 else last[:active[t]] @ trans) * emit[at]
        last = f / f.sum(axis=1, keepdims=True)
        post[at] = last
    back = np.ones((0, emit.shape[1]))
    for t in range(steps - 1, -1, -1):
        at = starts[:active[t]] + t
        now = leave[:active[t]].copy()
        now[:len(back)] = back
        post[at] *= now
        back = (now * emit[at]) @ trans.T
        back /= back.sum(axis=1, keepdims=True)
    return post / post.sum(axis=1, keepdims=True)


def through_blocks(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What each block (laid end to end, longest first) does to a message from its left: a matrix, worked out word by word side by side.

    first: whether the block begins its text, so that no transition leads into it.
    """
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    eye = np.eye(len(trans))
    out = np.where(first[:, None, None], eye, trans) * emit[starts][:, None, :]
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    for t in range(1, steps):
        n = active[t]
        out[:n] = (out[:n] @ trans) * emit[starts[:n] + t][:, None, :]
        if t % 8 == 0:
            out[:n] /= out[:n].sum(axis=(1, 2), keepdims=True)
    return out / out.sum(axis=(1, 2), keepdims=True)


def chain_messages(through: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """enter and leave of the blocks of one text, in order, from their matrices."""
    enter, leave = np.ones(through.shape[:2]), np.ones(through.shape[:2])
    ahead = np.ones(len(trans))
    for b in range(len(through) - 1):
        ahead = ahead @ through[b]
        ahead = ahead / ahead.sum()
        enter[b + 1] = ahead @ trans
    for b in range(len(through) - 2, -1, -1):
        leave[b] = through[b + 1] @ leave[b + 1]
        leave[b] /= leave[b].sum()
    return enter, leave


def _pair_counts(emit, trans, post, n):
    """Expected transitions of n sequences of equal length (forward-backward on (length, n, labels) arrays)."""
    steps = len(emit)
    fwd = np.empty_like(emit)
    for t in range(steps):
        f = emit[t] if t == 0 else (fwd[t - 1] @ trans) * emit[t]
        fwd[t] = f / f.sum(axis=1, keepdims=True)
    back, total = np.ones_like(emit[0]), np.zeros_like(trans)
    for t in range(steps - 1, -1, -1):
        g = fwd[t] * back
        post[t] = g / g.sum(axis=1, keepdims=True)
        if t:
            right = back * emit[t]
            joint = fwd[t - 1][:, :, None] * trans[None] * right[:, None, :]
            total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = right @ trans.T
            back /= back.sum(axis=1, keepdims=True)
    return total


def train(segments: list[tuple[str, list[str]]]) -> Model:
    """Fit on labelled word runs, given in a random but fixed order. Runs are joined to code-switched sequences."""
    labels = sorted({lang for lang, _ in segments})
    model = Model(labels)
    if not labels:
        return model
    code = {lang: i for i, lang in enumerate(labels)}
    seen: dict[str, Counter] = defaultdict(Counter)
    for lang, words in segments:
        for w in words:
            seen[w][code[lang]] += 1
    for w, n in seen.items():
        best, top = n.most_common(1)[0]
        if top >= 3 and top >= 0.8 * n.total():
            model.lexicon[w] = best
    vocab = {w: i for i, w in enumerate(sorted(seen))}
    lists = [features(w, model.lexicon) or [BUCKETS] for w in vocab]
    entry = np.concatenate([np.array(x) for x in lists])
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    first = np.concatenate(([0], np.cumsum([len(x) for x in lists])[:-1]))
    # sequences of one length: runs of other texts follow each other; what is left over starts again from the beginning
    flat = [(vocab[w], code[lang]) for lang, words in segments for w in words]
    length = SEQUENCE * SEGMENT_WORDS
    flat += (flat * (length // max(1, len(flat)) + 1))[:-len(flat) % length]
    seq = np.array(flat).reshape(-1, length, 2)
    ids, gold = seq[:, :, 0].T, seq[:, :, 1].T
    n_lab = len(labels)
    weights, trans = np.zeros((BUCKETS + 1, n_lab)), np.zeros((n_lab, n_lab))
    seen_gold = np.zeros((len(vocab), n_lab))
    np.add.at(seen_gold, (ids.ravel(), gold.ravel()), 1)
    seen_pairs = np.zeros_like(trans)
    np.add.at(seen_pairs, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)]
    post = np.empty((*ids.shape, n_lab))
    scale = 1 / ids.size
    for step in range(1, ROUNDS + 1):
        scores = np.add.reduceat(weights[entry], first, axis=0)
        emit = np.exp(scores - scores.max(axis=1, keepdims=True))[ids]
        pairs = _pair_counts(emit, np.exp(trans), post, ids.shape[1])
        flat_ids = ids.ravel()
        expected = np.column_stack([np.bincount(flat_ids, post[:, :, k].ravel(), len(vocab)) for k in range(n_lab)])
        by_word = (seen_gold - expected) * scale
        grad = np.column_stack([np.bincount(entry, by_word[owner, k], BUCKETS + 1) for k in range(n_lab)]) - L2 * weights
        grad_t = (seen_pairs - pairs) * scale - L2 * trans
        for x, g, m, v in ((weights, grad, moments[0], moments[1]), (trans, grad_t, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8) * min(1.0, 20 / step)
    model.weights, model.transitions = weights.astype(np.float32), trans
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> Model:
    """Train on a bounded sample of rows that have a lang and are not held out."""
    rows = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select(
        "lang", "text", F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not counts:
        return Model([])
    million = 1_000_000
    part = F.lit(0)
    for lang, n in counts.items():
        part = F.when(F.col("lang") == lang, F.lit(min(million, -(-sample_documents * million // n)))).otherwise(part)
    sampled = rows.where(F.pmod("h", F.lit(million)) < part).select("lang", "h", "text")

    def cut(batches):
        for b in batches:
            out = []
            for lang, h, text in zip(*(c.to_pylist() for c in b.columns)):
                words = words_of(text or "")
                for k in range(SEGMENTS if words else 0):
                    place = zlib.crc32(f"{h}:{k}".encode())
                    begin = place % max(1, len(words) - SEGMENT_WORDS + 1)
                    out.append((place, h, lang, [w[:100] for w in words[begin:begin + SEGMENT_WORDS]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())))],
                ["place", "h", "lang", "words"])

    runs = sampled.mapInArrow(cut, "place long, h long, lang string, words array<string>").collect()
    return train([(r.lang, r.words) for r in sorted(runs, key=lambda r: (r.place, r.h, r.lang, r.words))])


class _Decoder:
    def __init__(self, model: Model):
        self.model = model
        self.trans = np.exp(model.transitions)
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.letters: list[bool] = []
        self.factors = np.empty((0, len(self.model.labels)))

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Word numbers of each text; none if it has no letter."""
        known, out, new = self.known, [], []
        for text in texts:
            words = words_of(text) if text else []
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    new.append(w)
            out.append(np.array([known[w] for w in words], np.int64))
        if new:
            found = [self.model.emissions(new[i:i + NEW_WORDS]) for i in range(0, len(new), NEW_WORDS)]
            self.factors = np.concatenate([self.factors, *[f for f, _ in found]])
            self.letters += [x for _, letters in found for x in letters]
        letters = np.array(self.letters, bool)
        return [ids if len(ids) and letters[ids].any() else ids[:0] for ids in out]

    def posteriors(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """For each document: posteriors of its words."""
        blocks = [(d, i) for d, ids in enumerate(docs) for i in range(0, len(ids), BLOCK)]
        blocks.sort(key=lambda x: -min(BLOCK, len(docs[x[0]]) - x[1]))
        out = [np.empty((len(ids), len(self.model.labels))) for ids in docs]
        if blocks:
            parts = [docs[d][i:i + BLOCK] for d, i in blocks]
            lengths = np.array([len(p) for p in parts])
            emit = self.factors[np.concatenate(parts)]
            enter, leave = np.ones((2, len(blocks), len(self.model.labels)))
            long = [k for k, (d, _) in enumerate(blocks) if len(docs[d]) > BLOCK]
            if long:
                begins = np.cumsum(lengths) - lengths
                rows = np.concatenate([np.arange(begins[k], begins[k] + lengths[k]) for k in long])
                through = through_blocks(emit[rows], self.trans, lengths[long], np.array([blocks[k][1] == 0 for k in long]))
                of: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
                for m, k in enumerate(long):
                    of[blocks[k][0]].append((blocks[k][1], m, k))
                for own in map(sorted, of.values()):
                    at = [k for *_, k in own]
                    enter[at], leave[at] = chain_messages(through[[m for _, m, _ in own]], self.trans)
            post = forward_backward(emit, self.trans, lengths, enter, leave)
            at = 0
            for (d, i), n in zip(blocks, lengths):
                out[d][i:i + n] = post[at:at + n]
                at += n
        return out


def _runs(post: np.ndarray, labels: list[str]) -> list[dict]:
    """Maximal runs of words with one label: begin, end (word numbers, end excluded), lang."""
    best = post.argmax(axis=1)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(best)) + 1, [len(best)])) if len(best) else []
    return [{"begin": int(a), "end": int(b), "lang": labels[best[a]]} for a, b in zip(cuts[:-1], cuts[1:])]


def identify(documents: DataFrame, model: Model, carry: list[str] | None = None, spans: bool = False) -> DataFrame:
    """The carried columns (default: all) plus lang_pred, score and, if asked, spans (runs of words of one language)."""
    carry = documents.columns if carry is None else carry
    shared = documents.sparkSession.sparkContext.broadcast(model)
    src = documents.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), "text")

    def results(decoder, texts, labels):
        docs = decoder.ids(texts) if labels else [()] * len(texts)
        for ids, post in zip(docs, decoder.posteriors(docs) if labels else docs):
            if len(ids):
                mean = post.mean(axis=0)
                best = int(mean.argmax())
                yield labels[best], min(1.0, float(mean[best])), _runs(post, labels) if spans else None
            else:
                yield UNDETERMINED, 0.0, [] if spans else None

    def run(batches):
        decoder = _Decoder(shared.value)
        labels = shared.value.labels
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for b in batches:
            found, waiting, size = [], [], 0
            for x in b.column(1):
                waiting.append(x.as_py())
                size += len(waiting[-1] or "")
                if size >= BATCH_CHARS:
                    found += results(decoder, waiting, labels)
                    waiting, size = [], 0
                    if len(decoder.known) > REMEMBERED:
                        decoder.forget()
            if waiting:
                found += results(decoder, waiting, labels)
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()),
                                              pa.array(cols[2], kind)], ["doc", "lang_pred", "score", "spans"])

    run_type = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    out = src.mapInArrow(run, T.StructType([src.schema["doc"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                                            T.StructField("spans", T.ArrayType(run_type))]))
    kept = documents.select(*[F.col(f"`{c}`") for c in carry])
    add = ["lang_pred", "score"] + ["spans"] * spans
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in carry], *[F.col(c).alias(free_name(kept, c)) for c in add])


def drop_undetermined(documents: DataFrame) -> DataFrame:
    """``documents`` (all its columns) without the texts that are ``und``; all of them where no language could be learned."""
    model = fit(documents)
    if not model.labels:
        return documents
    out = identify(documents, model)
    lang, score = out.columns[-2:]
    return out.where(F.col(lang) != UNDETERMINED).drop(lang, score)
