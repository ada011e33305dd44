"""Quality classification by co-training of two views.

* text view: hashed lower-cased words, word endings and word shapes, and how
  often a word repeats the one before, as shares of a text's words;
* page-metadata view: the columns lang, source and n_chars, and layout counts
  of the page (lines, capitals, digits, marks, distinct words).

Two logistic classifiers start from the labelled sample. In each round either
one scores all unlabelled documents, and the ``MOVED`` of all that it is surest
of (in the proportion of the classes) join the *other* view's training set with
that label. Then each view is calibrated on labelled rows that no training has
seen, the calibrated log-odds are combined by a third small regression on the
same rows, and every document is scored. The labelled sample is drawn class by
class; calibration rows are weighted back to the shares of the classes among
all labels, so a score does not depend on the size of the table.

Training takes a bounded sample of the labelled rows, chosen by a hash of the
doc_id: on average ``LABELLED`` rows of each class. Both views of every document
are written once as sparse vectors; each round scores all unlabelled ones in
Spark, and only the rows that move (the same number at every size) come to the
driver. Mean and spread of the metadata are aggregates over all rows. Scoring is
one narrow pass over whole texts without a shuffle. A word's shape is that of
its first ``SHAPE`` bytes.

Defined cases: a null text is empty and has share zero of everything; null
metadata is a value of its own; several labels of one doc_id count by their
mean (a half counts as good), a null label not at all; without labels of both
classes every score is 0.5; repeated rows each get their result.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.llm.shared import stage_table

LABELLED = 2_000
TEXT_BUCKETS, LANG_BUCKETS, SOURCE_BUCKETS = 2_048, 16, 64
ROUNDS, MOVED, STEPS = 4, 200, 120
SHAPE = 40
REMEMBERED = 400_000
#: Rows whose texts a task has in memory at once.
PORTION = 1_000
_CAPITALS, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_LAYOUT = 8


def _hash(kind: str, raw: bytes, buckets: int) -> int:
    return zlib.crc32(kind.encode() + raw) % buckets


def _shape(word: bytes) -> bytes:
    out = bytearray()
    for b in word[:SHAPE]:
        c = 65 if 65 <= b <= 90 else 97 if b >= 128 or 97 <= b <= 122 else 48 if 48 <= b <= 57 else b
        if not out or out[-1] != c:
            out.append(c)
    return bytes(out)


def token_features(word: bytes) -> tuple[int, int, int]:
    low = word.lower()
    return (_hash("w", low, TEXT_BUCKETS), _hash("e", low[-3:], TEXT_BUCKETS), _hash("s", _shape(word), TEXT_BUCKETS))


class Tokens:
    """Numbers of the tokens seen by a task and their feature rows."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.rows = np.empty((0, 3), np.int32)

    def ids(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.__init__()
        known, new, out = self.known, [], []
        for raw in texts:
            words = (raw or b"").split()
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    new.append(token_features(w))
            out.append(np.array([known[w] for w in words], np.int64))
        if new:
            self.rows = np.concatenate((self.rows, np.array(new, np.int32)))
        return out


def repeats(ids: np.ndarray) -> float:
    return float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0


def text_vector(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Dense text view: shares of each hashed feature, and the share of repeated words."""
    out = np.zeros(TEXT_BUCKETS + 1, np.float32)
    if len(ids):
        out[:-1] = np.bincount(rows[ids].ravel(), minlength=TEXT_BUCKETS) / len(ids)
        out[-1] = repeats(ids)
    return out


def meta_vector(raw: bytes | None, ids: np.ndarray, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    raw = raw or b""
    size, words = max(1, len(raw)), max(1, len(ids))

    def share(marks):
        return (len(raw) - len(raw.translate(None, marks))) / size
    out = np.zeros(_LAYOUT + LANG_BUCKETS + SOURCE_BUCKETS, np.float32)
    out[:_LAYOUT] = (math.log1p(max(0, n_chars or 0)), math.log1p(len(ids)), raw.count(b"\n") / words, share(_CAPITALS), share(_DIGITS),
                     share(_MARKS), len(np.unique(ids)) / words, size / words / 10)
    out[_LAYOUT + _hash("l", b"?" if lang is None else b"=" + lang.encode(), LANG_BUCKETS)] = 1
    out[_LAYOUT + LANG_BUCKETS + _hash("o", b"?" if source is None else b"=" + source.encode(), SOURCE_BUCKETS)] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, l2: float = 1e-4, steps: int = STEPS) -> np.ndarray:
    """Weights of a logistic regression with both classes weighted alike; the last weight is the constant."""
    w = np.zeros(x.shape[1] + 1, np.float32) if start is None else start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())).astype(np.float32)
    for t in range(1, steps + 1):
        err = (y - 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))) * share
        g = np.append(x.T @ err - l2 * w[:-1], err.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w += (0.3 * min(1.0, 30 / t) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)).astype(np.float32)
    return w


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(log_odds(x, w), -30, 30)


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset that turn margins into log-odds (Newton steps with a little shrinkage)."""
    x = np.column_stack([z, np.ones_like(z)])
    weight = np.ones_like(z) if weight is None else weight
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 1e-3 * (w - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(w[0]), float(w[1])


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    text_fit: tuple[float, float]
    meta_fit: tuple[float, float]
    joint: np.ndarray

    def combine(self, z_text, z_meta):
        """Calibrated probabilities of the two views, and of both."""
        a = self.text_fit[0] * z_text + self.text_fit[1]
        b = self.meta_fit[0] * z_meta + self.meta_fit[1]
        both = self.joint[0] * a + self.joint[1] * b + self.joint[2]
        return tuple(1 / (1 + np.exp(-np.clip(s, -30, 30))) for s in (a, b, both))


class _Rows:
    """Unlabelled rows in memory."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.text, self.meta = text, meta

    def surest(self, models: list[np.ndarray], scale: tuple[np.ndarray, np.ndarray], good: float):
        """For each view: the text rows, metadata rows and labels of the rows it is surest of; both views' picks leave the pool."""
        taken, out = [], []
        for x, m in zip((self.text * 10, (self.meta - scale[0]) / scale[1]), models):
            z = log_odds(x, m)
            order = np.argsort(z, kind="stable")
            n_good, n_bad = _moved(len(z), good)
            sure_bad, sure_good = order[:n_bad], order[max(0, len(order) - n_good):]
            sure_bad, sure_good = sure_bad[z[sure_bad] < 0], sure_good[z[sure_good] > 0]
            picked = np.concatenate((sure_bad, sure_good))
            out.append((self.text[picked], self.meta[picked], np.repeat(np.float32([0, 1]), [len(sure_bad), len(sure_good)])))
            taken.append(picked)
        gone = np.unique(np.concatenate(taken))
        self.text, self.meta = np.delete(self.text, gone, axis=0), np.delete(self.meta, gone, axis=0)
        return out


def _moved(n: int, good: float) -> tuple[int, int]:
    """How many good and bad rows of n a view labels in a round: MOVED of them, in the classes' shares."""
    return tuple(min(n, max(1, round(share * MOVED))) for share in (good, 1 - good))


class _Table:
    """Unlabelled rows as a table of vectors: every round scores all of them in Spark, and only the surest come to the driver."""

    def __init__(self, vectors: DataFrame, known: DataFrame):
        self.vectors, self.known = vectors, known
        self.taken = np.empty(0, np.int64)

    def surest(self, models: list[np.ndarray], scale: tuple[np.ndarray, np.ndarray], good: float):
        spark = self.vectors.sparkSession
        shared = spark.sparkContext.broadcast((models, scale, self.taken))

        def run(batches):
            (w_text, w_meta), (mean, spread), taken = shared.value
            for b in batches:
                b = b.filter(pa.array(~np.isin(b["row"].to_numpy(), taken)))
                z = [10 * float(np.dot(w_text[np.frombuffer(i, np.uint16)].astype(float), np.frombuffer(v, np.float32))) + w_text[-1]
                     for i, v in zip(b["places"].to_pylist(), b["shares"].to_pylist())]
                meta = np.frombuffer(b"".join(b["meta"].to_pylist()), np.float32).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], b["hash"], pa.array(z, pa.float64()),
                                                  pa.array(log_odds((meta - mean) / spread, w_meta).astype(float), pa.float64())],
                                                 ["doc_id", "row", "hash", "z0", "z1"])

        kind = self.vectors.schema["doc_id"].dataType.simpleString()
        z = stage_table(self.vectors.select("doc_id", "row", "hash", "places", "shares", "meta").mapInArrow(
            run, f"doc_id {kind}, row long, hash long, z0 double, z1 double").join(self.known.select("doc_id"), "doc_id", "left_anti"), "quality-margins")
        n = z.count()
        if not n:
            return None
        n_good, n_bad = _moved(n, good)
        picks = []
        for c in ("z0", "z1"):
            bad = z.where(F.col(c) < 0).orderBy(c, "hash", "row").limit(n_bad).select("row").toArrow()["row"].to_numpy()
            best = z.where(F.col(c) > 0).orderBy(F.col(c).desc(), "hash", "row").limit(n_good).select("row").toArrow()["row"].to_numpy()
            picks.append((np.concatenate((bad, best)), np.repeat(np.float32([0, 1]), [len(bad), len(best)])))
        rows = np.unique(np.concatenate([p for p, _ in picks]))
        self.taken = np.union1d(self.taken, rows)
        wanted = spark.createDataFrame(pa.table({"row": pa.array(rows, pa.int64())}))
        found = self.vectors.join(F.broadcast(wanted), "row").select("row", "places", "shares", "meta").toArrow().sort_by("row")
        text, meta = _dense(found)
        at = [np.searchsorted(rows, p) for p, _ in picks]
        return [(text[i], meta[i], y) for i, (_, y) in zip(at, picks)]


def _dense(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    text = np.zeros((found.num_rows, TEXT_BUCKETS + 1), np.float32)
    for out, i, v in zip(text, found["places"].to_pylist(), found["shares"].to_pylist()):
        out[np.frombuffer(i, np.uint16)] = np.frombuffer(v, np.float32)
    return text, np.frombuffer(b"".join(found["meta"].to_pylist()), np.float32).reshape(found.num_rows, -1)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, check: np.ndarray, good: float | None = None,
             scale: tuple[np.ndarray, np.ndarray] | None = None, pool: _Table | None = None) -> Model | None:
    """y: 1, 0, or -1 without a label; check: labelled rows that are only used to calibrate.

    good: share of the good among all labels, where the rows given are drawn class by class; by default that of these rows.
    scale: mean and spread of the metadata, and pool: the unlabelled rows; by default those of the rows given.
    """
    learn = (y >= 0) & ~check
    if len(np.unique(y[learn])) < 2 or len(np.unique(y[(y >= 0) & check])) < 2:
        return None
    mean, spread = scale or (meta.mean(axis=0), meta.std(axis=0) + 1e-6)
    views = [text * 10, (meta - mean) / spread]
    own = [v[learn] for v in views]
    given = [y[learn].astype(np.float32)] * 2
    pool = pool or _Rows(text[y < 0], meta[y < 0])
    good = float(y[y >= 0].mean()) if good is None else good
    models = [None, None]
    for left in range(ROUNDS, -1, -1):
        models = [logistic(x, g, m) for x, g, m in zip(own, given, models)]
        picks = pool.surest(models, (mean, spread), good) if left else None
        if not picks:
            break
        for a, (t, m, label) in enumerate(picks):
            own[1 - a] = np.concatenate((own[1 - a], (m - mean) / spread if a == 0 else t * 10)).astype(np.float32)
            given[1 - a] = np.concatenate((given[1 - a], label))
    held = (y >= 0) & check
    target = y[held].astype(float)
    zs = [margin(v[held], m).astype(float) for v, m in zip(views, models)]
    # rows count so that the classes have the shares they have among all labels, and 1 on average
    weight = np.where(target > 0, good / target.mean(), (1 - good) / (1 - target.mean()))
    fits = [platt(z, target, weight) for z in zs]
    odds = np.column_stack([f[0] * z + f[1] for f, z in zip(fits, zs)])
    # the joint weights: logistic regression on the calibrated log-odds, shrunk towards their mean
    w = np.array([0.5, 0.5, 0.0])
    x = np.column_stack([np.clip(odds, -8, 8), np.ones(len(odds))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (target - p)) - (w - [0.5, 0.5, 0.0])
        w = w + np.clip(np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(3), grad), -1, 1)
    return Model(models[0], models[1], mean, spread, fits[0], fits[1], w)


def _columns(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("text").cast("binary").alias("raw"), F.col("lang").cast("string").alias("lang"),
                            F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def fit(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """Co-train on a bounded sample of labelled rows and all unlabelled ones; None without labels of both classes."""
    million = 1_000_000
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(23)), F.lit(million))
    known = stage_table(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("y")), "quality-known")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    part = F.when(F.col("y") == 1, F.lit(labelled * million // counts[1])).otherwise(F.lit(labelled * million // counts[0]))
    chosen = stage_table(known.where(draw < part).select(F.col("doc_id").alias("l_id"), "y"), "quality-labels")
    src = _columns(documents)

    def run(batches):
        tokens, part, n = Tokens(), TaskContext.get().partitionId(), 0
        for b in (whole.slice(i, PORTION) for whole in batches for i in range(0, whole.num_rows, PORTION)):
            cols = {c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names)}
            ids = tokens.ids(cols["raw"])
            places, shares = [], []
            for i in ids:
                dense = text_vector(i, tokens.rows)
                at = np.flatnonzero(dense)
                places.append(at.astype(np.uint16).tobytes())
                shares.append(dense[at].astype(np.float32).tobytes())
            meta = [meta_vector(*x).tobytes() for x in zip(cols["raw"], ids, cols["lang"], cols["source"], cols["n_chars"])]
            keys = [zlib.crc32(str(d).encode()) for d in cols["doc_id"]]
            same = [(k << 31) ^ zlib.crc32(raw or b"") for k, raw in zip(keys, cols["raw"])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array((part << 40) + n + np.arange(b.num_rows), pa.int64()), pa.array(keys, pa.int64()), pa.array(same, pa.int64()),
                 pa.array(places, pa.binary()), pa.array(shares, pa.binary()), pa.array(meta, pa.binary())],
                ["doc_id", "row", "key", "hash", "places", "shares", "meta"])
            n += b.num_rows

    kind = src.schema["doc_id"].dataType.simpleString()
    vectors = stage_table(src.mapInArrow(run, f"doc_id {kind}, row long, key long, hash long, places binary, shares binary, meta binary"),
                          "quality-vectors")

    def sums(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b["meta"].to_pylist()), np.float32).reshape(b.num_rows, -1).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1]) if b.num_rows else [], pa.int32()),
                                              pa.array(x.sum(axis=0) if b.num_rows else [], pa.float64()),
                                              pa.array((x * x).sum(axis=0) if b.num_rows else [], pa.float64()),
                                              pa.array([b.num_rows] * x.shape[1] if b.num_rows else [], pa.int64())], ["at", "x", "xx", "n"])

    moments = vectors.select("meta").mapInArrow(sums, "at int, x double, xx double, n long").groupBy("at").agg(
        F.sum("x").alias("x"), F.sum("xx").alias("xx"), F.sum("n").alias("n")).orderBy("at").toPandas()
    sample = vectors.join(chosen, F.col("doc_id") == F.col("l_id")).select("key", "hash", "y", "places", "shares", "meta").toArrow()
    sample = sample.sort_by([("key", "ascending"), ("hash", "ascending")])
    if not sample.num_rows:
        return None
    mean = (moments["x"] / moments["n"]).to_numpy()
    spread = np.sqrt(np.maximum((moments["xx"] / moments["n"]).to_numpy() - mean * mean, 0)) + 1e-6
    text, meta = _dense(sample)
    check = sample["key"].to_numpy() // 7 % 4 == 0
    return co_train(text, meta, sample["y"].to_numpy(), check, counts[1] / (counts[0] + counts[1]),
                    (mean.astype(np.float32), spread.astype(np.float32)), _Table(vectors, known))


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """One row per document row: doc_id, score_text, score_meta, score (probability of good quality) and keep (score at least a half)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    src = _columns(documents)

    def run(batches):
        m, tokens = shared.value, Tokens()
        for b in batches:
            if m is None:
                out = [np.full(b.num_rows, 0.5)] * 3
            else:
                zt, zm = np.empty(b.num_rows), np.empty(b.num_rows)
                for i in range(0, b.num_rows, PORTION):
                    raw, lang, source, n_chars = (b.column(c).slice(i, PORTION).to_pylist() for c in range(1, 5))
                    ids = tokens.ids(raw)
                    weight = m.text[:-2][tokens.rows].sum(axis=1) if len(tokens.rows) else np.empty(0)
                    zt[i:i + PORTION] = [10 * ((weight[x].mean() if len(x) else 0.0) + m.text[-2] * repeats(x)) + m.text[-1] for x in ids]
                    meta = np.array([meta_vector(*x) for x in zip(raw, ids, lang, source, n_chars)])
                    zm[i:i + PORTION] = margin((meta - m.mean) / m.spread, m.meta)
                out = m.combine(np.clip(zt, -30, 30), zm)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(s, pa.float64()) for s in out], pa.array(out[2] >= 0.5)],
                                             ["doc_id", "score_text", "score_meta", "score", "keep"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, score_text double, score_meta double, score double, keep boolean")
