import hashlib

import numpy as np
import pytest

from wattspark.llm import blocks, word_windows


def brute(rows, width):
    docs = [(t or "").encode().split() for _, t in rows]
    seen = {}
    for w in docs:
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (d, _), w in zip(rows, docs):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone |= set(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed=3):
    rng = np.random.default_rng(seed)

    def words(n):
        return [f"w{x}é" for x in rng.integers(0, 4000, n)]
    passages = [words(n) for n in (10, 34, 35, 36, 60, 200)]
    rows = []
    for i in range(120):
        w = words(int(rng.integers(0, 80)))
        for _ in range(int(rng.integers(0, 3))):
            p = list(passages[int(rng.integers(0, len(passages)))])
            if rng.random() < 0.4:
                p[int(rng.integers(0, len(p)))] = "changed"
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = p
        rows.append((i, " ".join(w)))
    rows += [(500, rows[3][1]), (501, "\n".join(rows[3][1].split())), (502, None), (503, ""), (504, "same " * 300), (505, "a b " * 50),
             (None, rows[7][1]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("width,block_bytes", [(35, 4 << 20), (35, 3000), (9, 2000), (3, 2000)])
def test_same_as_brute_force(spark, monkeypatch, width, block_bytes):
    monkeypatch.setattr(blocks.pack, "__defaults__", (block_bytes,))
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int")
    got = word_windows.drop_repeats(df, width).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, width)


def test_covers_meet_every_shift():
    for p, cover in word_windows.COVERS.items():
        assert {(a - b) % p for a in cover for b in cover} == set(range(p))


def test_kept_texts_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d x"), (2, "y a b c d")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in word_windows.drop_repeats(df, 4, texts=True).collect()} == {1: "x", 2: "y"}
    assert word_windows.drop_repeats(df.limit(0)).count() == 0
