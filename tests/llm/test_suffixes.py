import hashlib

import numpy as np
import pytest

from wattspark.llm import suffixes


def brute(rows, length):
    docs = [(t or "").encode() for _, t in rows]
    seen = {}
    for d in docs:
        for i in range(len(d) - length + 1):
            seen[d[i:i + length]] = seen.get(d[i:i + length], 0) + 1
    out = []
    for (doc, _), d in zip(rows, docs):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((str(doc), len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed=4):
    rng = np.random.default_rng(seed)

    def text(n):
        return "".join(rng.choice(list("ab é\n"), n))
    passages = [text(n) for n in (60, 399, 400, 405, 700, 1500)]
    rows = []
    for i in range(60):
        t = text(int(rng.integers(0, 900)))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(0, len(passages)))]
            if rng.random() < 0.5:
                at = int(rng.integers(0, len(p)))
                p = p[:at] + "X" + p[at + 1:]
            at = int(rng.integers(0, len(t) + 1))
            t = t[:at] + p + t[at:]
        rows.append((i, t))
    rows += [(100, rows[2][1]), (101, None), (102, ""), (103, "z" * 1000), (104, "z" * 401), (105, "xy" * 300), (106, "\0\1" * 230),
             (None, rows[5][1]), (2, rows[2][1])]
    return rows


@pytest.mark.parametrize("length,block_bytes", [(400, 4 << 20), (400, 5000), (40, 3000), (9, 9000)])
def test_same_as_brute_force(spark, monkeypatch, length, block_bytes):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block_bytes)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_spans int")
    got = suffixes.drop_repeats(df, length).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, length)


@pytest.mark.parametrize("alphabet", [1, 2, 4, 250])
def test_two_stage_order_is_the_suffix_order(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (1, 2, 30, 400):
        x = np.append(rng.integers(1, alphabet + 1, n), 0).astype(np.uint16)
        starts = np.arange(n)
        got = suffixes.suffix_order(x, starts, n + 1, suffixes.packed_symbols(x))
        assert got.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_kept_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "abcdefX"), (2, "Yabcdef")], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in suffixes.drop_repeats(df, 6, texts=True).collect()} == {1: b"X", 2: b"Y"}
    assert suffixes.drop_repeats(df.limit(0)).count() == 0


def shared_passage(n=90):
    """One passage in many texts, each time in other surroundings; some strings over its edges do repeat."""
    rng = np.random.default_rng(9)

    def text(k):
        return "".join(rng.choice(list("abcdefgh "), k))
    passage, sides = text(60), [text(50) for _ in range(5)]
    return [(i, (text(80) if i % 4 else sides[i % 5]) + passage + (text(80) if i % 3 else sides[i % 5])) for i in range(n)]


@pytest.mark.parametrize("block_bytes", [4 << 20, 1500])
def test_an_anchor_of_many_segments_is_dealt_out(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(suffixes, "MANY", 12)
    rows = shared_passage() + [(None if i is None else 500 + i, t) for i, t in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.drop_repeats(df, 80).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 80)
    # 20 leading bits: a range is an anchor
    packed = suffixes.B.pack(spark.createDataFrame(shared_passage(), "doc_id long, text string"), block_bytes, more=suffixes.stored_segments(80))
    known = packed.join(suffixes.ask_anchors(packed, 80, 20), "block", "left")
    sent = suffixes.send_segments(known, 80, 20).selectExpr("range", "length(sizes) / 8 as n").groupBy("range").sum("n").collect()
    assert sent and max(r[1] for r in sent) <= 12
    assert suffixes.ask_strings(known, 80, 20).count() > 0


@pytest.mark.parametrize("block_bytes", [4 << 20, 6000])
def test_planted_passages_are_removed_and_other_documents_left_alone(spark, monkeypatch, block_bytes):
    """Passages of 400 bytes and more: exact copies, a hot passage in a third of the documents, also over the borders of blocks."""
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(21)

    def text(k):
        return "".join(rng.choice(list("abcdefghijklm nop é"), k))
    hot, pair, short = text(600), text(450), text(300)
    rows = [(i, text(400) + hot + text(300)) for i in range(60)]
    rows += [(100 + i, text(int(rng.integers(500, 2500))) + pair + text(20)) for i in range(2)]
    rows += [(200 + i, copy) for copy in [text(900)] for i in range(5)]
    clean = [(300 + i, text(int(rng.integers(0, 1500)))) for i in range(60)] + [(400 + i, text(200) + short + text(200)) for i in range(20)]
    df = spark.createDataFrame([(d, t, "x", 1.0) for d, t in rows + clean], "doc_id long, text string, raw string, block double")
    got = suffixes.drop_repeats(df, 400).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows + clean, 400)
    removed = {r.doc_id: r.n_removed for r in got}
    least = {0: len(hot.encode()), 1: len(pair.encode()), 2: 900}
    assert all(removed[d] >= least[d // 100] for d, _ in rows) and all(removed[d] == 0 for d, _ in clean)
