import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wattspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]


def padding(size, length):
    return 0 if size & (size - 1) == 0 else length - size


def brute_cost(at, penalty, length):
    cost = [0] + [10 ** 9] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            if at[j] - at[i] <= length:
                cost[j] = min(cost[j], cost[i] + padding(at[j] - at[i], length) + penalty[j])
    return cost[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), min_size=1, max_size=12), st.integers(0, 99), st.sampled_from([16, 32, 64]))
def test_cuts_cost_what_brute_force_finds(sizes, seed, length):
    rng = np.random.default_rng(seed)
    ends = np.cumsum(sizes)
    sentences = np.unique(rng.integers(0, ends[-1] + 1, rng.integers(0, 20)))
    at, penalty = packing.places(ends, sentences, length)
    assert at[0] == 0 and at[-1] == ends[-1] and np.diff(at).min() > 0 and np.diff(at).max() <= length
    bounds = packing.cuts(at, penalty, length)
    own = dict(zip(at.tolist(), penalty.tolist()))
    got = sum(padding(int(b - a), length) + own[int(b)] for a, b in zip(bounds[:-1], bounds[1:]))
    assert set(bounds.tolist()) <= set(own) and np.diff(bounds).max() <= length
    assert got == brute_cost(at.tolist(), penalty.tolist(), length)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(SPACES + ["it's", "a.", "é", "́", "<|endoftext|>", "Σ", "İ", "İ.", "Naïve,", "naïve", "ÉT?!", "don't.", "A.b", "ß!", "ÿ;", " ", "\x1c", "x\x1fy"])),
                max_size=20).map("".join))
def test_ids_are_the_tokenizers(text):
    encode = packing.Encoder(open(PATH).read(), 2) if not hasattr(test_ids_are_the_tokenizers, "one") else test_ids_are_the_tokenizers.one
    test_ids_are_the_tokenizers.one = encode
    ids, ends = encode(text)
    assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids + [2]
    assert all(0 <= e < len(ids) for e in ends)


def test_whole_documents_have_the_tokenizers_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5_000)
    encode = packing.Encoder(open(PATH).read(), 2)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert encode(r.text or "")[0].tolist() == TOKENIZER.encode(r.text or "", add_special_tokens=False).ids + [2]


def test_sentences_end_at_stops_and_lines():
    ids, ends = packing.Encoder(open(PATH).read(), 2)('one two. three "four!" 3.5 five\nsix')
    words = [TOKENIZER.encode(t, add_special_tokens=False).ids for t in ("one two.", 'three "four!"', "3.5 five", "six")]
    assert ends.tolist() == np.cumsum([len(w) for w in words]).tolist()


def rows_of():
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["tha", "ing.", "eron", "Pa-pa", "\n", "ñ"], rng.integers(0, 200)))) for i in range(120)]
    rows += [(7, rows[7][1])] * 60  # repeated rows
    rows += [(500 + i, "same text. over and over") for i in range(80)]
    return rows + [(None, "no id"), (None, None), (901, None), (902, ""), (903, "word" * 9000), (904, "long one. " * 4000), (905, "a<|endoftext|>b")]


@pytest.mark.parametrize("lane", [1 << 21, 3000])
def test_every_id_in_one_piece(spark, monkeypatch, lane):
    monkeypatch.setattr(packing, "LANE", lane)
    rows = rows_of()
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, offset long, sequence_id long").repartition(3)
    out = packing.pack(df, PATH, 256, ids=True)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    got = out.collect()
    # sequences: gapless offsets, at most 256 tokens
    by = {}
    for r in got:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 256
        sizes.append(at)
    # documents: the pieces of all rows of an id hold each row's ids once
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2])
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append(r)
    assert set(have) == set(want)
    for i, texts in want.items():
        covered = {}
        for r in have[i]:
            match = [t for t in texts if len(t) == r.doc_tokens and t[r.start:r.start + r.length] == r.ids]
            assert match
            for p in range(r.start, r.start + r.length):
                covered[r.doc_tokens, p] = covered.get((r.doc_tokens, p), 0) + 1
        assert covered == {(n, p): sum(len(t) == n for t in texts) for n in {len(t) for t in texts} for p in range(n)}
    total = sum(sizes)
    assert sum(padding(s, 256) for s in sizes) < 0.06 * total


def test_padding_is_little_at_full_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = [r.n for r in packing.pack(docs, PATH).groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()]
    assert sum(padding(s, 4096) for s in sizes) < 0.01 * sum(sizes)
    whole = packing.pack(docs, PATH)
    assert whole.where("start = 0").count() == docs.count()


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id string, text string, length string")
    assert [tuple(r)[:3] for r in packing.pack(df, PATH).collect()] == [("1", 0, 2)]
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError, match="does not normalise"):
        packing.Encoder(open(PATH).read().replace('"Lowercase"', '"Uppercase"'), 2)
