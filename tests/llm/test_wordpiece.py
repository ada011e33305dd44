import random

from hypothesis import given, settings
from hypothesis import strategies as st

from wattspark.llm import wordpiece


def greedy(pieces, word):
    n, at, known = 0, 0, set(pieces)
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at:at + k] in known), 0)
        if not size:
            return -1
        n, at = n + 1, at + size
    return n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=12),
       st.lists(st.integers(97, 99), max_size=30).map(bytes))
def test_same_count_as_the_greedy_match(pieces, word):
    assert wordpiece.Automaton(pieces).count(word) == greedy(pieces, word)


def test_public_vocabulary_and_documents(spark):
    pieces = wordpiece.read_vocabulary()
    known = set(pieces)
    rng = random.Random(3)
    texts = ["The quick brown fox", "naïve  café\tprätentiös\n日本語", "", None, "x" * 5000,
             " ".join("".join(rng.choices("abcdeéß", k=rng.randint(1, 12))) for _ in range(300))]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, "a b", 2)]
    got = wordpiece.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()

    def brute(t):
        words = (t or "").encode().split()
        counts = []
        for w in words:
            w, n = b" " + w, 0
            while w:
                size = next(k for k in range(min(len(w), 130), 0, -1) if w[:k] in known)
                w, n = w[size:], n + 1
            counts.append(n)
        return len(words), sum(counts), 0
    want = sorted((str(i), *brute(t)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in got) == want


def test_unknown_words_count_once(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text('{"model": {"vocab": {"\\u0120a": 0, "b": 1, "bb": 2}}}')
    df = spark.createDataFrame([(1, "abbb ac a"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in wordpiece.token_counts(df, str(path)).collect()}
    assert got == {1: (3, 3 + 1 + 1, 1), 2: (0, 0, 0)}
    assert wordpiece.token_counts(df.limit(0), str(path)).count() == 0
