import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wattspark.llm import spelling


def brute_words(rows, every=199, shortest=6, least=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    form, out = {}, []
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def vocabulary(seed, n, letters="abé"):
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list(letters), rng.integers(6, 11))) for _ in range(n)}
    words |= {"tion" * 2 + w for w in list(words)[:n // 3]}  # one long prefix in a third of the words
    return {w: int(5 * 6 ** rng.integers(0, 6)) + int(rng.integers(0, 3)) for w in sorted(words)}


@pytest.mark.parametrize("frequent,known", [(1 << 13, 1 << 16), (30, 300), (8, 20)])
def test_variants_are_brute_force(spark, monkeypatch, frequent, known):
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    monkeypatch.setattr(spelling, "KNOWN", known)
    words = vocabulary(frequent, 700)
    want = brute(words)
    assert any(r[2] not in (r[0], r[1]) for r in want) and sum(r[4] for r in want) > 400
    assert result(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == want


def test_grams_depend_on_their_own_letters_and_edits_stay_within_the_bound():
    rng = np.random.default_rng(5)
    words = [("".join(rng.choice(list("abc"), rng.integers(6, 12)))) for _ in range(300)]
    count = Counter((w + spelling.END)[p:p + q] for w in words for q in range(2, 6) for p in range(len(w)))
    sizes = set()
    for w in words:
        grams = spelling.decompose(w, count, 40)
        sizes |= {len(g) for g in grams}
        assert len(grams) == len(w) and all((w + spelling.END)[p:].startswith(g) for p, g in enumerate(grams))
        bound = spelling.affected(grams)
        for i in range(len(w)):
            for other in (w[:i] + w[i + 1:], w[:i] + "b" + w[i + 1:], w[:i] + "c" + w[i:]):
                shared = Counter(grams) & Counter(spelling.decompose(other, count, 40))
                assert sum(shared.values()) >= len(grams) - bound
    assert len(sizes) > 2


def test_documents_are_brute_force(spark):
    rng = np.random.default_rng(8)
    base = ["Thering", "stationed", "ÉRONDER", "éronder", "ab×cdef", "short", "onreand", "nationed"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = str(rng.choice(base, p=[.4, .2, .1, .1, .05, .05, .05, .05]))
            if rng.random() < 0.1:
                at = int(rng.integers(0, len(w)))
                w = w[:at] + str(rng.choice(["", "x", "ÿ"])) + w[at + 1:]
            words.append(w)
        rows.append((i, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    rows += [rows[3]] * 200 + [(None, rows[4][1])] * 3 + [(1, None), (2, ""), (None, None), (9, "stationed " * 20_000)]
    want = brute(brute_words(rows, 19))
    assert len(want) > 20
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, word string, n int")
    assert result(spelling.group(df, every=19)) == want


def test_empty_table_and_words_without_partners(spark):
    df = spark.createDataFrame([(1, "lonely " * 5 + "others " * 4)], "doc_id long, text string")
    assert result(spelling.group(df, every=10 ** 9)) == [("lonely", None, "lonely", 5, 0, None)]
    assert result(spelling.group(df.limit(0))) == []


def test_short_words_are_refused(spark):
    with pytest.raises(Exception, match="words need over"):
        spelling.variants(spark.createDataFrame([("abc", 5)], "word string, n long")).collect()
