import hashlib
import re

import numpy as np
import pytest

from wattspark.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, width=13):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in wins}:
            for i in range(len(w) - size + 1):
                key = tuple(w[i:i + size])
                if key in wins:
                    hit |= set(range(i, i + size))
                    found |= {str(x) for x in wins[key] if x is not None}
        out.append((str(doc), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def corpus():
    rng = np.random.default_rng(6)
    vocab = ["the", "Of", "é", "ÉA", "x9", "and", "mot", "zwölf"]

    def text(n):
        return " ".join(rng.choice(vocab, n)) if n else ""
    items = [(i, text(int(rng.integers(1, 40)))) for i in range(12)]
    items += [(50, items[3][1]), (51, None), (52, "..."), (None, items[4][1]), (53, "solo"), (54, "two words"), (3, items[3][1])]
    rows = []
    for i in range(80):
        parts = [text(int(rng.integers(0, 30)))]
        if i % 3 == 0:
            parts.append(items[int(rng.integers(0, len(items)))][1] or "")
        if i % 7 == 0:
            parts.append(" ".join((items[2][1] or "").split()[3:]))
        rows.append((i, ", ".join(parts + [text(int(rng.integers(0, 30)))])))
    rows += [(200, None), (201, ""), (202, "!!"), (203, "solo"), (204, items[0][1] * 1), (None, items[1][1]), (3, rows[3][1]), (3, "other text")]
    rows += [(300, "filler " * 4000 + items[6][1])]
    return rows, items


@pytest.mark.parametrize("options", [{}, {"block_bytes": 400}, {"width": 4}, {"shingle": 1}])
def test_same_as_brute_force(spark, options):
    rows, items = corpus()
    docs = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, wid int, w string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, win int")
    got = dc.find_contamination(docs, bench, **options)
    want = brute(rows, items, options.get("width", 13))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want
    if not options:
        kept = dc.drop_contaminated(docs, bench)
        assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)


def test_empty_tables_and_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.find_contamination(docs.limit(0), bench).count() == 0
    none = dc.find_contamination(docs, bench.limit(0)).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in none} == {(1, 3, 0, False), (2, 0, 0, False)}
    plan = dc.find_contamination(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_dropping_keeps_every_column_whatever_its_name(spark):
    rows = [(1, "one two three four", "a"), (2, "clean words only", "b"), (None, "one two three four", "c"), (None, "clean", "d"), (2, "one two three four", "e")]
    names = ["doc_id", "text", "doc", "tkey", "__bad_id", "__bad_key", "contaminated"]
    docs = spark.createDataFrame([(*r, 5, "x", "y", 1.0) for r in rows], "doc_id long, text string, doc string, tkey long, __bad_id string, "
                                                                        "__bad_key string, contaminated double")
    kept = dc.drop_contaminated(docs, spark.createDataFrame([(1, "one two three")], "item_id long, text string"))
    assert kept.columns == names and sorted(r.doc for r in kept.collect()) == ["b", "d"]
