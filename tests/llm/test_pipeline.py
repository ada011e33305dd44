import math
import zlib

import numpy as np

import corpus_pipeline
from tests.llm import test_decontaminate, test_mixing, test_simhash


def corpus():
    rng = np.random.default_rng(12)
    syllables = [["tha", "ing", "er", "on"], ["ñar", "ció", "que", "osa"]]

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 5))) for _ in range(n))
    items = [(i, text(i % 2, 20)) for i in range(6)]
    rows = []
    for i in range(150):
        lang = i % 2
        t = text(lang, int(rng.integers(20, 90)))
        if i % 11 == 0:
            t += " " + items[i % 6][1]
        rows.append((i, t, ["en", "es"][lang], "hot" if i % 3 == 0 else f"s{i % 4}", len(t)))
    for i in range(40):  # exact and near copies
        words = rows[i][1].split()
        if i % 2:
            words[-1] = "ing"
        rows.append((1000 + i, " ".join(words), rows[i][2], rows[i][3], 1))
    rows += [(2000, None, "en", "hot", None), (2001, "123 456", None, None, 7), (2002, rows[5][1], None, None, None), (5, *rows[5][1:])]
    return rows, items


def test_run_is_the_brute_force_of_its_stages(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    comps = test_simhash.brute_components([r[0] for r in left], [test_simhash.brute_fingerprint(r[1]) for r in left])
    first = {}
    for r, c in zip(left, comps):
        if r[0] == c:
            first.setdefault(c, r)
    left = list(first.values())
    bad = {d for d, *_, contaminated in test_decontaminate.brute([r[:2] for r in left], items) if contaminated}
    left = [r for r in left if str(r[0]) not in bad]
    units = {}
    for r in left:
        units[r[3]] = units.get(r[3], 0) + len(r[1].encode()) + 1
    weight = {s: math.floor(math.sqrt(n) * 1000) for s, n in units.items()}
    want = []
    for r in left:
        u = test_mixing.uniform(r[0], r[1])
        n = test_mixing.brute_quantile(u, weight[r[3]] * sum(units.values()) / (sum(weight.values()) * units[r[3]]))
        want += [(r[0], len(r[1].encode()) + 16, zlib.crc32(r[1].encode()))] * n
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r.slot)
    assert set(by) <= set(range(40)) and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_stages_return_the_columns_of_documents_and_take_empty_tables(spark, tmp_path):
    _, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, copy int, fp string, shard int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns, name
