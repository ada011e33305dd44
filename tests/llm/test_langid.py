import zlib

import numpy as np

from pyspark.sql import functions as F

from wattspark.llm import langid

SYLLABLES = {"aa": ["tha", "ing", "er", "on", "wh"], "bb": ["ñar", "ció", "que", "osa", "í"], "cc": ["ßch", "ung", "ver", "zu", "ö"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


def corpus(seed=1, n=240):
    rng = np.random.default_rng(seed)
    langs = list(SYLLABLES)
    return [(i, text(rng, langs[i % 3], int(rng.integers(3, 60))), langs[i % 3]) for i in range(n)]


def brute_posteriors(emit, trans):
    """Sum over all label sequences."""
    from itertools import product
    out = np.zeros_like(emit)
    for path in product(range(emit.shape[1]), repeat=len(emit)):
        p = np.prod([emit[t, k] for t, k in enumerate(path)]) * np.prod([trans[a, b] for a, b in zip(path, path[1:])])
        for t, k in enumerate(path):
            out[t, k] += p
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(3)
    trans = rng.random((3, 3)) + 0.1
    seqs = [rng.random((n, 3)) + 0.01 for n in (6, 4, 4, 1)]
    got = langid.forward_backward(np.concatenate(seqs), trans, np.array([6, 4, 4, 1]))
    assert np.allclose(got, np.concatenate([brute_posteriors(s, trans) for s in seqs]))


def test_held_out_accuracy_nulls_and_clashing_names(spark):
    rows = corpus() + [(900, None, "aa"), (901, "", "bb"), (902, "123 ... 4_5 ²", "cc"), (903, text(np.random.default_rng(9), "bb", 40), None),
                       (None, text(np.random.default_rng(8), "cc", 40), "cc"), (903, "ing tha", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    model = langid.fit(df)
    got = langid.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang", "score", "lang_pred", "score_"]
    out = got.select("doc_id", "text", "lang", "lang_pred", "score_", langid.held_out(F.col("doc_id")).alias("held_out")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score_ <= 1
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score_) == ("und", 0.0)
    known = [r for r in out if r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in known) / len(known) > 0.97
    assert [r.lang_pred for r in out if r.doc_id == 903 and len(r.text) > 10] == ["bb"]
    kept = langid.drop_undetermined(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert langid.words_of('नमस्ते दुनिया, É e\u0301t 4') == ['नमस्ते', 'दुनिया', 'é', 'e\u0301t']


def test_code_switched_spans_and_long_texts(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = langid.fit(df)
    switched = text(rng, "aa", 30) + " " + text(rng, "bb", 30)
    long = text(rng, "cc", 9_000)  # several blocks
    docs = spark.createDataFrame([(1, switched), (2, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(docs, model, carry=["doc_id"], spans=True).collect()}
    spans = got[1].spans
    assert spans[0].lang == "aa" and spans[-1].lang == "bb" and spans[-1].end == 60
    assert sum(s.end - s.begin for s in spans if s.lang == "aa") in range(27, 34)
    assert got[2].lang_pred == "cc" and got[2].spans[-1].end == 9_000
    # the same text gives the same answer wherever it stands
    assert langid.identify(docs.where("doc_id = 2"), model, carry=["doc_id"]).first().score == got[2].score


def whole_chain(model, words):
    """Posteriors of one text as one chain, plainly."""
    emit, trans = model.emissions(words)[0], np.exp(model.transitions)
    fwd, bwd = [emit[0] / emit[0].sum()], [np.ones(len(model.labels))]
    for e in emit[1:]:
        f = (fwd[-1] @ trans) * e
        fwd.append(f / f.sum())
    for e in emit[:0:-1]:
        b = trans @ (e * bwd[-1])
        bwd.append(b / b.sum())
    post = np.array(fwd) * np.array(bwd[::-1])
    return post / post.sum(axis=1, keepdims=True)


def test_whole_query_is_a_plain_decode(spark, monkeypatch):
    """Long switched texts, cut into blocks, are decoded as one chain."""
    monkeypatch.setattr(langid, "BLOCK", 16)
    rng = np.random.default_rng(11)
    rows = corpus()
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    rows += [(1000 + i, " ".join(text(rng, list(SYLLABLES)[int(rng.integers(0, 3))], int(rng.integers(1, 25))) for _ in range(12)), None)
             for i in range(30)] + [(2000, None, None), (2001, "12", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, carry=["doc_id"], spans=True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        words = langid.words_of(t or "")
        if not words:
            assert (by[i].lang_pred, by[i].score, by[i].spans) == ("und", 0.0, [])
            continue
        post = whole_chain(model, words)
        mean = post.mean(axis=0)
        assert by[i].lang_pred == model.labels[int(mean.argmax())] and abs(by[i].score - mean.max()) < 1e-9
        labels = [model.labels[k] for k in post.argmax(axis=1)]
        assert [s.lang for s in by[i].spans for _ in range(s.end - s.begin)] == labels


def test_mixed_texts_of_five_languages_stay(spark):
    rng = np.random.default_rng(6)
    alphabets = {"aa": "abcd", "bb": "efgh", "cc": "ijkl", "dd": "mnop", "ee": "qrst"}

    def words(lang, n):
        return " ".join("".join(rng.choice(list(alphabets[lang]), 6)) for _ in range(n))
    langs = list(alphabets)
    rows = [(i, words(langs[i % 5], 30), langs[i % 5]) for i in range(200)]
    rows += [(1000 + i, " ".join(words(x, 12) for x in langs), langs[i % 5]) for i in range(40)]  # evenly mixed
    df = spark.createDataFrame([*rows, (5000, "1 2 3", "aa"), (5001, None, "aa")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in langid.drop_undetermined(df).collect()) == sorted(r[0] for r in rows)
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert langid.drop_undetermined(unlabelled).count() == df.count()


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "ing tha", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.labels == [] and langid.identify(df, model).first().lang_pred == "und"
    assert langid.identify(df.limit(0), model).count() == 0
