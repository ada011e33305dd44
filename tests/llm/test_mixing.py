import hashlib
import math

import numpy as np

from wattspark.llm import mixing


def brute_quantile(u, rate):
    k, p = 0, math.exp(-rate)
    cdf = p
    while cdf <= u:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_poisson_quantile_against_summation():
    u = np.random.default_rng(2).random(400)
    for rate in (0.01, 0.3, 1.0, 7.5, 90.0):
        assert mixing.poisson_quantile(u, rate).tolist() == [brute_quantile(x, rate) for x in u]
    big = mixing.poisson_quantile(u, 2e5)
    assert abs(big.mean() - 2e5) < 100 and abs(big.std() - math.sqrt(2e5)) < 50
    assert mixing.poisson_quantile(np.array([0.0, 1 - 2 ** -52]), 0.5).max() < 60
    assert mixing.poisson_quantile(u, 0.0).sum() == 0


def uniform(doc_id, text):
    key = f"mix-1:{'null' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}"
    return int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2 ** 52


def rows():
    out = [(i, f"s{'0' if i % 3 == 0 else i % 5}", "t" * (i % 40), 1) for i in range(900)]
    return out + [(901, None, "abc", 1), (902, "s1", None, 1), (None, "s1", "x", 1), (7, "s2", "t" * 7, 1)]


def test_copies_match_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, source string, text string, copy int")
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "source", "text", "copy", "copy_", "copies", "rate", "shuffle_key"]
    got = got.collect()
    units = {}
    for _, s, t, _ in data:
        units[s] = units.get(s, 0) + len((t or "").encode()) + 1
    weight = {s: math.floor(math.sqrt(n) * 1000) for s, n in units.items()}
    want = []
    for i, s, t, _ in data:
        u = uniform(i, t)
        n = brute_quantile(u, weight[s] * sum(units.values()) / (sum(weight.values()) * units[s]))
        want += [(str(i), str(s), str(t), k + 1) for k in range(n)]
    assert sorted((str(r.doc_id), str(r.source), str(r.text), r.copy_) for r in got) == sorted(want)


def test_given_weights_are_met(spark):
    df = spark.range(30000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source", "'abcdefg' as text")
    weights = spark.createDataFrame([("hot", 1), ("s1", 3), ("s2", 1), ("s3", 0)], "source string, weight long")
    got = {r.source: r.n for r in mixing.mix(df, weights).groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert set(got) == {"hot", "s1", "s2"}
    for s, w in (("hot", 1), ("s1", 3), ("s2", 1)):
        assert abs(got[s] / sum(got.values()) - w / 5) < 0.02


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_documents_without_an_id_draw_for_themselves(spark):
    data = [(None, "a", f"text {i}") for i in range(500)] + [(i, "b", "x" * 400) for i in range(500)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, source string, text string")).where("source = 'a'")
    rate = got.first().rate
    n = got.groupBy("text").count().collect()
    assert len({r["count"] for r in n}) > 4 and abs(got.count() - 500 * rate) < 6 * math.sqrt(500 * rate)


def test_repeated_rows_are_dealt_out_and_drawn_once(spark):
    data = [(1, "hot", "same")] * 600 + [(i, f"s{i % 3}", f"t{i}") for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string").repartition(4)
    weights = spark.createDataFrame([("hot", 50), ("s0", 1), ("s1", 1), ("s2", 1)], "source string, weight long")
    got = mixing.mix(df, weights)
    copies = got.where("source = 'hot'").agg({"copies": "max", "copy": "count"}).first()
    assert copies["count(copy)"] == 600 * copies["max(copies)"] > 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = got.where("source = 'hot'").selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 0.5 * sum(r["count"] for r in parts)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("ArrowEvalPython") == 1
