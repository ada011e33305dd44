import zlib

import numpy as np
import pytest

from wattspark.llm import sharding


def docs(spark, n=3000, hot=0.33):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        text = "copy of one text" if i < n * hot else "wörd " * int(rng.integers(0, 60)) + str(int(rng.integers(0, 2000)))
        rows.append((i, text, 1))
    rows += [(n, None, 1), (n + 1, "", 1), (None, "zz", 1), (5, "copy of one text", 1), (5, "copy of one text", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, shard int")


@pytest.mark.parametrize("lane_rows", [20_000, 300])
def test_every_row_once_balanced_and_gapless(spark, monkeypatch, lane_rows):
    monkeypatch.setattr(sharding, "LANE_ROWS", lane_rows)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 30)
    rows, df = docs(spark)
    got = sharding.shard(df, 8, carry=["doc_id"]).collect()
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    by = {s: sorted(r.slot for r in got if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == len(rows)
    for key in (lambda r: r["size"], lambda r: 1):
        load = np.array([sum(key(r) for r in got if r["shard"] == s) for s in range(8)])
        assert load.max() - load.min() < 0.06 * load.mean()
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    # groups below a fiftieth of a shard stay whole
    groups = {}
    for r in got:
        groups.setdefault((r.text_crc32, r["size"]), []).append(r["shard"])
    total, n = sum(r["size"] for r in got), len(got)
    for (_, size), shards in groups.items():
        if max(size * len(shards) / total, len(shards) / n) * 8 * sharding.PARTS_PER_SHARD * 1.5 < 1:
            assert len(set(shards)) == 1


def test_all_columns_and_clashing_names(spark):
    _, df = docs(spark, 50)
    out = sharding.shard(df, 3)
    assert out.columns == ["doc_id", "text", "shard", "size", "text_crc32", "law", "shard_", "slot", "grown_shard"]
    assert out.count() == df.count()
    assert {r["shard"] for r in out.collect()} == {1} and {r["shard_"] for r in out.collect()} == {0, 1, 2}
    assert sharding.shard(df.limit(0), 3).count() == 0


def brute(rows, shards):
    """(size, crc) of every row, groups by text, and the bytes per shard that whole groups could reach at best."""
    sizes = [len((t or "").encode()) + 16 for _, t in rows]
    return sorted((str(i), n, zlib.crc32((t or "").encode())) for (i, t), n in zip(rows, sizes)), sum(sizes) / shards


@pytest.mark.parametrize("hot_id", [None, 77])
@pytest.mark.parametrize("lane_rows", [20_000, 500])
def test_a_third_of_all_rows_alike_in_id_and_text(spark, monkeypatch, hot_id, lane_rows):
    monkeypatch.setattr(sharding, "LANE_ROWS", lane_rows)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100)
    rng = np.random.default_rng(4)
    rows = [(hot_id, "one text that many rows repeat, id and all " * 5)] * 2000
    rows += [(i, "w " * int(rng.integers(1, 120)) + str(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sharding.shard(df, 8, carry=["doc_id"])
    got = out.collect()
    want, mean = brute(rows, 8)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    load = np.bincount([r["shard"] for r in got], [r["size"] for r in got], 8)
    assert abs(load - mean).max() < 0.06 * mean
    for s in range(8):
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    # no window holds more than a few buckets' worth of rows
    dealt, _ = sharding.place(sharding.measured(df, ["doc_id"]), 8)
    assert max(r[0] for r in dealt.groupBy("gkey", "part").count().select("count").collect()) < 2 * 6000 / (8 * sharding.PARTS_PER_SHARD) + 30
