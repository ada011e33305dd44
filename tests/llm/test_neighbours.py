import numpy as np
import pytest

from wattspark.llm import neighbours


def frame(spark, vectors, extra=()):
    rows = [(int(i), [float(x) for x in v], 1) for i, v in vectors] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def brute(vectors, every, k=5):
    ids = np.array([i for i, _ in vectors])
    x = np.array([np.float32(v).astype(float) for _, v in vectors])
    size = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q] / (size * size[q])
        own = np.flatnonzero(ids != ids[q])
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in own[np.lexsort((ids[own], -np.round(s[own], 12)))][:k]]
    return out


def test_walk_meets_cells_by_summed_distance():
    rng = np.random.default_rng(1)
    left, right = rng.random(7), rng.random(9)
    counts = rng.integers(0, 3, (7, 9))
    order = neighbours.walk(left, right, counts, 10**9)
    cost = [left[c // 9] + right[c % 9] for c in order]
    assert cost == sorted(cost) and sorted(order) == np.flatnonzero(counts.ravel()).tolist()
    part = neighbours.walk(left, right, counts, 12)
    assert part == order[:len(part)] and counts.ravel()[part].sum() >= 12 > counts.ravel()[part[:-1]].sum()


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_recall_scores_and_ranks(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    monkeypatch.setattr(neighbours, "QUERIES", 16)
    rng = np.random.default_rng(7)
    n, dim = 2400, 16
    x = rng.normal(0, 1, (n, dim))
    if kind == "clusters":
        x = 0.2 * x + rng.normal(0, 1, (40, dim))[rng.integers(0, 40, n)]
    x[1000:1700] = x[1000]  # a group of equal vectors larger than a block
    vectors = list(enumerate(x))
    want = brute(vectors, 50)
    got = {}
    for r in neighbours.nearest(frame(spark, vectors)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5] and q not in [v for _, v, _ in rows]
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
        for _, v, s in rows:
            a, b = np.float32(x[q]).astype(float), np.float32(x[v]).astype(float)
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert hits / (5 * len(want)) >= 0.9
    # equal vectors come by the smaller id
    assert [v for _, v, _ in got[1000]] == [1001, 1002, 1003, 1004, 1005]


def test_odd_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 2.0]), (50, [-1.0, 0.0])]
    odd = [(100, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, None], 1), (7, [1.0], 1), (None, [1.0, 0.0], 1),
           (1, [1.0, 1.0], 2), (8, [], 1)]
    got = neighbours.nearest(frame(spark, good, odd)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 2), (50, 2, 1), (50, 3, 0)]
    assert neighbours.nearest(frame(spark, [], [(100, None, 1)])).count() == 0
