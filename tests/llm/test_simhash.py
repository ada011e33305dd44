import numpy as np
import pytest
import xxhash

from wattspark.llm import simhash
from wattspark.llm.components import roots


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, distance=4):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def corpus():
    rng = np.random.default_rng(5)
    vocab = ["aa", "Bb", "ccé", "dd", "ee", "ff", "gg", "hh", "ii", "jj"]
    rows = []
    for i in range(60):
        words = list(rng.choice(vocab, size=rng.integers(1, 120)))
        rows.append((i * 3, " ".join(words)))
        for j in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, len(words)))] = "xx"
            rows.append((i * 3 + j + 1000, "\t".join(words)))
    rows += [(7001, None), (7002, ""), (7003, "  \n"), (None, rows[0][1]), (None, "quite alone here"), rows[1], rows[1]]
    return rows


def test_fingerprints_and_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(df).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    comps = brute_components([i for i, _ in rows], fps)
    want = sorted((str(i), f"{f:016x}", str(c)) for (i, _), f, c in zip(rows, fps, comps))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    # one row for every component; the two components without a doc_id count as one each
    assert kept.count() == len({(c, None if c is not None else t) for c, (_, t) in zip(comps, rows)})


def test_long_text_is_read_whole():
    words = [f"w{i % 977}" for i in range(150_000)]
    text = " ".join(words)
    hs = np.array([xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(len(words) - 3)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((hs >> np.uint64(b)) & np.uint64(1)).sum()) > len(hs))
    assert simhash.fingerprint(text.encode()) == want


@pytest.mark.parametrize("bits,task_variants", [(1, 10**9), (4, 3000), (9, 10**6)])
def test_links_at_every_distance(spark, bits, task_variants):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in list(fps):
        for d in range(1, 8):
            y = x
            for b in rng.choice(64, d, replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in fps], "fp long")
    links = simhash.near_links(df, 4, bits=bits, task_variants=task_variants)
    root = {r.node: r.root for r in roots(links).collect()}
    signed = [int(np.array([f], np.uint64).view(np.int64)[0]) for f in fps]
    got = [root.get(s, s) for s in signed]
    assert got == brute_components(signed, fps)


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_links(spark.range(1).toDF("fp"), 3)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in roots(links).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}
