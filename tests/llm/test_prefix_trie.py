import hashlib
import heapq
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattspark.llm import prefix_trie


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    convs = {c: [t[3] for t in sorted(v)] for c, v in convs.items()}
    nodes = {}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(built[c]) + 1):
            nodes.setdefault(built[c][:d], []).append(c)
    children, out = {}, []
    for seq in nodes:
        if seq:
            children.setdefault(seq[:-1], []).append(seq)
    leaves, saved = {}, {}
    for seq in sorted(nodes, key=len, reverse=True):
        below = children.get(seq, [])
        leaves[seq] = sum(leaves[b] for b in below) or 1
        saved[seq] = sum(saved[b] for b in below) + (len(nodes[seq]) - 1) * (len(seq[-1][1].encode()) if seq else 0)
        ends = ",".join(str(c) for c in sorted(nodes[seq]) if len(built[c]) == len(seq))
        out.append((min(nodes[seq]), len(seq), min(nodes[seq[:-1]]) if seq else None, len(nodes[seq]), len(below), leaves[seq], saved[seq],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, n=150, longest=9):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(4 * n, n, replace=False).tolist():
        # few texts, so that conversations share prefixes also beyond what they borrow
        rows += [(c, t, ["user", "assistant"][t % 2], f"tëxt {int(rng.integers(0, 3))}") for t in range(int(rng.integers(1, longest)))]
    return rows


EDGES = [(None, 1, "user", "x"), (7, None, "user", "first"), (7, None, None, None), (7, None, None, ""), (7, 2, "user", "a"), (7, 2, "user", "b"),
         (7, 2, "user", "b"), (-3, 1, "user", "negative"), (-5, 1, "user", "base of a negative"), (10 ** 12 + 2, 5, "system", "ü" * 50_000)]


@pytest.mark.parametrize("least,held,piece,ends", [(1_000, 1 << 18, 4_096, 65_536), (3, 4, 2, 50), (40, 2, 5, 7)])
def test_trie_is_brute_force(spark, monkeypatch, least, held, piece, ends):
    for name, v in (("LEAST_TOP", least), ("HELD", held), ("PIECE", piece), ("ENDS", ends)):
        monkeypatch.setattr(prefix_trie, name, v)
    rows = corpus(least) + EDGES
    rows += [(2_000_000, t, "user", f"turn {t % 50}") for t in range(700)]  # a third of all turns in one conversation
    rows += [(2_000_001 + i, t, "user", f"turn {t % 50}") for i in range(3) for t in range(120)]
    rows += [(3_000_000 + i, 0, "user", "the same") for i in range(400)]  # a group of copies
    want = brute(rows)
    assert max(r[4] for r in want) > 5 and want
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, x1 string").repartition(3)
    assert result(prefix_trie.trie(df)) == want


def test_repeated_rows_are_turns_of_their_own(spark):
    rows = [(5, 1, "user", "again")] * 300 + [(6, 1, "user", "again")] * 40
    assert result(prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute(rows)


def test_empty_single_and_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert result(prefix_trie.trie(spark.createDataFrame([], schema))) == []
    for c in (5, 6, 7, 8, 9):  # some have fewer turns than they give up: turnless, they end at the root
        rows = [(c, 1, "user", "only")]
        assert result(prefix_trie.trie(spark.createDataFrame(rows, schema))) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.tuples(st.integers(-6, 6), st.integers(-3, 3)), st.integers(-6, 6)), max_size=60), st.integers(2, 9))
def test_queue_is_a_heap(steps, held):
    queue, heap = prefix_trie.SpillingQueue(held), []
    for step in steps:
        if isinstance(step, tuple):
            queue.push(step)
            heapq.heappush(heap, step)
        else:
            got = list(queue.take((step,)))
            want = []
            while heap and heap[0][0] <= step:
                item = heapq.heappop(heap)
                want += [item] if item[0] == step else []
            assert got == want


def test_equal_messages_of_different_runs():
    queue = prefix_trie.SpillingQueue(2)
    got = 0
    for level in range(6):
        for _ in range(40):
            queue.push((level, 7, 1, 0))
        queue.push((level + 1, 7, 1, 0))
        got += len(list(queue.take((level, 7))))
    assert got == 6 * 40 + 5
