"""The prefix trie against a plain version that holds whole sequences."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tilth.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Nodes by whole sequences of (role, text)."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(t)] for c, t in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - int(c - 100 * int(c / 100)), [])[:h] + mine[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[p] for p in children[path]) or 1
        saved[path] = sum(saved[p] for p in children[path]) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def got(spark, rows):
    return sorted(tuple(r) for r in prefix_trie.build(spark.createDataFrame(rows, SCHEMA)).collect())


def key(x):
    return (x[0], x[1], x[2:])


@pytest.mark.parametrize("seed", range(3))
def test_against_sequences(spark, seed):
    rng = random.Random(seed)
    texts = ["", "a", "bb", "é😀", "x" * 50]
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 206, 399, -3, 10_000, 10_001, 30_005]:
        n = rng.choice([1, 1, 2, 3, 6, 9])
        for t in range(n):
            rows.append((c, None if t == 0 and rng.random() < 0.3 else t, rng.choice(["user", "assistant", None]), rng.choice(texts) if rng.random() < 0.6 else f"{c}-{t}"))
    rng.shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_long_conversation_in_many_parts(spark):
    rows = [(100, t, "user", str(t % 7)) for t in range(3000)] + [(c, t, "user", str(t % 7)) for c in (101, 102, 103, 104) for t in range(900 if c % 2 else 3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert prefix_trie.ordered(prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA))).where("conv_id = 100").select("part").distinct().count() > 1
        assert got(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_group_of_copies_and_many_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", 50)
    rows = [(c, t, "user", f"turn {t}") for c in range(700) for t in range(4)] + [(c, 0, "user", f"only {c % 3}") for c in range(900, 1000)]
    assert got(spark, rows) == plain(rows)


def test_odd_input(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 0, "user", "x")]) == []
    rows = [(5, 0, "user", "x")] * 3 + [(7, 0, None, None), (7, 0, None, None), (None, 1, "user", "y")]
    assert got(spark, rows) == plain(rows)
    assert prefix_trie.own_share is not None and got(spark, [(105, 0, "u", "z")]) == plain([(105, 0, "u", "z")])
    frame = spark.createDataFrame([(1, 0, "user", "x", "n", "m")], SCHEMA + ", key string, a string")
    assert sorted(tuple(r) for r in prefix_trie.build(frame).collect()) == plain([(1, 0, "user", "x")])


def test_long_text(spark):
    rows = [(1, 0, "user", "ab" * 2_000_000), (1, 1, "user", "c"), (2, 0, "user", "ab" * 2_000_000)]
    assert got(spark, rows) == plain(rows)


def test_node_table_verifies_digests():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 5000)
    table = prefix_trie.NodeTable(a, b)
    slots = table.slots(a, b)
    assert sorted(slots) == list(range(5000)) and (table.slots(a, b + 1) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.NodeTable(np.array([1, 1]), np.array([2, 2]))
