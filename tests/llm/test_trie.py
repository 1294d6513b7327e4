"""Operator 13 against every prefix of every conversation."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from shelfspark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, len long, key string, pos long"


def truth(rows, group=None, most=9):
    """The contract, node by node."""
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(convs[c])] for c in convs}
    if group:
        h = {c: zlib.crc32(str(c).encode()) % most for c in turns}
        base = lambda c: c - (abs(c) % group) * (1 if c >= 0 else -1)
        turns = {c: turns.get(base(c), [])[: h[c]] + x[h[c] :] for c, x in turns.items()}
    members = defaultdict(list)
    for c, x in turns.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ended = sorted(c for c in m if len(turns[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*trie.NODE).collect()), key=str)


def odd_rows():
    rng = random.Random(2)
    rows = []
    for conv in [*range(-7, 40), 2**40, 2**40 + 1]:
        for turn in range(rng.choice([0, 1, 2, 5, 9, 14]) if conv != 3 else 40):
            rows.append((conv, turn if turn else None, rng.choice(["user", "assistant", None]) if rng.random() < 0.3 else "user", rng.choice(["a", "b", None, "", "é😀"]) if rng.random() < 0.2 else f"t{turn}", 1, "k", 2))
    rows += [(c, t, "user", f"same {t}", 1, "k", 2) for c in range(100, 130) for t in range(12)]  # copies
    rows += [(c, t, "user", f"same {t}" if t < 20 else f"{c}", 1, "k", 2) for c in range(130, 134) for t in range(25)]
    rows += [rows[5], rows[5], (None, 1, "user", "nobody", 1, "k", 2)]  # repeated rows, no id
    rows += [(7, 3, "user", "tie", 1, "k", 2), (7, 3, "assistant", "tie", 1, "k", 2)]
    return rows


@pytest.mark.parametrize("block", [4, 4096])
def test_nodes_equal_brute_force(spark, monkeypatch, block):
    """Small blocks meet all their edges; a conversation lies over several partitions."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "PIECE_BITS", 2)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(trie.rebuilt(df)) == truth(rows, 5)
    if block == 4:
        assert got(trie.plain(df)) == truth(rows)


def test_blocks_follow_each_other(spark):
    depths = [*range(1, 70), 4095, 4096, 8191, 8192, 20_000]
    for d, b in spark.createDataFrame([(d,) for d in depths], "d long").select("d", trie.block_of(trie.F.col("d"))).collect():
        low, high = trie.block_bounds(b)
        assert low <= d < high


def test_nothing_and_one(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(trie.rebuilt(none)) == []
    one = [(4, 0, "user", "x", 1, "k", 2)]
    assert got(trie.plain(spark.createDataFrame(one, SCHEMA))) == truth(one)
    assert got(trie.rebuilt(spark.createDataFrame(one, SCHEMA))) == truth(one, 5)
