"""The prefix trie against a plain tree of dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from anchorset.llm import prefixtrie as pt
from anchorset.llm import queries

ROWS = "conv_id bigint, turn bigint, role string, text string"


def conversations(rows):
    held = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            held.setdefault(conv, []).append((turn, role or "", text or ""))
    by = lambda r: (r[0] is not None, r[0], r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    return {c: [(r, t) for _, r, t in sorted(some, key=by)] for c, some in held.items()}


def rebuilt(held):
    out = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = held.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain(paths):
    """Every node by its members: rows as the operator gives them."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = {p: 0 for p in members}
    leaves, saved = dict(children), dict(children)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, some in members.items():
        worth = (len(some) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += worth
    rows = []
    for p, some in members.items():
        ends = ",".join(str(c) for c in sorted(some) if len(paths[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(some), len(p), parent, len(some), children[p], leaves[p], saved[p], digest))
    return sorted(rows, key=str)


def result(df):
    return sorted((tuple(r[c] for c in pt.COLUMNS) for r in df.collect()), key=str)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    got = queries.op11_double_array_trie(spark, "/root/testdata/sf0.01")
    assert result(got) == plain(rebuilt(conversations(rows)))


@pytest.mark.parametrize("shard_turns", [1, 3, 20, 1 << 18])
def test_shards_of_any_size(spark, clashing, shard_turns):
    """Tiny shards make most nodes upper ones; deep chains need several rounds."""
    rng, rows = random.Random(shard_turns), []
    for c in range(160):
        length = rng.choice((0, 1, 2, 3, 6, 40))
        same = rng.randint(0, length)
        for t in range(length):
            text = f"turn {t}" if t < same else rng.choice("abcé") * rng.randint(0, 3)
            rows.append((c * 7, t, rng.choice(("user", None)) if t >= same else "user", text or None))
    rows += [(-5, None, "x", "null turn"), (-5, 3, "x", "later"), (None, 0, "user", "nobody's"), (-5, 3, "x", "later")]
    df = clashing(spark.createDataFrame(rows, ROWS))
    assert result(pt.trie_nodes(pt.turns_of(df), shard_turns)) == plain(conversations(rows))


def test_copies_and_turnless(spark):
    """More equal conversations than one run of ids; empty ones end at the root."""
    rows = [(c, t, "user", f"t{t}") for c in range(1300) for t in range(2)]
    turns = pt.turns_of(spark.createDataFrame(rows, ROWS))
    empty = turns.selectExpr("conv_id + 5000 as conv_id", "slice(turns, 1, 0) as turns").filter("conv_id < 5003")
    paths = conversations(rows) | {c: [] for c in (5000, 5001, 5002)}
    assert result(pt.trie_nodes(turns.unionByName(empty))) == plain(paths)
    assert pt.trie_nodes(turns.limit(0)).collect() == []


def test_heads(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in (*range(4, 12), 20, 23) for t in range(c % 4 + (c == 10) * 9)]
    rows += [(31, 0, "user", "base is absent"), (31, 1, "user", "more")]
    df = spark.createDataFrame(rows, ROWS)
    from pyspark.sql import functions as F

    turns = pt.turns_of(df)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    got = pt.trie_nodes(pt.shared_heads(turns, head, F.col("conv_id") - F.col("conv_id") % 5, 8))
    assert result(got) == plain(rebuilt(conversations(rows)))


PATHS = st.integers(2, 60).flatmap(
    lambda most: st.lists(st.lists(st.integers(0, most), max_size=6).map(tuple), min_size=1, max_size=150, unique=True)
)


@settings(max_examples=200, deadline=None)
@given(PATHS)
def test_double_array_holds_exactly_its_paths(paths):
    digests = {v: hashlib.md5(str(v).encode()).digest() for v in range(61)}
    paths = sorted(b"".join(digests[v] for v in p) for p in paths)
    lengths = np.array([len(p) // 16 for p in paths], np.int64)
    starts = np.cumsum(lengths) - lengths
    depth = np.arange(lengths.sum()) - np.repeat(starts, lengths)
    codes = pt.dense_codes(np.array(bytearray(b"".join(paths)), np.uint8), depth)
    trie = pt.pack_trie(codes, starts, lengths)
    every = {tuple(codes[s : s + d].tolist()) for s, n in zip(starts, lengths, strict=True) for d in range(n + 1)}
    assert (trie.check >= 0).sum() == len(every)
    for prefix in every:
        state = np.zeros(1, np.int64)
        for code in prefix:
            state = trie.step(state, np.array([code]))
            assert state[0] > 0
        for code in range(1, 62):
            assert (trie.step(state, np.array([code]))[0] > 0) == ((*prefix, code) in every)
