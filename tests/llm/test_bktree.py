"""SimHash near duplicates with BK-trees against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from anchorset.llm import bktree
from anchorset.sources.stages import StageStore


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def plain_classes(prints, radius=4):
    """Smallest id reachable, by comparing everything with everything."""
    label = {i: i for i in prints}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def result(df, **options):
    return {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in bktree.near_classes(df, **options).collect()}


def test_whole_table(sample):
    docs, texts = sample
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    classes = plain_classes(prints)
    assert result(docs) == {i: (f"{prints[i]:016x}", classes[i]) for i in texts}


def near(rng, fp, bits):
    for j in rng.sample(range(64), bits):
        fp ^= 1 << j
    return fp


@pytest.mark.parametrize(("pack", "equal"), [(1 << 14, 2), (3, 2), (7, 1), (5, 3)])
def test_links_of_any_pack_size(spark, pack, equal):
    """Chains and balls of fingerprints; tiny packs spread a shard over many trees."""
    rng = random.Random(pack + equal)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for start in prints[:6]:
        at = start
        for _ in range(15):  # a chain: only neighbours are near
            at = near(rng, at, rng.choice((3, 4, 5)))
            prints.append(at)
        prints += [near(rng, start, rng.choice((1, 2, 6))) for _ in range(25)]
    prints = dict(enumerate(dict.fromkeys([0, 2**64 - 1, 1, *prints])))
    signed = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in prints.items()]
    nodes = spark.createDataFrame(signed, "id bigint, fp bigint")
    store = StageStore.for_session(spark)
    links = [(r["a"], r["b"]) for r in bktree.near_links(nodes, store, equal, pack=pack).collect()]
    label = {i: i for i in prints}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        label[max(x, y)] = min(x, y)
    assert {i: top(i) for i in prints} == plain_classes(prints)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 12))
def test_tree_search_is_exact(values, radius):
    # Neighbours of the drawn values, so that there is something to find.
    values = list(dict.fromkeys([*values, *(v ^ (1 << (v % 64)) for v in values)]))
    fps = np.array(values, np.uint64)
    order, edges = bktree.build_trees(fps, np.zeros(len(fps), np.int64))
    assert sorted(order.tolist()) == list(range(len(fps))) and (np.diff(edges) >= 0).all()
    query, place = bktree.search(fps[order], edges, fps, np.zeros(len(fps), np.int64), radius)
    found = set(zip(query.tolist(), order[place].tolist(), strict=True))
    wanted = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if (a ^ b).bit_count() <= radius}
    assert found == wanted and len(query) == len(found)


def test_search_follows_few_edges():
    """A node is only met if its distance to the parent allows it."""
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    met = []
    order, edges = bktree.build_trees(fps, np.zeros(len(fps), np.int64))
    count = np.bitwise_count
    try:
        np.bitwise_count = lambda x: met.append(len(x)) or count(x)
        bktree.search(fps[order], edges, fps[:50], np.zeros(50, np.int64), 4)
    finally:
        np.bitwise_count = count
    assert sum(met) < 0.7 * 50 * len(fps)


@pytest.mark.parametrize("equal", [1, 2, 3, 4])
def test_shards_hold_every_link(equal):
    rng = random.Random(3)
    masks = [m % (1 << 64) for m in bktree.shard_masks(equal)]
    for _ in range(300):
        a = rng.getrandbits(64)
        b = near(rng, a, rng.randint(0, 4))
        assert any(a & m == b & m for m in masks)


def test_long_texts_are_read_in_runs(monkeypatch):
    text = np.frombuffer(("Wört " * 50 + " a\tb\n c " * 40 + "x" * 300).encode(), np.uint8)
    whole = bktree.fingerprint(text)
    assert whole == plain_fingerprint(text.tobytes().decode())
    for run in (1, 3, 5, 64):
        monkeypatch.setattr(bktree, "RUN", run)
        assert bktree.fingerprint(text) == whole


def test_odd_rows(spark, docs_of, clashing):
    same = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \n\t "), (9, same), (9, same), (4, same.upper()), (None, same), (None, None),
            (7, "alone here"), (7, same), (8, "quite another text of several words")]
    found = bktree.near_classes(clashing(docs_of(rows))).collect()
    assert len(found) == len(rows)
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in found}
    zero, one = "0" * 16, f"{plain_fingerprint(same):016x}"
    assert [got[i, zero] for i in (1, 2, 3)] == [1, 1, 1]
    # Id 7 has two texts: both belong to the class that either links to.
    assert got[9, one] == got[4, one] == got[7, one] == got[7, f"{plain_fingerprint('alone here'):016x}"] == 4
    assert got[None, one] is None and got[None, zero] is None
    assert bktree.near_classes(docs_of([(None, "x")]).limit(0)).collect() == []
