"""The parity-sketch join against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from anchorset.llm import linking, parity
from anchorset.llm.text import distinct, stream


def shingles(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in text.split(" ") if x]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def brute(docs, num=90, den=100):
    sets = {i: shingles(t or "") for i, t in docs}
    held = {}
    for i, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(i)
    both = Counter((a, b) for ids in held.values() for a in ids for b in ids if a < b)
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for (a, b), k in both.items():
        if den * k >= num * (len(sets[a]) + len(sets[b]) - k):
            a, b = top(a), top(b)
            label[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity.jaccard_classes(df).collect()}


def test_whole_table(sample):
    docs, texts = sample
    assert result(docs) == brute(texts.items())


def test_chains_and_sizes(docs_of):
    """Chains of small edits at many sizes: links between neighbours only."""
    rng, docs, at = random.Random(4), [], 0
    for size in (3, 4, 5, 9, 12, 22, 40, 90, 150, 400):
        words = [f"s{size}w{j}" for j in range(size)]
        for _ in range(8):
            docs.append((at, " ".join(words)))
            at += 1
            words = list(words)
            for _ in range(rng.choice((0, 1, 1, 2, size // 50))):
                words[rng.randrange(size)] = f"n{rng.random()}"
    rng.shuffle(docs)
    assert result(docs_of(docs)) == brute(docs)


def test_large_group_of_near_copies(docs_of):
    rng = random.Random(9)
    base = [f"b{j}" for j in range(120)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join(base)) for i in range(40)]
    assert result(docs_of(docs)) == brute(docs)


@pytest.mark.parametrize("n", [1, 2, 5, 9, 10, 19, 38, 100, 333, 1000, 4000])
def test_linked_sets_share_a_part(n):
    """The pigeonhole at the greatest allowed difference, in both directions."""
    rng = np.random.default_rng(n)
    for extra in range(6):
        values = stream(2 * n + 2, n + 77 * extra)
        for m in {n, int(n / 0.9)}:
            # |A| = n, |B| = m, differing as much as 0.9 allows.
            both = next(k for k in range(min(n, m), -1, -1) if 100 * (k - 1) < 90 * (n + m - k + 1)) if n > 1 else n
            a = np.unique(values[:n])
            b = np.unique(np.concatenate([values[:both], values[n : n + m - both]]))
            if 100 * both < 90 * (n + m - both) or len(a) != n or len(b) != m:
                continue
            order = rng.permutation(n)
            assert set(parity.sketch_keys(a[np.sort(order)])) & set(parity.sketch_keys(b))


@pytest.mark.parametrize("share", [(8, 10), (90, 100)])
@pytest.mark.parametrize("n", [1, 3, 4, 5, 9, 13, 30, 100, 500, 2000])
def test_unrelated_sets_share_no_key(n, share):
    """Empty parts are no keys, so unrelated sets of a size do not meet."""
    keys = [parity.sketch_keys(stream(n, 1000 + i), share) for i in range(300)]
    every = np.concatenate([np.unique(k) for k in keys])
    held = Counter(every.tolist())
    assert sum(k * (k - 1) // 2 for k in held.values()) <= 3
    assert len(every) <= 300 * max(2 * n, 1)


@pytest.mark.parametrize("n", [4, 5, 8, 10, 20, 40, 100, 333, 1000])
def test_sets_linked_at_four_fifths_share_a_part(n):
    rng = np.random.default_rng(n)
    for extra in range(40):
        values = stream(3 * n + 2, n + 77 * extra)
        m = int(rng.integers(-(-n * 8 // 10), n * 10 // 8 + 1))
        both = next(k for k in range(min(n, m) + 1) if 10 * k >= 8 * (n + m - k))
        a, b = np.unique(values[:n]), np.unique(np.concatenate([values[:both], values[n : n + m - both]]))
        assert set(parity.sketch_keys(a, (8, 10))) & set(parity.sketch_keys(b, (8, 10)))


def test_bands_cover_each_other():
    """A document is sketched for the band of every possible smaller partner."""
    edges = parity.band_edges(5000)
    for n in range(1, 5000):
        own = max(i for i, e in enumerate(edges) if e <= n)
        least = -(-n * 90 // 100)
        partner = max(i for i, e in enumerate(edges) if e <= least)
        assert own - partner <= 1
        if partner < own:
            assert (edges[own] - 1) * 100 >= n * 90
        parts, distance = parity.parts_of_band(edges[own], edges[own + 1] if own + 1 < len(edges) else edges[own] * 2)
        assert parts > distance >= parity.most_different(n)


def test_sketch_distance_is_a_lower_bound():
    values = stream(4000, 5)
    for size, apart in ((50, 3), (700, 60), (3000, 300)):
        a, b = values[:size], np.concatenate([values[apart:size], values[3900 : 3900 + apart // 3]])
        rows = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        bits = linking.parity_bits(*distinct(np.concatenate([a, b]), rows), 2).to_pylist()
        distance = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(*bits))
        assert 0 < distance <= apart + apart // 3


def test_large_sets(docs_of):
    """Sets larger than the short sketch, linked and unlinked, across its levels."""
    rng, docs, at = random.Random(12), [], 0
    for size in (900, 1000, 1100, 1300, 3900, 4200, 5000):
        words = [f"s{size}w{j}" for j in range(size)]
        for changes in (0, size // 70, size // 12, size // 4):
            edited = list(words)
            for _ in range(changes):
                edited[rng.randrange(size)] = f"n{rng.random()}"
            docs.append((at, " ".join(edited)))
            at += 1
        docs.append((at, " ".join(words[: int(size * 0.93)])))
        at += 1
    docs += [(at + i, " ".join(f"{i}v{j}" if j % 40 else f"p{j}" for j in range(4000))) for i in range(6)]
    assert result(docs_of(docs)) == brute(docs)


def test_odd_rows(docs_of, clashing):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "a b c"),
            (9, "A  b\tc"), (8, "a b c"), (10, "w " * 80_000), (11, "w " * 70_000)]
    found = parity.jaccard_classes(clashing(docs_of([*docs, (None, "a b c"), (None, None)]))).collect()
    assert len(found) == 14
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 8),
                   (10, 1, 10), (11, 1, 10), (None, 1, None), (None, 0, None)}


def test_an_id_with_several_texts_ties_them(docs_of):
    docs = [(1, "a b c d"), (5, "a b c d"), (5, "e f g h"), (9, "e f g h"), (7, "i j k")]
    found = {(r["doc_id"], r["component_id"]) for r in parity.jaccard_classes(docs_of(docs)).collect()}
    assert found == {(1, 1), (5, 1), (9, 1), (7, 7)}


def test_empty_table(docs_of):
    assert parity.jaccard_classes(docs_of([])).collect() == []


def test_components_of_a_long_chain(spark, tmp_path):
    from anchorset.sources.stages import StageStore

    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (105, 101)], "a int, b int")
    found = linking.components(edges, StageStore(spark, str(tmp_path))).collect()
    assert {r["id"]: r["component"] for r in found} == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 105: 100}
