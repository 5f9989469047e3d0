"""Repeated byte strings against brute force."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from anchorset.llm import repeats as R


def kept(texts, least):
    held = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if held[t[i : i + least]] > 1:
                gone[i : i + least] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])) == 1)
        out.append((len(t), int(gone.sum()), len(edges), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=40).map(str.encode), min_size=1, max_size=6), st.integers(1, 12))
def test_suffixes_and_bounded_prefixes(segments, least):
    held = Counter(s[i : i + least] for s in segments for i in range(len(s) - least + 1))
    plain = [[i for i in range(len(s) - least + 1) if held[s[i : i + least]] > 1] for s in segments]
    assert [x.tolist() for x in R.repeated_starts(segments, least)] == plain


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=30).map(str.encode), min_size=1, max_size=4))
def test_suffix_order_and_prefix_levels(segments):
    lengths = np.array([len(s) for s in segments])
    ends = np.cumsum(lengths + 1) - 1
    symbols = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[ends] = 0
    left = ends[np.searchsorted(ends, np.arange(len(symbols)))] - np.arange(len(symbols))
    order, rank = R.sorted_suffixes(symbols, left)
    # Ends compare by place, so every suffix is its symbols up to the end, then the place.
    plain = sorted(range(len(symbols)), key=lambda i: (symbols[i : i + left[i]].tolist() + [0], i))
    assert order.tolist() == plain and rank[order].tolist() == list(range(len(symbols)))
    common = [0]
    for a, b in zip(plain, plain[1:]):
        n = 0
        while n < min(left[a], left[b]) and symbols[a + n] == symbols[b + n]:
            n += 1
        common.append(n)
    for least in (1, 2, 5):
        assert R.bounded_prefixes(symbols, order, rank, least).tolist() == [c >= least for c in common]


@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 60))
def test_sliding_min(values, width):
    width = min(width, len(values))
    plain = [min(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert R.sliding_min(np.array(values, np.uint64), width).tolist() == plain


def corpus(seed, hot=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (6, 12, 30)]
    docs = [text(rng.randint(0, 60)) for _ in range(25)]
    docs += [f"{text(rng.randint(0, 9))} {rng.choice(shared)} {text(rng.randint(0, 9))}" for _ in range(30 + hot)]
    docs += [docs[3]] * 4 + [docs[30], "ab" * 120, "", text(3)]
    near = docs[26].split(" ")
    near[len(near) // 2] = "changed"
    return [*docs, " ".join(near)]


@pytest.mark.parametrize("hot_segments", [4096, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_tables(docs_of, seed, hot_segments):
    """The same with anchors that count as too common for one task."""
    texts = corpus(seed, hot=20)
    found = R.remove_repeats(docs_of(texts), least=40, anchor=16, hot_segments=hot_segments, bucket_bytes=3000).collect()
    want = kept([t.encode() for t in texts], 40)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found} == dict(enumerate(want, 1))
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in found)


def test_production_length(sample):
    docs, texts = sample
    ids = sorted(texts)
    want = kept([texts[i].encode() for i in ids], R.LEAST)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in R.remove_repeats(docs).collect()}
    assert [found[i] for i in ids] == want and any(w[1] for w in want)


def test_blocks_of_a_long_text(monkeypatch, docs_of):
    monkeypatch.setattr(R, "BLOCK_WINDOWS", 300)
    texts = corpus(7)
    long = " ".join(texts)
    found = R.remove_repeats(docs_of([long, *texts]), least=40, anchor=16).collect()
    want = kept([t.encode() for t in [long, *texts]], 40)
    assert {r["doc_id"]: bytes(r["kept"]) for r in found} == {i: w[3] for i, w in enumerate(want, 1)}


def test_odd_rows(docs_of, clashing):
    rows = [(1, None), (2, ""), (3, "x" * 399), (4, "y" * 400), (5, "z" * 401), (6, "w" * 300_000), (7, "q" * 200 + "r" * 200),
            (7, "q" * 200 + "r" * 200), (None, "n" * 399 + "m"), (None, None)]
    found = R.remove_repeats(clashing(docs_of(rows))).collect()
    assert sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in found) == [
        (0, 0, 0, 0), (0, 400, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 399, 0, 0), (4, 400, 0, 0), (5, 401, 401, 1),
        (6, 300_000, 300_000, 1), (7, 400, 400, 1), (7, 400, 400, 1)]


def test_repeated_rows_cost_little(docs_of):
    """Many equal rows, with and without an id, next to others that share a passage with them."""
    rng = random.Random(3)
    text = " ".join(str(rng.random()) for _ in range(420))
    others = [(2, "start " + text[1000:2500] + " end"), (3, " ".join(str(rng.random()) for _ in range(60))), (4, text[:300])]
    took = []
    for copies in (200, 200, 800):
        rows = [(None, text)] * copies + [(1, text)] * copies + others + [(8, "short")] * copies
        start = time.perf_counter()
        found = R.remove_repeats(docs_of(rows)).collect()
        took.append(time.perf_counter() - start)
        got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], len(r["kept"])) for r in found}
        n, third = len(text), len(others[1][1])
        clean = (3, third, 0, 0, third)
        assert len(found) == len(rows)
        assert got == {(None, n, n, 1, 0), (1, n, n, 1, 0), (2, 1510, 1500, 1, 10), clean, (4, 300, 0, 0, 300), (8, 5, 0, 0, 5)}
    assert took[2] < 2 * max(took[:2]) + 2


def test_empty_table(docs_of):
    assert R.remove_repeats(docs_of([])).collect() == []
