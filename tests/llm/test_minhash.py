"""MinHash fingerprints and near-duplicate classes against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from anchorset.llm import minhash


def shingles(text, width=5):
    w = text.split(" ") if text else []
    w = [x.lower() for x in " ".join(text.split()).split(" ") if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def neighbours(rows):
    """The contract's order and edited texts, in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in rows]
    following = texts[1:] + texts[:1]
    return [(i, t, t[: len(t) - len(t) // 3] + n[: len(t) // 3], n) for (i, _), t, n in zip(rows, texts, following)]


def check(df, rows):
    found = minhash.neighbour_fingerprints(df).collect()
    want = neighbours(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=key)
    assert got == sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want), key=key)
    return found


@pytest.mark.parametrize("partitions", ["1", "3", "64"])
def test_whole_table(spark, sample, partitions):
    docs, texts = sample
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {r["doc_id"]: r for r in check(docs, list(texts.items()))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    apart = []
    for i, text, changed, following in neighbours(texts.items()):
        apart.append(found[i]["near_edited"] - jaccard(shingles(text), shingles(changed)))
        apart.append(found[i]["near_next"] - jaccard(shingles(text), shingles(following)))
    # 128 independent places: a standard deviation of at most 0.045.
    assert np.std(apart) < 0.05 and np.max(np.abs(apart)) < 0.25


def test_fingerprint_columns(sample):
    docs, texts = sample
    plain = {r["doc_id"]: r["fingerprint"] for r in minhash.document_fingerprints(docs).collect()}
    rows = minhash.neighbour_fingerprints(docs).collect()
    for r in rows:
        a, b = r["fingerprint"], r["edited_fingerprint"]
        assert a == plain[r["doc_id"]] and len(a) == 4 * minhash.PERMUTATIONS
        alike = np.mean([a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)])
        assert alike == r["near_edited"]
    of_text = {}
    for i, fingerprint in plain.items():
        assert of_text.setdefault(texts[i], fingerprint) == fingerprint


def test_likeness_estimates_jaccard():
    values = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.1, 0.5, 0.8):
        both = int(2000 * share)
        a, b = values[:2000], np.concatenate([values[:both], values[2000 : 4000 - both][: 2000 - both]])
        rows = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        s = minhash.signatures(np.concatenate([a, b]), rows, 2)
        exact = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs(minhash.likeness(s[:1], s[1:])[0] - exact) < 0.15


@pytest.mark.parametrize("rows", [
    [(5, "only one text here")],
    [(1, None), (2, ""), (3, " "), (4, "ab"), (None, "last of all"), (None, None), (4, "ab"), (4, "aa")],
    [(7, "x" * 200_000), (7, "x" * 200_000), (-3, "é" * 7), (2**40, "漢字" * 50)],
    [(1, "same"), (2, "same"), (3, "same")],
])
def test_odd_rows(docs_of, clashing, rows):
    found = check(clashing(docs_of(rows)), rows)
    assert all(0 <= r[c] <= 1 for r in found for c in ("near_edited", "near_next"))


def test_text_ids(spark):
    """Ids of any type that has an order."""
    rows = [(None if i % 17 == 0 else f"id{i * 7919 % 100:02}é", f"text number {i} of many") for i in range(60)]
    found = minhash.neighbour_fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    order = sorted(rows, key=lambda r: r[1])
    order = sorted((r for r in order if r[0]), key=lambda r: r[0], reverse=True) + [r for r in order if r[0] is None]
    want = {}
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        edited = minhash.edited(text, following)
        want.setdefault(i, []).append((len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty_table(docs_of):
    assert minhash.neighbour_fingerprints(docs_of([])).collect() == []
    assert minhash.near_duplicate_classes(docs_of([])).collect() == []


def test_near_duplicate_classes(docs_of, clashing):
    rng, docs = random.Random(8), []
    for group in range(25):
        words = [f"g{group}w{j}" for j in range(rng.randint(3, 120))]
        for copy in range(rng.randint(1, 5)):
            docs.append((100 * group + copy, " ".join(words)))
            words = list(words)
            if copy % 2 and len(words) > 20:
                words[rng.randrange(len(words))] = f"n{rng.random()}"
    docs += [(9000, None), (9001, ""), (9001, "")]
    sets = {i: shingles(t or "") for i, t in docs}
    held = {}
    for i, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(i)
    both = Counter((a, b) for ids in held.values() for a in ids for b in ids if a < b)
    label = {i: i for i in sets}
    for _ in range(9):
        for a, b in both:
            if jaccard(sets[a], sets[b]) >= 0.8:
                label[a] = label[b] = min(label[a], label[b])
    found = minhash.near_duplicate_classes(clashing(docs_of(docs))).collect()
    assert len(found) == len(docs) and {r["doc_id"]: r["class_id"] for r in found} == label


def test_signature_of_texts_without_words():
    values, row = minhash.shingle_hashes(pa.array(["", None, " \n"], pa.string()))
    assert (minhash.signatures(values, row, 3) == 0xFFFFFFFF).all()
