"""Importance resampling against a plain computation, and its accuracy."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorset.llm import quality

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture
def labelled(spark, docs_of):
    """300 documents of common words; a third holds bad words."""
    rng = np.random.default_rng(1)
    common, bad = [f"w{i}" for i in range(40)], ["awful", "nasty", "$$$"]
    texts, labels = [], []
    for i in range(1, 301):
        words = list(rng.choice(common, 60))
        if i % 3 == 0:
            for j in rng.choice(60, 12, replace=False):
                words[j] = str(rng.choice(bad))
        texts.append(" ".join(words))
        if i <= 200:
            labels.append((i, int(i % 3 != 0), int(i % 6 == 0)))
    return docs_of(texts), spark.createDataFrame(labels, LABELS)


def test_unlabelled_documents_are_told_apart(labelled):
    docs, labels = labelled
    kept = {r["doc_id"]: r["keep"] for r in quality.resample(docs, labels).collect()}
    held_out = [i for i in kept if i > 200]
    assert np.mean([kept[i] == (i % 3 != 0) for i in held_out]) > 0.95


def test_weights_equal_a_plain_computation(labelled):
    docs, labels = labelled
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0}
    # Words, and one n-gram for all words that repeat the one before.
    grams = {}
    for r in docs.collect():
        tokens = r["text"].split()
        grams[r["doc_id"]] = tokens + ["again" for a, b in zip(tokens, tokens[1:]) if a == b]
    raw = Counter(g for own in grams.values() for g in own)
    target = Counter(g for i, own in grams.items() if i in good for g in own)
    share = sum(target.values()) / sum(raw.values())

    def evidence(g):
        t, e = target[g], raw[g] * share
        ratio = (t + quality.PRIOR) / (e + quality.PRIOR)
        clear = e - t >= quality.SIGMAS * np.sqrt(e + 1) and ratio <= quality.LEAST_RATIO
        return np.log(ratio) if clear else 0.0

    found = {r["doc_id"]: r["weight"] for r in quality.resample(docs, labels).collect()}
    plain = {i: sum(map(evidence, own)) / np.sqrt(len(own)) for i, own in grams.items()}
    assert all(abs(found[i] - plain[i]) < 1e-5 for i in plain) and min(plain.values()) < -1


def test_repeated_words_are_evidence(spark, docs_of):
    rng = np.random.default_rng(2)
    common = [f"w{i}" for i in range(60)]
    texts = [" ".join([str(rng.choice(common))] * 50 if i % 4 == 0 else rng.choice(common, 50)) for i in range(1, 201)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(1, 101)], LABELS)
    kept = {r["doc_id"]: r["keep"] for r in quality.resample(docs_of(texts), labels).collect()}
    assert np.mean([kept[i] == (i % 4 != 0) for i in range(101, 201)]) > 0.95


def test_k_is_kept_exactly(labelled):
    docs, labels = labelled
    found = quality.resample(docs, labels, k=77).collect()
    keys = sorted((r["gumbel_key"] for r in found), reverse=True)
    assert sum(r["keep"] for r in found) == 77
    assert min(r["gumbel_key"] for r in found if r["keep"]) == keys[76]
    assert {r["doc_id"] for r in quality.drawn_documents(docs, labels, k=77).collect()} == {
        r["doc_id"] for r in found if r["keep"]
    }


@pytest.mark.parametrize("k", [1, 2, 5, 50, 99, 100])
def test_kth_largest(spark, k):
    values = [float(v) for v in np.random.default_rng(k).integers(-20, 20, 60)] + [1e9, -1e9] + [3.25] * 38
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_odd_rows(spark, docs_of, clashing):
    docs = clashing(docs_of([(1, None), (2, ""), (3, "good words"), (3, "good words"), (None, "x " * 50_000), (4, "  ")]))
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, 0, None), (None, 1, 0), (2, None, None)], LABELS)
    found = quality.resample(docs, labels).collect()
    assert len(found) == 6
    assert all(r["weight"] == 0 for r in found if r["doc_id"] in (1, 2, 4))
    drawn = quality.drawn_documents(docs, labels)
    assert drawn.columns == docs.columns and drawn.dtypes == docs.dtypes


def test_empty_tables(spark, docs_of):
    none, no_labels = docs_of([]), spark.createDataFrame([], LABELS)
    assert quality.resample(none, no_labels).collect() == []
    assert quality.drawn_documents(none, no_labels).collect() == []
    # Without labels nothing can be told apart, and all is kept.
    assert all(r["keep"] for r in quality.resample(docs_of(["a b", "c"]), no_labels).collect())


def test_target_rows_bound_the_sample(labelled):
    docs, labels = labelled
    found = quality.resample(docs, labels, target_rows=40).agg(F.count_if("keep")).first()[0]
    assert 0 < found <= 300
