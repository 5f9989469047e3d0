"""Batch helpers against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from anchorset.llm import text as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB \n\té\x0b", max_size=30)), max_size=8)
SPACES = " \t\n\x0b\x0c\r"


def split(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_shingles(texts):
    data, offsets = T.utf8(pa.array(texts, pa.string()))
    hashes, row = T.words(data, offsets)
    plain = [(i, fold(w)) for i, t in enumerate(texts) for w in split(t or "")]
    assert row.tolist() == [i for i, _ in plain]
    # Hashes are equal exactly where words are.
    assert len(set(zip(hashes.tolist(), (w for _, w in plain)))) == len(set(hashes.tolist())) == len({w for _, w in plain})
    values, rows = T.shingles(hashes, row, len(texts), 3)
    grams = []
    for i, t in enumerate(texts):
        w = [fold(x) for x in split(t or "")]
        own = [tuple(w[j : j + 3]) for j in range(len(w) - 2)] or ([tuple(w)] if w else [])
        grams += [(i, g) for g in own]
    assert rows.tolist() == [i for i, _ in grams]
    assert len(set(zip(values.tolist(), (g for _, g in grams)))) == len(set(values.tolist())) == len({g for _, g in grams})


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_lines(texts):
    data, offsets = T.utf8(pa.array(texts, pa.string()))
    starts, ends, row = T.lines(data, offsets)
    found = [(r, bytes(data[a:b]).decode()) for a, b, r in zip(starts, ends, row)]
    assert found == [(i, line) for i, t in enumerate(texts) for line in (t or "").split("\n")]


def test_slices_hold_whole_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 30, None, "b" * 5, "c" * 5, "d" * 50])], ["text"])
    parts = [p.column(0).to_pylist() for p in T.slices(batch, "text", 12)]
    assert parts == [["a" * 30], [None, "b" * 5, "c" * 5], ["d" * 50]]
    assert list(T.slices(batch.slice(0, 0), "text")) == []


def test_equal_spans_hash_alike_anywhere():
    data = np.frombuffer(b"xabcyyabczabd", np.uint8)
    h = T.span_hashes(data, np.array([1, 6, 10]), np.array([4, 9, 13]))
    assert h[0] == h[1] != h[2]


def test_columns_are_found_by_exact_name(spark):
    df = spark.createDataFrame([(1, "x", "y")], "doc_id int, text string, `a.b` string")
    assert T.clash_free(df, "text", "a.b").columns == ["text", "a.b"]
    twin = df.toDF("doc_id", "text", "TEXT")
    assert T.clash_free(twin, "TEXT").first()[0] == "y" and T.clash_free(twin, "text").first()[0] == "x"
    assert T.clash_free(df, "DOC_ID").first()[0] == 1 and T.kind_of(twin, "doc_id") == "int"
    with pytest.raises(ValueError):
        T.clash_free(df, "missing")
