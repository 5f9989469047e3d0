"""Byte-level BPE against tiktoken."""

import hashlib

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from anchorset.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
MINE = bpe.Tokenizer(bpe.read_ranks(PATH), P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=MINE.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abcethinsor' \n1é", max_size=120)))
def test_ids_equal_tiktoken(text):
    ids = MINE.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert MINE.decode(ids) == text.encode()


def test_a_long_piece_is_linear():
    text = "a" * 200_000 + "aaaabaaab" * 5_000
    assert MINE.encode(text) == THEIRS.encode_ordinary(text)


def test_steps_back():
    # Longest first gives "abc" here, which the merges never reach from "abcd".
    ranks = {bytes([b]): b for b in range(256)} | {b"cd": 256, b"ab": 257, b"abc": 258}
    tokenizer = bpe.Tokenizer(ranks, r"\w+")
    plain = tiktoken.Encoding("t", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcd", "abcabcd", "abc", "abcc", "dabcdab"):
        assert tokenizer.encode(text) == plain.encode_ordinary(text)


def test_whole_table(sample):
    docs, texts = sample
    for r in bpe.token_digests(docs, PATH, P.PATTERN).collect():
        ids = THEIRS.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(docs_of, clashing):
    docs = clashing(docs_of([(1, None), (2, ""), (2, ""), (None, "hi"), (3, "<|endoftext|>" + "é" * 100_000)]))
    encoded = bpe.encode(docs, PATH, P.PATTERN)
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in encoded.collect())[:4] == [(0, 1), (1, 0), (2, 0), (2, 0)]
    data = {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(encoded, PATH, P.PATTERN).collect()}
    assert data[None] == b"hi" and data[1] == b"" and data[3].startswith(b"<|endoftext|>")
    assert bpe.token_digests(docs, PATH, P.PATTERN).count() == 5


def test_empty_table(docs_of):
    assert bpe.token_digests(docs_of([]), PATH, P.PATTERN).collect() == []


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 800)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 3)
    tokenizer = bpe.Tokenizer(MINE.ranks, P.PATTERN)
    text = " ".join(f"word{i}x" for i in range(50)) + " " + "y" * 500
    assert tokenizer.encode(text) == THEIRS.encode_ordinary(text)
    assert 0 < len(tokenizer.pieces) <= 4 and len(tokenizer.pairs) <= 3
    assert "y" * 500 not in tokenizer.pieces  # long pieces are not kept
    tokenizer.forget()
    assert not tokenizer.pieces and not tokenizer.pieces.older and not tokenizer.pairs
    assert tokenizer.encode(text) == THEIRS.encode_ordinary(text)


def test_tasks_leave_no_pieces_behind(docs_of):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})
    held = []

    def work(part, tok):
        yield bpe._digests(part, tok)
        held.append(len(tok.pieces))

    assert len(list(bpe._forgetting(PATH, P.PATTERN, work)(iter([batch])))) == 1
    assert held == [2] and not bpe.tokenizer(PATH, P.PATTERN).pieces


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 49_999), st.integers(0, 49_999))
def test_neighbours_stand_as_their_merges_say(left, right):
    tokens = sorted(MINE.token)
    left, right = tokens[left % len(tokens)], tokens[right % len(tokens)]
    data = MINE.token[left] + MINE.token[right]
    plain = tiktoken.Encoding("pair", pat_str=r"(?s:.+)", mergeable_ranks=MINE.ranks, special_tokens={})
    assert MINE.stands(left, right) == (plain._encode_bytes(data) == [left, right])


def test_ranks_without_a_byte():
    with pytest.raises(ValueError):
        bpe.Tokenizer({b"a": 0, b"b": 1}, r"\w+")
