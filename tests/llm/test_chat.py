"""Chat formatting: round trips, masks and digests."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from anchorset.llm import chat

PATH = P.path("byte_bpe_50k.json")
ROWS = "conv_id bigint, turn bigint, role string, text string"
PIECES = st.sampled_from([*chat.CONTROL, "\\", "<", "s>", "[/", "é", "漢", " ", "\n", "ok", "<<", "S", "/"])
TEXT = st.lists(PIECES, max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant"]), TEXT), TEXT), max_size=5)


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_format_is_reversible(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    said = [text for role, text in turns if role == "assistant"]
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == said
    assert all(mark not in chat.escape(text) for _, text in turns for mark in chat.CONTROL)


@settings(max_examples=150, deadline=None)
@given(TURNS)
def test_mask_covers_each_assistant_text_once(turns):
    formatted, spans = chat.render(turns)
    _, offsets = chat.encode(formatted, PATH)
    mask, pieces = chat.loss_spans(spans, offsets[:, 0], offsets[:, 1])
    covered = [i for _, a, b in pieces for i in range(a, b)]
    assert covered == [i for a, b in spans for i in range(a, b)]
    plain = [any(a < e and s < b for a, b in spans) for s, e in offsets]
    assert mask.tolist() == plain


def test_tokens_that_span_turns():
    spans = np.array([[2, 4], [6, 9], [9, 9]])
    starts, ends = np.array([0, 3, 8, 8]), np.array([3, 8, 12, 12])
    mask, pieces = chat.loss_spans(spans, starts, ends)
    assert mask.tolist() == [True, True, True, True]
    assert pieces.tolist() == [[0, 2, 3], [0, 3, 4], [1, 6, 8], [1, 8, 9]]


@settings(max_examples=150, deadline=None)
@given(st.lists(TURNS, min_size=1, max_size=5))
def test_blocks_give_the_tokens_of_the_whole(blocks):
    """Ids, mask and texts under the mask, however the turns are cut into blocks."""
    turns = [turn for block in blocks for turn in block]
    whole, spans = chat.render(turns)
    ids, offsets = chat.encode(whole, PATH)
    mask, _ = chat.loss_spans(spans, offsets[:, 0], offsets[:, 1])
    masked = chat.Masked(PATH)
    parts = [masked.add(block, i == len(blocks) - 1) for i, block in enumerate(blocks)]
    assert "".join(p[0] for p in parts) == whole
    assert np.concatenate([p[1] for p in parts]).tolist() == ids.tolist()
    assert np.concatenate([p[2] for p in parts]).tolist() == mask.tolist()
    assert [t for p in parts for t in p[3]] == [text for role, text in turns if role == "assistant"]


def test_a_token_may_span_two_turns():
    turns = [("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "d")]
    ids, _ = chat.encode(chat.render(turns)[0], PATH)
    alone = sum(len(chat.encode(chat.render([t])[0], PATH)[0]) for t in turns)
    assert len(ids) < alone
    masked = chat.Masked(PATH)
    parts = [masked.add([t], t is turns[-1]) for t in turns]
    assert [i for p in parts for i in p[1].tolist()] == ids.tolist()


def digests(rows):
    """What the contract asks for, without formatting anything."""
    held = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        held.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in held.items():
        said = "".join(t for r, t in turns if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


ODD = [
    (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", "a\\b </s>"), (1, None, "system", ""),
    (2, 5, None, "no role"), (2, 5, None, "no role"), (2, 5, "tool", "x"), (None, 0, "user", "lost"),
    (3, 0, "assistant", "é漢" * 40_000), (3, 1, "user", "[INST]" * 3), (3, 2, "assistant", "end"),
]


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_odd_rows(spark, clashing, block):
    df = clashing(spark.createDataFrame(ODD, ROWS))
    found = chat.format_digests(df, PATH, block_chars=block).collect()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found}
    assert got == digests(ODD)


def test_formatted_output(spark):
    df = spark.createDataFrame(ODD, ROWS)
    blocks = chat.format_conversations(df, PATH, block_chars=10).collect()
    whole = {r["conv_id"]: r for r in chat.format_conversations(df, PATH).collect()}
    for conv in (1, 2, 3):
        own = sorted((r["block"], r["formatted"]) for r in blocks if r["conv_id"] == conv)
        assert [b for b, _ in own] == list(range(len(own)))
        turns = chat.parse("".join(text for _, text in own))
        assert len(turns) == sum(r[0] == conv for r in ODD)
        held = sorted((r["block"], r["ids"], r["loss_mask"]) for r in blocks if r["conv_id"] == conv)
        for place, column in ((1, "ids"), (2, "loss_mask")):
            assert [x for row in held for x in row[place]] == list(whole[conv][column])
    assert all(len(r["ids"]) == len(r["loss_mask"]) for r in blocks)


def test_empty_table_and_one_more_conversation(spark):
    none = spark.createDataFrame([], ROWS)
    assert chat.format_digests(none, PATH).collect() == []
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    (row,) = chat.format_digests(chat.with_conversation(none, -1, turns), PATH).collect()
    assert row["conv_id"] == -1 and row["loss_chars"] == 21
    assert row["loss_sha256"] == hashlib.sha256(turns[1][1].encode()).hexdigest()
