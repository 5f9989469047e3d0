"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from anchorset.llm import repair

ROWS = "conv_id bigint, turn bigint, role string, text string"
CODES = st.lists(st.sampled_from([c | f for c in range(4) for f in (0, 0, 4, 8)]), max_size=9)


def cheapest(codes):
    """Least (cost, edits) by always extending the least one found so far."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, row, state = heapq.heappop(heap)
        if row == len(codes) and state in ("", "a"):
            return cost, audit
        if (row, state) in done:
            continue
        done.add((row, state))
        for r in "ua":
            if (state, r) in follow:
                heapq.heappush(heap, (cost + 5, audit + "I", row, follow[state, r]))
        if row == len(codes):
            continue
        heapq.heappush(heap, (cost + 2, audit + "D", row + 1, state))
        if codes[row] & 4:
            continue
        extra = 5 if codes[row] & 8 else 0
        own = "sua-"[codes[row] & 3]
        if (state, own) in follow:
            heapq.heappush(heap, (cost + extra, audit + "K", row + 1, follow[state, own]))
        for r in "ua":
            if (state, r) in follow:
                heapq.heappush(heap, (cost + extra + 1, audit + "R", row + 1, follow[state, r]))
    raise AssertionError


def solved(runs, block=1 << 16):
    cost, audits = repair.solve([np.array(r, np.int64) for r in runs], block)
    return list(zip(cost.tolist(), audits, strict=True))


@settings(max_examples=300, deadline=None)
@given(st.lists(CODES, min_size=1, max_size=6), st.sampled_from([1, 2, 3, 1 << 16]))
def test_least_edits(runs, block):
    assert solved(runs, block) == [cheapest(r) for r in runs]


def test_long_conversation_in_blocks():
    rng = random.Random(5)
    run = [rng.choice([0, 1, 1, 2, 2, 3]) | rng.choice([0, 0, 0, 4, 8]) for _ in range(3000)]
    whole = cheapest(run)
    assert solved([run]) == solved([run], 64) == solved([run], 999) == [whole]


def plain(rows):
    """The contract, row by row, for rows (conv_id, turn, role, text)."""
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        held[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {conv: plain_conversation(some) for conv, some in held.items()}


def plain_conversation(some):
    some = sorted(some, key=lambda r: (r[0] is not None, r[0], r[1], hashlib.md5(r[2].encode()).digest()))
    turns = [t for t, _, _ in some if t is not None]
    codes, seen, count = [], set(), {"b": 0, "d": 0, "t": 0}
    for _, role, text in some:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        code = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
        if not said:
            count["b"] += 1
            code |= 4
        elif (role, text) in seen:
            count["d"] += 1
            code |= 4
        elif said[-1] not in ".!?":
            count["t"] += 1
            code |= 8
        seen.add((role, text))
        codes.append(code)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:], strict=False))
    cost, audit = cheapest(codes)
    lines, state, at = [], "", 0
    for edit in audit:
        due = "assistant" if state == "u" else "user"
        role, text = some[at][1:] if edit != "I" else (due, "")
        at += edit != "I"
        if edit != "D":
            lines.append((role if edit == "K" else due) + ":" + text)
            state = lines[-1][0]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, count["b"], count["d"], count["t"], illegal, cost, audit, digest


def result(df, **options):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = repair.repaired(repair.damaged(df), **options).collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    assert result(df) == plain(rows)


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_odd_rows(spark, clashing, block):
    rng = random.Random(2)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "agent"]
    texts = ["Yes.", "No", "", None, " \n\t", "What? ", "a.b", "é!\n", "long text. " * 50]
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, 0, 1, 2, 5, 9, -3]), rng.choice(roles), rng.choice(texts)) for _ in range(150)]
    rows += [(5, t, "user", "same.") for t in range(40)] + [(6, 1, "user", "again.")] * 30
    # Conversations whose only row is dropped.
    rows += [(c, 0, "user", "hi.") for c in range(100, 140) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert result(clashing(spark.createDataFrame(rows, ROWS)), block=block) == plain(rows)


def test_empty_table_and_rows_that_only_name(spark):
    assert result(spark.createDataFrame([], ROWS)) == {}
    (row,) = repair.repaired(spark.createDataFrame([(8, 3, None, None)], ROWS)).collect()
    assert (row["conv_id"], row["audit"], row["cost"], row["gaps"]) == (8, "", 0, 0)
    assert row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
