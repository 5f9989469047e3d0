"""Chat formatting with a loss mask aligned to token offsets.

A conversation is rendered as one text: every turn stands between an opening and
a closing control string of its role. Control strings inside texts and role
names are escaped reversibly: backslashes are doubled, then a backslash is put
behind the first character of every control string. The rendered text is encoded
once with character offsets; the loss mask is the overlap of the assistant turns'
text spans with the token spans, both sorted, found by binary search.

Turns are ordered by turn number (nulls first), then role and text, so equal
numbers have a fixed order. Null text counts as empty, null role as the empty
role name. Rows with null conversation id form one conversation. Repeated rows
are repeated turns.

Conversations are streamed through tasks that hold them sorted. One of more than
``BLOCK_CHARS`` characters is rendered in blocks of whole turns and encoded as it
goes on. A token can span two turns, but never two pieces of the tokenizer's
pre-tokenizer, and text that follows changes at most the last pieces; these wait
for the next block. So ids and mask are those of the whole conversation. Memory is
bounded by a block or by the longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .text import clash_free, kind_of

BLOCK_CHARS = 1 << 20

# The control strings of the template.
MARKS = {
    "system": ("<<SYS>>", "<</SYS>>"),
    "user": ("[INST]", "[/INST]"),
    "assistant": ("<s>", "</s>"),
}
OTHER = ("<<ROLE>>", "<</ROLE>>")
NAME_END = "<<SAYS>>"
CONTROL = [mark for pair in (*MARKS.values(), OTHER) for mark in pair] + [NAME_END]

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(
    "|".join(f"{re.escape(a)}(.*?){re.escape(b)}" for a, b in (*MARKS.values(), OTHER)), re.DOTALL
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text and the (start, end) spans of assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        before, after = MARKS.get(role, OTHER)
        head = before if role in MARKS else f"{before}{escape(role)}{NAME_END}"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, after)
        at += len(head) + len(body) + len(after)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for found in _TURN.finditer(formatted):
        body = found[found.lastindex]
        if found.lastindex <= len(MARKS):
            turns.append((list(MARKS)[found.lastindex - 1], unescape(body)))
        else:
            name, _, body = body.partition(NAME_END)
            turns.append((unescape(name), unescape(body)))
    return turns


def loss_spans(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted turn spans and token spans: a mask of the tokens that overlap
    a turn span, and the overlaps as disjoint (turn, start, end) rows. Tokens
    that share a character (parts of its bytes) cover it once."""
    if len(spans) == 0 or len(starts) == 0:
        return np.zeros(len(starts), bool), np.zeros((0, 3), np.int64)
    first = np.searchsorted(spans[:, 1], starts, "right")  # first turn that ends behind the token's start
    last = np.searchsorted(spans[:, 0], ends, "left")  # turns from here on start at its end or later
    number = np.maximum(last - first, 0)
    token = np.repeat(np.arange(len(starts)), number)
    turn = first[token] + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    begin, end = np.maximum(starts[token], spans[turn, 0]), np.minimum(ends[token], spans[turn, 1])
    if len(turn):
        # What earlier tokens have covered is not covered again.
        reached = np.maximum.accumulate(end)
        begin[1:] = np.maximum(begin[1:], np.minimum(reached[:-1], end[1:]))
    inside = begin < end
    mask = np.zeros(len(starts), bool)
    mask[token] = True
    return mask, np.stack([turn, begin, end], axis=1)[inside]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def encode(formatted: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and their character offsets (n x 2)."""
    found = _tokenizer(path).encode(formatted, add_special_tokens=False)
    return np.array(found.ids, np.int32), np.array(found.offsets, np.int64).reshape(-1, 2)


class Encoder:
    """Ids and character offsets of a text that arrives in parts."""

    def __init__(self, path: str):
        self.path, self.text, self.start = path, "", 0

    def _settled(self) -> int:
        """Characters in front that further text cannot change: all but the last
        two pieces. The split looks one character beyond a piece."""
        tokenizer = _tokenizer(self.path)
        if tokenizer.normalizer is not None or tokenizer.pre_tokenizer is None:
            return 0
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(self.text)
        return pieces[-2][1][0] if len(pieces) > 2 else 0

    def add(self, more: str, last: bool) -> tuple[str, int, np.ndarray, np.ndarray]:
        """The text that is settled now, its place, its ids and their offsets."""
        self.text += more
        cut = len(self.text) if last else self._settled()
        done, start = self.text[:cut], self.start
        ids, offsets = encode(done, self.path)
        self.text, self.start = self.text[cut:], start + cut
        return done, start, ids, offsets + start


class Masked:
    """One conversation, block by block: its formatted text, tokens and mask, and
    the texts under the mask."""

    def __init__(self, path: str):
        self.encoder, self.chars = Encoder(path), 0
        self.spans, self.open = np.zeros((0, 2), np.int64), []

    def add(self, turns: list[tuple[str, str]], last: bool) -> tuple[str, np.ndarray, np.ndarray, list[str]]:
        formatted, spans = render(turns)
        self.spans = np.concatenate([self.spans, spans + self.chars])
        self.chars += len(formatted)
        done, start, ids, offsets = self.encoder.add(formatted, last)
        mask, pieces = loss_spans(self.spans, offsets[:, 0], offsets[:, 1])
        # An escape may lie across two tokens: put a turn's pieces together first.
        said = [self.open, *([] for _ in self.spans[1:])] if len(self.spans) else []
        for turn, a, b in pieces.tolist():
            said[turn].append(done[a - start : b - start])
        ended = int(np.searchsorted(self.spans[:, 1], start + len(done), "right"))
        self.open = said[ended] if ended < len(said) else []
        self.spans = self.spans[ended:]
        return formatted, ids, mask, [unescape("".join(parts)) for parts in said[:ended]]


@dataclass
class _Digest:
    """What is read back from the blocks of one conversation."""

    conv_id: object
    masked: Masked
    n_turns: int = 0
    turns: object = field(default_factory=hashlib.sha256)
    loss_chars: int = 0
    loss: object = field(default_factory=hashlib.sha256)
    formatted_chars: int = 0
    n_tokens: int = 0
    loss_tokens: int = 0

    def add(self, turns: list[tuple[str, str]], last: bool) -> None:
        formatted, _, mask, said = self.masked.add(turns, last)
        for role, text in parse(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for text in said:
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.formatted_chars += len(formatted)
        self.n_tokens += len(mask)
        self.loss_tokens += int(mask.sum())

    def row(self) -> tuple:
        return (
            self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
            self.formatted_chars, self.n_tokens, self.loss_tokens,
        )


DIGEST = (
    "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
    " formatted_chars bigint, n_tokens bigint, loss_tokens bigint"
)


def _blocks(batches: Iterator[pa.RecordBatch], block_chars: int):
    """(conversation, turns, whether it ends here) from sorted rows."""
    current, turns, chars, begun = None, [], 0, False
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text = text or ""
            if begun and conv_id != current:
                yield current, turns, True
                turns, chars = [], 0
            elif turns and chars + len(text) > block_chars:
                yield current, turns, False
                turns, chars = [], 0
            current, begun = conv_id, True
            turns.append((role or "", text))
            chars += len(text)
    if begun:
        yield current, turns, True


def _sorted_turns(rows: DataFrame, id_col: str) -> DataFrame:
    rows = clash_free(rows, id_col, "turn", "role", "text")
    dealt = rows.repartition(id_col).sortWithinPartitions(id_col, "turn", "role", "text")
    return dealt.select(id_col, "role", "text")


def format_conversations(
    rows: DataFrame, path: str, id_col: str = "conv_id", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(id, block, formatted, ids, loss mask): the formatted text of every
    conversation with its tokens; block is 0 unless a conversation is longer
    than ``block_chars``. The tokens of a block's last pieces come with the next
    block, so that all ids in order are those of the whole text. ``path`` is a
    tokenizer file on every worker."""
    kind = kind_of(rows, id_col)

    def run(batches: Iterator[pa.RecordBatch]):
        block, masked = 0, Masked(path)
        for conv_id, turns, ends in _blocks(batches, block_chars):
            formatted, ids, mask, _ = masked.add(turns, ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv_id], id_type), pa.array([block], pa.int32()), pa.array([formatted]), pa.array([ids]), pa.array([mask])],
                [id_col, "block", "formatted", "ids", "loss_mask"],
            )
            block, masked = (0, Masked(path)) if ends else (block + 1, masked)

    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    schema = f"`{id_col}` {kind}, block int, formatted string, ids array<int>, loss_mask array<boolean>"
    return _sorted_turns(rows, id_col).mapInArrow(run, schema)


def format_digests(
    rows: DataFrame, path: str, id_col: str = "conv_id", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per conversation with what its formatted text and loss mask give
    when they are read back."""
    kind = kind_of(rows, id_col)

    def run(batches: Iterator[pa.RecordBatch]):
        done, digest = [], None
        for conv_id, turns, ends in _blocks(batches, block_chars):
            digest = digest or _Digest(conv_id, Masked(path))
            digest.add(turns, ends)
            if ends:
                done.append(digest.row())
                digest = None
            if len(done) >= 1000:
                yield _batch(done)
                done = []
        if done:
            yield _batch(done)

    names = [id_col, *(part.split()[0] for part in DIGEST.split(", "))]
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def _batch(done):
        columns = [pa.array(values, t) for values, t in zip(zip(*done, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    return _sorted_turns(rows, id_col).mapInArrow(run, f"`{id_col}` {kind}, {DIGEST}")


def with_conversation(rows: DataFrame, conv_id: int, turns: list[tuple[str, str]]) -> DataFrame:
    """The rows and one more conversation, turns numbered from 0."""
    spark = rows.sparkSession
    rows = clash_free(rows, "conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(conv_id, i, role, text) for i, (role, text) in enumerate(turns)], rows.schema)
    return rows.unionByName(more.select(*(F.col(c) for c in rows.columns)))
