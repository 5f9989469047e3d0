"""Byte-level BPE encoding and decoding with the ranks of a tiktoken file.

The bytes of a piece are read as Latin-1 characters, so that an Aho-Corasick
automaton over the vocabulary finds the longest token at every position. A
sequence of tokens is the result of the merges exactly if every two neighbours
are: merging the bytes of both alone gives both back. The encoder therefore
takes the longest match at each position, checks it against its left neighbour
(memoised), tries the next shorter match where that fails, and steps back where
none is left; a position given up once is not tried again, which keeps the work
linear in the piece. Two neighbours are checked by undoing their merges, latest
first: they stand if at no time an earlier merge could have bridged them.

What a worker remembers of pieces and pairs is bounded in bytes and forgotten
when its task ends, so that nothing of it weighs on later stages.

Rows: null text counts as empty (no ids, empty bytes). Texts are encoded whole.
Repeated rows give repeated results. Columns other than the id and the text are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import clash_free, kind_of, slices

# Pieces up to so many characters are remembered, in two generations of at most
# so many bytes, the older of which is dropped when the younger is full; pairs
# are forgotten at once.
KEPT_CHARS = 64
KEPT_BYTES = 48 << 20
KEPT_PAIRS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        parts = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in parts}


class Pieces(dict):
    """Ids of encoded pieces of text, as decimal numbers joined by commas."""

    def __init__(self, encode_piece, ranks):
        super().__init__()
        self.encode_piece, self.decimal = encode_piece, {rank: str(rank) for rank in ranks}
        self.older, self.held = {}, 0

    def __missing__(self, text: str) -> str:
        known = self.older.get(text)
        if known is None:
            known = ",".join(map(self.decimal.__getitem__, self.encode_piece(text.encode("utf-8"))))
        if len(text) <= KEPT_CHARS:
            if self.held >= KEPT_BYTES:
                self.older = dict(self)
                self.forget()
            self[text] = known
            self.held += 200 + 2 * len(text) + len(known)  # two headers and a place in the table
        return known

    def forget(self) -> None:
        self.clear()
        self.held = 0


class Tokenizer:
    """Ranks, the automaton over them and what was learnt about pairs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks lack a single byte")
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.prefix: dict[int, int | None] = {}
        self.length = {rank: len(token) for rank, token in self.token.items()}
        self.pieces = Pieces(self.encode_piece, self.token)
        self.by_decimal = {str(rank): token for rank, token in self.token.items()}

    def forget(self) -> None:
        """Drop what was learnt from texts; what is known of tokens stays."""
        self.pieces.forget()
        self.pieces.older = {}
        self.pairs.clear()

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge completes this one; (token, -1) for a
        single byte, None if merging the token's own bytes does not give it."""
        if token in self.halves:
            return self.halves[token]
        data = self.token[token]
        parts, found = [data[i : i + 1] for i in range(len(data))], (token, -1)
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best = min((x for x in ranked if x[0] is not None), default=None)
            if best is None:
                found = None
                break
            if len(parts) == 2:
                found = self.ranks[parts[0]], self.ranks[parts[1]]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        self.halves[token] = found
        return found

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.prefix:
            data = self.token[token]
            cuts = (self.ranks.get(data[:n]) for n in range(len(data) - 1, 0, -1))
            self.prefix[token] = next((rank for rank in cuts if rank is not None), None)
        return self.prefix[token]

    def stands(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives both back. Merges go by
        rank, the leftmost first, so a bridge counts from the time at which its
        rank comes before what was merged last on either side."""
        if self.last_merge(left) is None or self.last_merge(right) is None:
            return False
        before = len(self.token) + max(left, right)
        while True:
            bridge = self.ranks.get(self.token[left] + self.token[right])
            if bridge is not None and bridge < before:
                return False
            on_left, on_right = self.last_merge(left), self.last_merge(right)
            if on_left[1] >= 0 and (left > right or on_right[1] < 0):
                before, left = left, on_left[1]
            elif on_right[1] >= 0:
                before, right = right + 1, on_right[0]
            else:
                return True

    def starts_piece(self, token: int) -> bool:
        return self.last_merge(token) is not None

    def compatible(self, left: int, right: int) -> bool:
        """What ``stands`` says, remembered."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.stands(left, right)
        return known

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        latin, longest, size = data.decode("latin-1"), self.automaton.iter_long, len(data)
        length, pairs = self.length, self.pairs
        given_up = bytearray(size + 1)
        ids, starts, at = [], [], 0
        token = next(longest(latin))[1]
        while at < size:
            left = ids[-1] if ids else None
            while token is not None:
                end = at + length[token]
                if not given_up[end]:
                    fits = self.starts_piece(token) if left is None else pairs.get(left << 32 | token)
                    if fits is None:
                        fits = self.compatible(left, token)
                    if fits:
                        break
                token = self.shorter(token)
            if token is None:
                given_up[at] = 1
                at, token = starts.pop(), self.shorter(ids.pop())
            else:
                ids.append(token)
                starts.append(at)
                at = end
                if at < size:
                    token = next(longest(latin, at))[1]
        return tuple(ids)

    def decimals(self, text: str) -> str:
        """The ids of a text, joined by commas."""
        return ",".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.decimals(text).split(","))) if text else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One per Python worker."""
    return Tokenizer(read_ranks(path), pattern)


def _forgetting(path: str, pattern: str, work):
    """Batches through ``work``; the worker's tables are emptied at the end."""

    def run(batches: Iterator[pa.RecordBatch]):
        tok = tokenizer(path, pattern)
        try:
            for batch in batches:
                yield from work(batch, tok)
        finally:
            tok.forget()

    return run


def _digests(batch: pa.RecordBatch, tok: Tokenizer) -> pa.RecordBatch:
    counts, ids_hex, bytes_hex = [], [], []
    for text in batch.column(1).to_pylist():
        joined = tok.decimals(text or "")
        ids = joined.split(",") if joined else []
        counts.append(len(ids))
        ids_hex.append(hashlib.sha256(joined.encode()).hexdigest())
        bytes_hex.append(hashlib.sha256(b"".join(map(tok.by_decimal.__getitem__, ids))).hexdigest())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(bytes_hex)],
        names=[batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text. ``path`` is the rank file's place
    on every worker."""
    kind = kind_of(docs, id_col)

    def work(batch: pa.RecordBatch, tok: Tokenizer):
        for part in slices(batch, text_col):
            ids = [tok.encode(text or "") for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return clash_free(docs, id_col, text_col).mapInArrow(_forgetting(path, pattern, work), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text bytes) from token ids; null ids give empty bytes."""
    kind = kind_of(encoded, id_col)

    def work(batch: pa.RecordBatch, tok: Tokenizer):
        data = [tok.decode(ids or ()) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_col, "data"])

    return clash_free(encoded, id_col, ids_col).mapInArrow(_forgetting(path, pattern, work), f"`{id_col}` {kind}, data binary")


def token_digests(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode and decode every text and return its token count and the SHA-256
    of its ids (decimal, joined by commas) and of the decoded bytes, without
    moving the ids between stages."""
    kind = kind_of(docs, id_col)

    def work(batch: pa.RecordBatch, tok: Tokenizer):
        return (_digests(part, tok) for part in slices(batch, text_col))

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return clash_free(docs, id_col, text_col).mapInArrow(_forgetting(path, pattern, work), schema)
