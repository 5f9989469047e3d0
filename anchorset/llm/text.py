"""Whole-array handling of text batches inside Arrow tasks.

A batch column becomes one byte array with offsets; words, shingles and their
64-bit hashes are then found with numpy over the whole slice, never row by row.
Slices hold at most ``SLICE_BYTES`` bytes or a single longer text, so memory
follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19

# Odd 64-bit multipliers of the splitmix finaliser and the rolling sums.
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values that depend on ``seed`` only."""
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)
    return mix(step + mix(np.array([seed], np.uint64) + np.uint64(1)))


_BYTE = stream(256, 11)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NO_SPACE = np.zeros(256, bool)


class _Powers:
    """Powers of an odd base modulo 2**64; short tables are kept."""

    def __init__(self, base: int):
        self.base, self.kept = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.kept) >= n:
            return self.kept[:n]
        table = np.full(n, self.base, np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if n <= 2 * SLICE_BYTES:
            self.kept = table
        return table


_POWER, _INVERSE = _Powers(_BASE), _Powers(_BASE_INV)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold at most ``limit`` bytes, or
    one row where a single text is longer."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    yield batch.slice(start)


def _tokens(data, offsets, separator):
    """Starts, ends and rows of the runs between separator bytes; runs never
    cross a row."""
    inside = np.empty(len(data) + 1, bool)
    np.logical_not(separator[data], out=inside[:-1])
    inside[-1] = False
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    finish = inside[:-1] & ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    finish[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes anywhere."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWER.upto(len(data)), out=sums[1:])
    values = (sums[ends] - sums[starts]) * _INVERSE.upto(len(data) + 1)[starts]
    return mix(values + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word: runs of bytes other than ASCII white space,
    A-Z lower-cased where ``fold`` is set."""
    starts, ends, row = _tokens(data, offsets, _SPACE)
    return span_hashes(_FOLD[data] if fold else data, starts, ends), row


def lines(data: np.ndarray, offsets: np.ndarray):
    """Start, end and row of every line; a row of k line feeds has k + 1 lines."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([feeds, offsets[1:]]), kind="stable")
    # Empty rows share their border with others: count lines per row.
    per_row = np.bincount(np.searchsorted(offsets, feeds, "right") - 1, minlength=len(offsets) - 1) + 1
    row = np.repeat(np.arange(len(offsets) - 1), per_row)
    return starts, ends, row


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words within a row, in order of
    position; a row with fewer words, but at least one, gives its whole
    sequence as a single shingle."""
    counts = np.bincount(row, minlength=n_rows)
    factors = stream(width, 23) | np.uint64(1)
    n = len(hashes)
    if n >= width:
        total = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            total += hashes[j : n - width + 1 + j] * factors[j]
        whole = row[: n - width + 1] == row[width - 1 :]
        values, rows = mix(total[whole] + np.uint64(width)), row[: n - width + 1][whole]
    else:
        values, rows = np.zeros(0, np.uint64), np.zeros(0, row.dtype)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short) == 0:
        return values, rows
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])[short]
    sums = np.zeros(len(short), np.uint64)
    for j in range(width - 1):
        has = counts[short] > j
        sums[has] += hashes[first[has] + j] * factors[j]
    values = np.concatenate([values, mix(sums + counts[short].astype(np.uint64))])
    rows = np.concatenate([rows, short])
    order = np.argsort(rows, kind="stable")
    return values[order], rows[order]


def distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, ordered by row and value."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values) == 0:
        return values, rows
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[fresh], rows[fresh]


def list_array(values: np.ndarray, rows: np.ndarray, n_rows: int, kind=None) -> pa.Array:
    """Values ordered by row as one list per row."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))])
    flat = pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, type=kind)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)


def clash_free(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, found by exact name first; a table may carry any
    others, also ones that differ in case only or hold dots."""
    places = [f"_{i}" for i in range(len(df.columns))]
    return df.toDF(*places).select(*(F.col(places[place_of(df, c)]).alias(c) for c in columns))


def place_of(df: DataFrame, name: str) -> int:
    """The position of a column, by exact name or else by the only name that
    differs in case."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        found = [i for i, c in enumerate(df.columns) if same(c)]
        if len(found) == 1:
            return found[0]
        if found:
            break
    raise ValueError(f"column {name} is missing or given more than once")


def kind_of(df: DataFrame, name: str) -> str:
    """A column's type as it stands in a schema string."""
    return df.schema[place_of(df, name)].dataType.simpleString()
