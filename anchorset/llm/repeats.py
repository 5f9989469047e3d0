"""Removal of repeated byte strings with a Burrows-Wheeler transform.

Every byte covered by a string of ``LEAST`` bytes that also starts anywhere else
is removed; matches do not cross documents and are judged on the input.

Finding the strings takes three steps.

1. Each ``LEAST``-byte window is assigned to its anchor: the position, inside the
   window, whose ``ANCHOR``-byte hash is least (leftmost on ties). Equal windows
   have equal anchors at the same place, so equal windows only have to be looked
   for among windows with equal anchors. Consecutive windows with the same anchor
   form a run, and the bytes under a run its segment.
2. Runs are counted per anchor and segment in Spark. A run whose anchor is unique
   has no repeated window; one whose segment occurs twice is repeated throughout.
3. What remains are different segments with the same anchor. They are dealt to
   buckets by anchor; each bucket sorts its suffixes, and the intervals of the
   Burrows-Wheeler transform are expanded breadth-first by backward extension.
   Every step fixes the common prefixes of one length, in increasing order, and
   the search stops at ``LEAST``: neighbours without a value then share that much.
   An anchor with more than ``HOT_SEGMENTS`` different segments is not given to
   one task; its windows are hashed (128 bits) and counted one by one in Spark.

Rows: null text is empty. Texts shorter than ``LEAST`` keep all bytes. Repeated
rows are copies of each other, so all their windows are repeated: they are known
by a count of ids and texts, and one of them stands for all in the search. Equal
texts have equal results. Rows are recognised by hashes of id and text; null ids
are allowed. Memory follows the longest text and ``BUCKET_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import subject_join
from ..sources.stages import StageStore
from .text import _BYTE, _INVERSE, _POWER, clash_free, kind_of, list_array, mix, slices, stream, utf8

LEAST = 400
ANCHOR = 128
HOT_SEGMENTS = 4096
BUCKET_BYTES = 1 << 20
# Windows of a very long text are handled in blocks of this many.
BLOCK_WINDOWS = 1 << 22

_KEY = ["k1", "k2"]
_SEEDS = stream(2, 131)


# -- anchors -------------------------------------------------------------------


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values, by block-wise minima
    from both ends."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def _window_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWER.upto(len(data)), out=sums[1:])
    return sums


def _window_hash(sums, starts, length, seed=np.uint64(0)):
    inverse = _INVERSE.upto(len(sums))
    return mix((sums[starts + length] - sums[starts]) * inverse[starts] + seed)


def runs(data: np.ndarray, offsets: np.ndarray, least: int, anchor: int) -> list[np.ndarray]:
    """Row, first window (from the row's start), number of windows, anchor hash
    and segment hash of every run."""
    none = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    if len(data) < least:
        return none
    span, place_bits = least - anchor + 1, np.uint64(24)
    sums = _window_sums(data)
    found = []
    for block in range(0, len(data) - least + 1, BLOCK_WINDOWS):
        n = min(BLOCK_WINDOWS, len(data) - least + 1 - block)
        at = np.arange(block, block + n + span - 1)
        hashes = _window_hash(sums, at, anchor)
        # Upper bits decide; the place behind them makes the leftmost win.
        order = (hashes >> place_bits << place_bits) | np.arange(len(at), dtype=np.uint64)
        place = (sliding_min(order, span) & np.uint64((1 << 24) - 1)).astype(np.int64)
        start = np.arange(block, block + n)
        row = np.searchsorted(offsets, start, "right") - 1
        valid = start + least <= offsets[row + 1]
        start, row, place = start[valid], row[valid], place[valid]
        if len(start) == 0:
            continue
        fresh = np.ones(len(start), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(fresh)
        number = np.diff(np.append(head, len(start)))
        first = start[head]
        length = number + least - 1
        segment = mix((sums[first + length] - sums[first]) * _INVERSE.upto(len(sums))[first] + length.astype(np.uint64))
        found.append((row[head], first - offsets[row[head]], number, hashes[place[head]], segment))
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else none


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(
        F.xxhash64(F.lit(1), id_col).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"), id_col, text.alias(text_col)
    )


def text_runs(docs: DataFrame, text_col: str, least: int, anchor: int) -> DataFrame:
    """(row, k1, k2, start, n, anchor, segment): one row per text, its runs as
    arrays. ``row`` is a short number in place of the hashes; it holds for the
    stored table only."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, text_col):
                owner, start, number, anchors, segments = runs(*utf8(part.column(2)), least, anchor)
                lists = (start.astype(np.int32), number.astype(np.int32), anchors, segments)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(list_array(x, owner, part.num_rows) for x in lists)],
                    ["k1", "k2", "start", "n", "anchor", "segment"],
                )

    schema = "k1 bigint, k2 bigint, start array<int>, n array<int>, anchor array<bigint>, segment array<bigint>"
    found = docs.select("k1", "k2", text_col).mapInArrow(run, schema)
    return found.select(F.monotonically_increasing_id().alias("row"), "*")


def one_of_each(keyed: DataFrame, text_col: str, least: int, store: StageStore) -> tuple[DataFrame, DataFrame]:
    """The rows with one for all that repeat id and text, and for those (k1, k2,
    start, n): all windows of the text, which its other rows repeat."""
    twice = keyed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*_KEY)
    twice = store.border("repeated_rows", twice)
    if twice.isEmpty():
        return keyed, twice.select(*_KEY, F.lit(0).alias("start"), F.lit(0).alias("n"))
    first = subject_join(keyed, twice, _KEY, "left_semi").groupBy(*_KEY).agg(F.first(text_col).alias(text_col))
    first = store.border("repeated_texts", first)
    once = subject_join(keyed, twice, _KEY, "left_anti").select(*_KEY, text_col)
    windows = F.octet_length(text_col) - (least - 1)
    every = first.filter(windows > 0).select(*_KEY, F.lit(0).alias("start"), windows.alias("n"))
    return once.unionByName(first), every


# -- suffixes of a bucket ------------------------------------------------------


def sorted_suffixes(symbols: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse. Symbol 0 ends a segment; ``left`` counts
    the symbols before the segment's end. Ends compare by position, so all
    suffixes differ. Only suffixes that are not yet told apart are sorted again."""
    n, packed = len(symbols), 7
    key = np.zeros(n, np.uint64)
    for j in range(packed):
        shifted = np.zeros(n, np.uint64)
        shifted[: max(n - j, 0)] = symbols[j:]
        shifted[left < j] = 0
        key = (key << np.uint64(9)) | shifted
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    depth = packed
    while not fresh.all():
        # Members of groups that hold more than one suffix, in order.
        open_ = ~fresh
        open_[:-1] |= ~fresh[1:]
        slot = np.flatnonzero(open_)
        where = order[slot]
        ended = left[where] < depth
        second = np.where(ended, where, rank[np.minimum(where + depth, n - 1)])
        group = rank[where]
        again = np.argsort(group * n + second)
        where, second, group = where[again], second[again], group[again]
        order[slot] = where
        new = np.ones(len(slot), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        fresh[slot] = new
        rank[where] = np.maximum.accumulate(np.where(new, slot, 0))
        depth *= 2
    return order, rank


def bounded_prefixes(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray, least: int) -> np.ndarray:
    """For every suffix in order, whether it shares at least ``least`` symbols
    with the one before it.

    Intervals of suffixes with a common start are extended to the left, level by
    level; a level's new intervals end where the common prefix has the level's
    length. Positions that no level below ``least`` reaches share that much."""
    n = len(order)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    before = order - 1
    char = np.where(before >= 0, symbols[before], 0).astype(np.int64)
    step = np.where(before >= 0, rank[before], 0)
    # Level 0: one interval per symbol; segment ends are all different.
    ends = int((symbols == 0).sum())
    first = symbols[order[ends:]]
    heads = ends + np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if n > ends else np.zeros(0, np.int64)
    low = np.concatenate([np.arange(ends), heads])
    high = np.concatenate([np.arange(ends), np.append(heads[1:], n) - 1]) if len(heads) else np.arange(ends)
    known[high + 1] = True
    for _ in range(1, least):
        if len(low) == 0:
            break
        # Extensions of single suffixes need no search for their ends.
        single = low == high
        lone = low[single]
        lone = lone[char[lone] > 0]
        new_low, new_high = [step[lone]], [step[lone]]
        wide_low, size = low[~single], (high - low + 1)[~single]
        if len(wide_low):
            owner = np.repeat(np.arange(len(wide_low)), size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + wide_low[owner]
            some = char[place] > 0
            owner, place = owner[some], place[some]
            key = owner * 512 + char[place]
            by = np.argsort(key, kind="stable")
            key, place = key[by], place[by]
            if len(key):
                head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                tail = np.append(head[1:], len(key)) - 1
                new_low.append(step[place[head]])
                new_high.append(step[place[tail]])
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        open_ = ~known[high + 1]
        low, high = low[open_], high[open_]
        known[high + 1] = True
    return ~known[:n]


def repeated_starts(segments: list[bytes], least: int) -> list[np.ndarray]:
    """Per segment, the starts of strings of ``least`` bytes that occur more than
    once in all segments."""
    lengths = np.array([len(s) for s in segments])
    ends = np.cumsum(lengths + 1) - 1
    symbols = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[ends] = 0
    segment = np.searchsorted(ends, np.arange(len(symbols)), "left")
    left = ends[segment] - np.arange(len(symbols))
    order, rank = sorted_suffixes(symbols, left)
    shares = bounded_prefixes(symbols, order, rank, least)
    repeated = shares.copy()
    repeated[:-1] |= shares[1:]
    hits = np.zeros(len(symbols), bool)
    hits[order[repeated]] = True
    begins = ends - lengths
    return [np.flatnonzero(hits[b:e]) for b, e in zip(begins, ends, strict=True)]


def _spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of consecutive starts."""
    head = np.flatnonzero(np.concatenate([[True], starts[1:] != starts[:-1] + 1])) if len(starts) else np.zeros(0, np.int64)
    return starts[head], np.diff(np.append(head, len(starts)))


# -- Spark steps ---------------------------------------------------------------

_START = "row bigint, start int, n int"


def _segments(docs: DataFrame, names: DataFrame, text_col: str, wanted: DataFrame, least: int) -> DataFrame:
    """(bucket, row, start, data) for the wanted runs (row, bucket, start, n)."""
    lists = wanted.join(names, "row").groupBy(*_KEY).agg(F.collect_list(F.struct("bucket", "row", "start", "n")).alias("runs"))
    rows = docs.select(*_KEY, text_col).join(lists, _KEY)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, text_col):
                out: list[list] = [[], [], [], []]
                for text, found in zip(*(part.column(i).to_pylist() for i in range(2)), strict=True):
                    data = text.encode()
                    for r in found:
                        cut = data[r["start"] : r["start"] + r["n"] + least - 1]
                        for column, value in zip(out, (r["bucket"], r["row"], r["start"], cut), strict=True):
                            column.append(value)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "row", "start", "data"])

    return rows.select(text_col, "runs").mapInArrow(run, "bucket bigint, row bigint, start int, data binary")


def _by_suffixes(segments: DataFrame, least: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        rows, begins = (table.column(c).to_numpy() for c in ("row", "start"))
        out = [[], [], []]
        for i, starts in enumerate(repeated_starts(table.column("data").to_pylist(), least)):
            first, number = _spans(starts)
            out[0].append(np.full(len(first), rows[i]))
            out[1].append(first + begins[i])
            out[2].append(number)
        row, start, n = (np.concatenate(c) for c in out)
        return pa.table({"row": row, "start": start.astype(np.int32), "n": n.astype(np.int32)})

    return segments.groupBy("bucket").applyInArrow(run, _START)


def _by_counting(segments: DataFrame, least: int, store: StageStore) -> DataFrame:
    """The same for anchors too common for one task: all windows, counted."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                _, row, start, data = (c[i].as_py() for c in batch.columns)
                sums = _window_sums(np.frombuffer(data, np.uint8))
                at = np.arange(len(data) - least + 1)
                hashes = [pa.array(_window_hash(sums, at, least, seed).view(np.int64)) for seed in _SEEDS]
                owner = pa.array(np.full(len(at), row))
                yield pa.RecordBatch.from_arrays(
                    [*hashes, owner, pa.array((at + start).astype(np.int32))], ["h1", "h2", "row", "start"]
                )

    windows = store.border("common_windows", segments.mapInArrow(run, "h1 bigint, h2 bigint, row bigint, start int"))
    twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h1", "h2")
    return windows.join(twice, ["h1", "h2"], "left_semi").select("row", "start", F.lit(1).alias("n"))


def repeated_windows(
    keyed: DataFrame, text_col: str, store: StageStore, least: int, anchor: int, hot_segments: int, bucket_bytes: int
) -> DataFrame:
    """(k1, k2, runs): consecutive starts (start, n) of repeated windows."""
    keyed, every = one_of_each(keyed, text_col, least, store)
    texts = store.border("runs", text_runs(keyed, text_col, least, anchor))
    names = texts.select("row", *_KEY)
    found = texts.select("row", F.explode(F.arrays_zip("start", "n", "anchor", "segment")).alias("r")).select("row", "r.*")
    # Most anchors are unique: their runs go first, by a count that is combined
    # before the shuffle.
    twice = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor")
    found = store.border("shared", found.join(store.border("anchors", twice), "anchor", "left_semi"))
    one = F.min(F.struct("row", "start", "n")).alias("one")
    kinds = found.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("copies"), one)
    kinds = store.border("kinds", kinds.select("anchor", "segment", "copies", "one.*"))

    copied = kinds.filter("copies > 1").select("anchor", "segment")
    whole = found.join(copied, ["anchor", "segment"], "left_semi").select("row", "start", "n")

    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    mixed = store.border("mixed", kinds.join(several, "anchor").select("anchor", "kinds", "row", "start", "n"))
    cold, hot = mixed.filter(F.col("kinds") <= hot_segments), mixed.filter(F.col("kinds") > hot_segments)
    total = cold.agg(F.sum(F.col("n") + least)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    parts = [whole]
    if total:
        dealt = cold.select("row", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket"), "start", "n")
        parts.append(_by_suffixes(_segments(keyed, names, text_col, dealt, least), least))
    if not hot.isEmpty():
        dealt = hot.select("row", F.lit(0).cast("long").alias("bucket"), "start", "n")
        parts.append(_by_counting(_segments(keyed, names, text_col, dealt, least), least, store))
    repeated = store.border("repeated", _union(parts))
    listed = repeated.join(names, "row").select(*_KEY, "start", "n").unionByName(every)
    return listed.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def removed_spans(starts: np.ndarray, numbers: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes from runs of window starts."""
    if len(starts) == 0:
        return starts, starts
    by = np.argsort(starts, kind="stable")
    begin, end = starts[by], (starts + numbers + least - 1)[by]
    reach = np.maximum.accumulate(end)
    head = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    return begin[head], reach[np.append(head[1:], len(begin)) - 1]


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    anchor: int = ANCHOR,
    hot_segments: int = HOT_SEGMENTS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept) for every row; spans are
    the removed byte ranges, kept the remaining bytes."""
    store = StageStore.for_session(docs.sparkSession)
    keyed = _keyed(clash_free(docs, id_col, text_col), id_col, text_col)
    lists = repeated_windows(keyed, text_col, store, least, min(anchor, least), hot_segments, bucket_bytes)
    kind = kind_of(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, text_col):
                counts, spans, kept = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = text.encode()
                    starts = np.array([r["start"] for r in found or ()], np.int64)
                    numbers = np.array([r["n"] for r in found or ()], np.int64)
                    begin, end = removed_spans(starts, numbers, least)
                    counts.append((len(data), int((end - begin).sum()), len(begin)))
                    spans.append([{"start": b, "end": e} for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
                    edges = zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True)
                    kept.append(b"".join(data[a:b] for a, b in edges))
                numbers = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *numbers, pa.array(spans, span), pa.array(kept, pa.binary())], names
                )

    names = [id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    schema = (
        f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint,"
        " spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
    return keyed.join(lists, _KEY, "left").select(id_col, text_col, "runs").mapInArrow(run, schema)
