"""Line deduplication by pairwise alignment.

Documents that overlap are found through shared rare runs of lines: for every
line the shortest run of ``BLOCK_WORDS`` words that begins or ends with it (often
the line alone), known by the hashes of its lines. A run that several documents
hold pairs each later one with the first that holds it. Every shared block of that
size is covered by such runs, so each line of it meets a partner that holds it,
and the number of pairs follows the number of lines, however common a run is.
Each pair is aligned with a patience diff (lines that occur once on both sides,
their longest increasing sequence, and the same again between them; matches grow
over equal neighbours; where no line occurs once, equal occurrences are matched in
order). Aligned common blocks of at least ``BLOCK_WORDS`` words are deleted from
the later document, and so are the blocks of that size that the partner holds
elsewhere (moved or repeated passages). Of a line that follows itself more often
than anywhere in the partner, one stays unless it is aligned.

Documents are ordered by id (nulls last), then by a hash of the text. The first
holder of a block always keeps it. Blocks are judged on the input texts, each pair
by itself, so results do not depend on the order of pairs.

Rows: null text is left null, and an empty text stays empty. Lines end at line
feeds; blank lines pair nothing, but may lie inside a block. Rows that repeat
both id and text count as one document and are all treated alike. Lines that
repeat only within one document are kept. Other columns are passed through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import StageStore
from .text import _INVERSE, _POWER, _SPACE, clash_free, distinct, kind_of, lines, list_array, mix, place_of, slices, span_hashes, utf8

BLOCK_WORDS = 20

_KEY = ["k1", "k2"]


# -- alignment -----------------------------------------------------------------


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing sequence."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        back[i] = ends[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(value)
            ends.append(i)
        else:
            tops[pile], ends[pile] = value, i
    chain, i = [], ends[-1] if ends else -1
    while i >= 0:
        chain.append(i)
        i = back[i]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal lines, increasing on both sides."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        once = [(i, at_b[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at_b]
        chosen = [once[k] for k in increasing([j for _, j in once])]
        if not chosen:
            # No line occurs once on both sides: the k-th occurrences of equal lines are matched.
            places, used = {}, Counter()
            for j in range(b0, b1):
                places.setdefault(b[j], []).append(j)
            for i in range(a0, a1):
                if used[a[i]] < len(places.get(a[i], ())):
                    once.append((i, places[a[i]][used[a[i]]]))
                    used[a[i]] += 1
            chosen = [once[k] for k in increasing([j for _, j in once])]
        if not chosen:
            continue
        matched.extend(chosen)
        edges = [(a0 - 1, b0 - 1), *chosen, (a1, b1)]
        todo.extend(
            (i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:], strict=False) if i + 1 < i2 and j + 1 < j2
        )
    return sorted(matched)


def common_blocks(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Ranges of ``b`` that are aligned with consecutive lines of ``a``."""
    found: list[tuple[int, int]] = []
    before = None
    for i, j in patience(a, b):
        if before == (i - 1, j - 1):
            found[-1] = (found[-1][0], j + 1)
        else:
            found.append((j, j + 1))
        before = (i, j)
    return found


def longest_held(a: list[int], b: list[int]) -> list[int]:
    """For every line of ``b``, how many lines up to it stand as consecutive
    lines anywhere in ``a`` (suffix automaton; linear)."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for line in a:
        new, p = len(step), last
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and line not in step[p]:
            step[p][line] = new
            p = link[p]
        if p >= 0:
            q = step[p][line]
            if length[q] != length[p] + 1:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(line) == q:
                    step[p][line] = twin
                    p = link[p]
                link[q], q = twin, twin
            link[new] = q
        last = new
    out, state, size = [], 0, 0
    for line in b:
        while state and line not in step[state]:
            state = link[state]
            size = length[state]
        if line in step[state]:
            state, size = step[state][line], size + 1
        out.append(size)
    return out


def _runs(lines: list[int]) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    cuts = [0, *(j for j in range(1, len(lines)) if lines[j] != lines[j - 1]), len(lines)]
    return [(s, e) for s, e in zip(cuts, cuts[1:], strict=False) if s < e]


def elsewhere(a: list[int], b: list[int], b_words: list[int], gone: set[int], least_words: int) -> set[int]:
    """Lines of ``b`` in any block of enough words that ``a`` holds as
    consecutive lines, but one of equal neighbours that are more than in ``a``."""
    total = [0]
    for number in b_words:
        total.append(total[-1] + number)
    found: set[int] = set()
    covered = len(b)
    held = longest_held(a, b)
    # From the end, so that each line is added once.
    for end in range(len(b), 0, -1):
        start = end - held[end - 1]
        if total[end] - total[start] >= least_words and start < covered:
            found.update(range(start, min(end, covered)))
            covered = start
    longest: dict[int, int] = {}
    for start, end in _runs(a):
        longest[a[start]] = max(longest.get(a[start], 0), end - start)
    for start, end in _runs(b):
        if end - 1 in found and end - start > max(longest.get(b[start], 0), 1) and not gone.issuperset(range(start, end)):
            found.discard(max(set(range(start, end)) - gone))
    return found


def deleted_lines(b: list[int], b_words: list[int], partners, least_words: int = BLOCK_WORDS) -> set[int]:
    """Lines of ``b`` in blocks of enough words that it shares with a partner."""
    gone: set[int] = set()
    for a in partners:
        held = set(a)
        if all(j in gone or line not in held for j, line in enumerate(b)):
            continue
        aligned: set[int] = set()
        for start, end in common_blocks(a, b):
            if sum(b_words[start:end]) >= least_words:
                aligned.update(range(start, end))
        # Runs of held lines with a line that is left and enough words.
        words, left = 0, False
        for j, line in enumerate([*b, None]):
            if line in held:
                words, left = words + b_words[j], left or (j not in aligned and b_words[j] > 0)
            elif left and words >= least_words:
                aligned |= elsewhere(a, b, b_words, aligned, least_words)
                break
            else:
                words, left = 0, False
        gone |= aligned
    return gone


# -- Spark steps ---------------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns(
        {"k1": F.xxhash64(F.lit(1), f"`{id_col}`"), "k2": F.xxhash64(F.lit(2), f"`{text_col}`")}
    )


def run_keys(hashes: np.ndarray, words: np.ndarray, row: np.ndarray, n_rows: int, least_words: int):
    """Key and row of the distinct shortest runs of enough words that begin or
    end with a line that is not blank."""
    total = np.concatenate([[0], np.cumsum(words)])
    ends = np.cumsum(np.bincount(row, minlength=n_rows))
    begins = np.concatenate([[0], ends[:-1]])
    line = np.flatnonzero(words)
    # Runs that begin with a line, then those that end with one; ``upto`` is the line behind the run.
    upto = np.searchsorted(total, total[line] + least_words, "left")
    start = np.searchsorted(total, total[line + 1] - least_words, "right") - 1
    first, last = np.concatenate([line, start]), np.concatenate([upto, line + 1])
    owner = row[np.concatenate([line, line])]
    inside = (first >= begins[owner]) & (last <= ends[owner])
    first, last, owner = first[inside], last[inside], owner[inside]
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _POWER.upto(len(hashes)), out=sums[1:])
    keys = mix((sums[last] - sums[first]) * _INVERSE.upto(len(hashes) + 1)[first] + (last - first).astype(np.uint64))
    return distinct(keys, owner)


def line_table(docs: DataFrame, id_col: str, text_col: str, least_words: int = BLOCK_WORDS) -> DataFrame:
    """(k1, k2, id, lines, words, keys): hashes and word counts of all lines, and
    the keys of runs of lines."""
    kind = kind_of(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, text_col):
                data, offsets = utf8(part.column(3))
                starts, ends, row = lines(data, offsets)
                inside = ~_SPACE[data]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                begins[starts[(starts < ends)]] = inside[starts[(starts < ends)]]
                counted = np.concatenate([[0], np.cumsum(begins)])
                number = (counted[ends] - counted[starts]).astype(np.int32)
                hashes = span_hashes(data, starts, ends)
                keys, owner = run_keys(hashes, number, row, part.num_rows, least_words)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(3)),
                     list_array(hashes, row, part.num_rows),
                     list_array(number, row, part.num_rows, pa.int32()),
                     list_array(keys, owner, part.num_rows)],
                    ["k1", "k2", "id", "lines", "words", "keys"],
                )

    schema = f"k1 bigint, k2 bigint, id {kind}, lines array<bigint>, words array<int>, keys array<bigint>"
    return docs.select(*_KEY, id_col, text_col).mapInArrow(run, schema)


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = BLOCK_WORDS
) -> DataFrame:
    """(k1, k2, removed, partners): line numbers (from 0) to delete, and the ids
    of the documents they were aligned with, for documents that lose lines."""
    store = StageStore.for_session(docs.sparkSession)
    rows = _keyed(clash_free(docs, id_col, text_col), id_col, text_col).filter(F.col(text_col).isNotNull())
    table = store.border("lines", line_table(rows, id_col, text_col, least_words)).dropDuplicates(_KEY)
    table = store.border("documents", table)

    # The first holder of every shared run, and how many documents hold it.
    place = F.struct(F.col("id").isNull().alias("last"), "id", *_KEY)
    held = table.select(*_KEY, place.alias("place"), F.explode("keys").alias("key"))
    shared = (
        held.groupBy("key")
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("holders"))
        .filter("holders > 1")
    )
    # A table of its own, so that Spark can split a very common run in the join.
    shared = store.border("shared", shared)
    pairs = (
        held.join(shared, "key")
        .filter(F.col("place") != F.col("first"))
        .groupBy(*_KEY, F.col("first.k1").alias("p1"), F.col("first.k2").alias("p2"))
        .agg(F.min("holders").alias("holders"))
    )
    pairs = store.border("pairs", pairs)
    partner = table.select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("partner"), F.col("lines").alias("theirs")
    )
    beside = pairs.join(partner, ["p1", "p2"]).join(table.select(*_KEY, "lines", "words"), _KEY)
    # Dealt out again, as skew handling may have split a document's pairs.
    dealt = beside.repartition(*_KEY).sortWithinPartitions(*_KEY, "holders", "p1", "p2")
    kind = table.schema["id"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()

    def align(batches: Iterator[pa.RecordBatch]):
        done, current, gone, used = [], None, set(), []
        for batch in batches:
            for i in range(batch.num_rows):
                k1, k2, partner, theirs, own, words = (c[i].as_py() for c in batch.columns)
                if (k1, k2) != current:
                    if gone:
                        done.append((*current, sorted(gone), used))
                    current, gone, used = (k1, k2), set(), []
                more = deleted_lines(own, words, [theirs], least_words)
                if more:
                    used.append(partner)
                    gone |= more
                if len(done) >= 1000:
                    yield _batch(done)
                    done = []
        if gone:
            done.append((*current, sorted(gone), used))
        if done:
            yield _batch(done)

    def _batch(done):
        types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(id_type)]
        columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "removed", "partners"])

    columns = dealt.select(*_KEY, "partner", "theirs", "lines", "words")
    found = columns.mapInArrow(align, f"k1 bigint, k2 bigint, removed array<int>, partners array<{kind}>")
    return store.border("removed", found)


def remove_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = BLOCK_WORDS
) -> DataFrame:
    """All columns of ``docs`` with the shortened text, and ``n_lines``,
    ``removed`` (line numbers) and ``partners`` (ids) in a struct ``_lines``."""
    found = repeated_lines(docs, id_col, text_col, least_words)
    # By position, since columns may have names used here or names that need quotes.
    places = [f"_{i}" for i in range(len(docs.columns))]
    whose, text = (places[place_of(docs, c)] for c in (id_col, text_col))
    # The list grows with the input: it is merged at every size, not broadcast while small.
    joined = _keyed(docs.toDF(*places), whose, text).join(found.hint("merge"), _KEY, "left")
    parts = F.split(F.col(text), "\n", -1)
    kept = F.filter(parts, lambda _, i: ~F.array_contains(F.col("removed"), i))
    shorter = F.when(F.col("removed").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    report = F.struct(
        F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.coalesce("partners", F.array()).alias("partners"),
    )
    columns = [(shorter if c == text else F.col(c)).alias(c) for c in places]
    return joined.select(*columns, report).toDF(*docs.columns, "_lines")
