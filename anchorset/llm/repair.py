"""Repair of the turn structure of conversations at the least cost.

A conversation's roles, by their initials, have to read ``(s?(ua)+)?``: an
optional system turn, then user and assistant in turn. Its rows, in order, are
kept (0), given the role user or assistant (1), or deleted (2); an empty user or
assistant turn can be inserted anywhere (5). Blank rows and repeats of an earlier
row have to go; a row that breaks off costs 5 more unless it is deleted. Of the
cheapest edits, those whose initials (D, I, K, R) are least as text are taken.

1. Faults are Spark expressions; a row whose role and text stood earlier in the
   conversation is found by the least turn of each digest, combined before the
   shuffle, which is sorted in ahead of its row.
2. Cost. Each row becomes one byte. Least costs from every row and state of the
   pattern to the end follow backwards, for all conversations of a batch in step.
3. Path. Optimal edits lead from node (row, state) to node; of a node's, the one
   with the least initial is its step, and no two share an initial. Nodes are
   ranked by the initials of their next 1, 2, 4, … edits: a rank and a pointer
   for 2k edits come from those for k, by the pair (own rank, rank behind the
   pointer). The doubled pointers give all paths of a batch in logarithmically
   many steps, and ranks over whole audits tell which of them are equal.
4. The edits meet the sorted texts once more, which are hashed as they stream by.

A conversation of more than ``BLOCK`` rows is solved in blocks from its end: only
four costs are kept at each border, then paths are followed forward. So a task
holds one byte a row of a single conversation (its audit has as many), never
its texts.

Rows are ordered by turn (nulls first), then role and a digest of the text. Rows
without an id form one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.stages import StageStore
from .text import clash_free, kind_of

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
BLOCK = 1 << 16
NEVER = 1 << 40

# States of the pattern: nothing yet, after s, after u, after a. The turn that
# may follow, if it is not s: user from the first two and the last, else assistant.
NEXT = np.array([2, 2, 3, 2])
ROLES = ("user", "user", "assistant", "user")
ACCEPTS = np.array([0, NEVER, NEVER, 0])
# A row's code: its initial (s, u, a or another), 4 if it has to go, 8 if it breaks off.
INITIALS = "sua"
MUST_GO, BREAKS = 4, 8
# Edits by rank; the end of a path ranks below them.
EDITS = "DIKR"
_D, _I, _K, _R = range(1, 5)

_BLANK_CHARS = " \t\n\x0b\x0c\r"


# --- damage -----------------------------------------------------------------------


def damaged(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) with one fault in five rows of four, by the
    CRC-32 of id and turn, for trials; a conversation that loses all its rows
    keeps one without role and text. Nulls become a blank."""
    rows = clash_free(rows, id_col, "turn", "role", "text").toDF("conv_id", "turn", "role", "text")
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    # A dropped row leaves a mark, so that its conversation stays known.
    gone = F.col("fault") == 0
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), copies.alias("_copy")).drop("_copy")


# --- least costs and paths ----------------------------------------------------------


def row_edits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and next states of D, K and R for rows by states: (n, 4, 3) each."""
    n = len(codes)
    initial, must_go, breaks = codes & 3, (codes & MUST_GO) > 0, (codes & BREAKS) > 0
    costs, to = np.full((n, 4, 3), NEVER), np.zeros((n, 4, 3), np.int64)
    extra = np.where(must_go, NEVER, np.where(breaks, BROKEN, 0))
    for state in range(4):
        costs[:, state, 0], to[:, state, 0] = DELETE, state
        follows = initial == (1 if NEXT[state] == 2 else 2)
        starts = (initial == 0) if state == 0 else np.zeros(n, bool)
        costs[:, state, 1] = np.where(follows | starts, KEEP + extra, NEVER)
        to[:, state, 1] = np.where(starts, 1, NEXT[state])
        costs[:, state, 2], to[:, state, 2] = REROLE + extra, NEXT[state]
    return np.minimum(costs, NEVER), to


def with_inserts(cost: np.ndarray) -> np.ndarray:
    """Least costs when any number of turns is inserted first: (…, 4)."""
    for _ in range(3):
        cost = np.minimum(cost, cost[..., NEXT] + INSERT)
    return cost


class Batch:
    """Optimal edits for several runs of rows, each with the costs after it.

    A node is (row, state), a run's rows followed by its end; ``cost`` holds the
    least cost from each node on."""

    def __init__(self, runs: list[np.ndarray], after: np.ndarray):
        lengths = np.array([len(r) for r in runs])
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.costs = np.full((int((lengths + 1).sum()), 4, 3), NEVER)
        self.to = np.zeros(self.costs.shape, np.int64)
        rows = np.ones(len(self.costs), bool)
        rows[self.starts + lengths] = False
        self.costs[rows], self.to[rows] = row_edits(np.concatenate(runs))
        self.cost = np.full((len(self.costs), 4), NEVER)
        self.is_end = ~rows
        self.cost[self.is_end] = with_inserts(after)
        self.after = after
        longest = np.argsort(-lengths, kind="stable")
        for back in range(1, int(lengths.max(initial=0)) + 1):
            runs_left = longest[: np.searchsorted(-lengths[longest], -back, "right")]
            at = self.starts[runs_left] + lengths[runs_left] - back
            behind = np.take_along_axis(np.repeat(self.cost[at + 1][:, None], 4, 1), self.to[at], 2)
            self.cost[at] = with_inserts((self.costs[at] + behind).min(2))

    def least(self) -> np.ndarray:
        """Costs from each run's first node: (runs, 4)."""
        return self.cost[self.starts]

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Rank and target of the least optimal edit of every node; an end
        without a further edit has rank 0 and points to itself."""
        n = len(self.cost)
        place = np.arange(n)[:, None]
        at_end = np.repeat(self.is_end[:, None], 4, 1)
        stays = place * 4 + np.arange(4)
        rank, target = np.zeros((n, 4), np.int64), stays.copy()
        behind = np.minimum(place + 1, n - 1)
        # In falling order of rank, so that the least one stands at the end.
        for label, edit in ((_R, 2), (_K, 1), (_I, None), (_D, 0)):
            if edit is None:
                cost, to = INSERT + self.cost[:, NEXT], place * 4 + NEXT
            else:
                cost = self.costs[:, :, edit] + self.cost[behind, self.to[:, :, edit]]
                to = behind * 4 + self.to[:, :, edit]
            best = (cost == self.cost) & (self.cost < NEVER)
            if edit is not None:
                best &= ~at_end
            rank, target = np.where(best, label, rank), np.where(best, to, target)
        final = np.zeros((n, 4), bool)
        final[self.is_end] = self.cost[self.is_end] == self.after
        rank, target = np.where(final, 0, rank), np.where(final, stays, target)
        return rank.ravel(), target.ravel()

    def paths(self, states: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The least optimal path of every run from its given first state: the
        distinct audits, each run's place among them, and its last state."""
        rank, pointer = self.steps()
        label, start = rank, self.starts * 4 + states
        nodes = start[:, None]
        # ``rank`` orders nodes by their next nodes.shape[1] edits, ``pointer`` skips them.
        while (label[nodes[:, -1]] > 0).any():
            nodes = np.concatenate([nodes, pointer[nodes]], axis=1)
            _, rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)
            pointer = pointer[pointer]
        # Ranks now cover whole audits, so equal ones are read off once.
        _, one, which = np.unique(rank[start], return_index=True, return_inverse=True)
        return [path[path > 0] for path in label[nodes[one]]], which, nodes[:, -1] % 4


def solve(runs: list[np.ndarray], block: int = BLOCK) -> tuple[np.ndarray, list[str]]:
    """Least cost and audit of conversations given by their rows' codes."""
    letters = np.frombuffer(f"-{EDITS}".encode(), np.uint8)
    text = lambda ranks: letters[ranks].tobytes().decode()
    cost, audits = np.zeros(len(runs), np.int64), [""] * len(runs)
    short = sorted((i for i, run in enumerate(runs) if len(run) <= block), key=lambda i: len(runs[i]))
    for many in _together([len(runs[i]) for i in short], block):
        some = short[many]
        batch = Batch([runs[i] for i in some], np.tile(ACCEPTS, (len(some), 1)))
        edits, which, _ = batch.paths(np.zeros(len(some), np.int64))
        found = [text(path) for path in edits]
        for i, least, k in zip(some, batch.least()[:, 0].tolist(), which.tolist(), strict=True):
            cost[i], audits[i] = least, found[k]
    for i in sorted(set(range(len(runs))) - set(short)):
        cuts = range(0, len(runs[i]), block)
        after = [ACCEPTS]
        for at in reversed(cuts):
            after.append(Batch([runs[i][at : at + block]], after[-1][None]).least()[0])
        cost[i], state, parts = after[-1][0], np.zeros(1, np.int64), []
        for at, then in zip(cuts, after[-2::-1], strict=True):
            (path,), _, state = Batch([runs[i][at : at + block]], then[None]).paths(state)
            parts.append(text(path))
        audits[i] = "".join(parts)
    return cost, audits


def _together(lengths: list[int], most: int) -> Iterator[slice]:
    """Cuts ascending lengths into batches of about ``most`` rows; each counts as
    long as the longest, since paths are held side by side."""
    start, longest = 0, 0
    for i, length in enumerate(lengths):
        longest = max(longest, length + 1)
        if i > start and longest * (i - start + 1) > 2 * most:
            yield slice(start, i)
            start, longest = i, length + 1
    if lengths:
        yield slice(start, len(lengths))


# --- over all conversations ---------------------------------------------------------

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _first_of(rows: DataFrame) -> DataFrame:
    """Equal rows put together with their number, ahead of the first row of each
    role and text a mark (kind 1), ahead of each conversation another (kind 0)."""
    last = F.substring(F.rtrim("text", F.lit(_BLANK_CHARS)), -1, 1)
    some = rows.filter("role is not null").select(
        "conv_id", "turn", "role", _digest(F.col("text")).alias("digest"),
        F.when(last == "", 2).when(last.isin(".", "!", "?"), 0).otherwise(1).alias("fault"),
    )
    equal = some.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.count(F.lit(1)).alias("n"))
    first = some.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("t"))
    none = lambda kind: F.lit(None).cast(kind)
    marks = first.select("conv_id", F.col("t.turn").alias("turn"), "role", "digest", none("int").alias("fault"), none("bigint").alias("n"), F.lit(1).alias("kind"))
    known = rows.select("conv_id").distinct().select(
        "conv_id", none("bigint").alias("turn"), none("string").alias("role"), none("binary").alias("digest"),
        none("int").alias("fault"), none("bigint").alias("n"), F.lit(0).alias("kind"),
    )
    return equal.withColumn("kind", F.lit(2)).unionByName(marks).unionByName(known)


class _Tally:
    """Counts and codes of one conversation, row by row."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.parts = conv_id, bytearray(), []
        self.low = self.high = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def add(self, turn, role: str, fault: int, n: int, first: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
            self.turns += 1
        initial = role[:1]
        code = INITIALS.index(initial) if initial and initial in INITIALS else 3
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        # Equal rows of a turn follow one another; no role may follow itself.
        self.illegal += n - 1
        self.initial = initial
        if fault == 2:
            self.blank += n
            self.codes += bytes([code | MUST_GO]) * n
            return
        if first:
            self.truncated += fault
            self.codes.append(code | BREAKS * fault)
            n -= 1
        self.duplicate += n
        self.codes += bytes([code | MUST_GO]) * n

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _audits(id_type: pa.DataType, block: int):
    """Sorted rows and marks to counts, cost and audit of each conversation."""
    names = ["conv_id", *COUNTS, "audit"]
    types = [id_type, *([pa.int64()] * len(COUNTS)), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]):
        done, tally, rows, marked = [], None, 0, False

        def solved():
            cost, audits = solve([np.frombuffer(bytes(t.codes), np.uint8).astype(np.int64) for t in done], block)
            columns = [*zip(*(t.row() for t in done), strict=True), cost, audits]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for conv_id, turn, role, fault, n, kind in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault", "n", "kind")), strict=True
            ):
                if kind == 0:
                    if tally is not None:
                        done.append(tally)
                        rows += len(tally.codes) + 1
                    if rows >= block:
                        yield solved()
                        done, rows = [], 0
                    tally = _Tally(conv_id)
                elif kind == 1:
                    marked = True
                else:
                    tally.add(turn, role, fault, n, marked)
                    marked = False
        if tally is not None:
            done.append(tally)
            yield solved()

    return run


class _Repair:
    """The repaired text of one conversation, hashed edit by edit."""

    def __init__(self, head: tuple):
        self.head, self.audit, self.at, self.state = head, head[-1], 0, 0
        self.hash, self.begun = hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def _own(self, text: str) -> None:
        self._say(ROLES[self.state], text)
        self.state = int(NEXT[self.state])

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._own("")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._say(role, text)
            self.state = 1 if self.state == 0 and role[0] == "s" else int(NEXT[self.state])
        elif edit == "R":
            self._own(text)

    def row(self) -> tuple:
        self.inserts()
        return *self.head, self.hash.hexdigest()


def _hashes(id_type: pa.DataType):
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    types = [id_type, *([pa.int64()] * len(COUNTS)), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]):
        done, current = [], None

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        for batch in batches:
            heads = [batch.column(c) for c in names[:-1]]
            for i, (head, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("head", "role", "text")), strict=True)):
                if head:
                    if current is not None:
                        done.append(current.row())
                    current = _Repair(tuple(c[i].as_py() for c in heads))
                else:
                    current.add(role, text)
            if len(done) >= 1000:
                yield rows()
                done = []
        if current is not None:
            done.append(current.row())
            yield rows()

    return run


def repaired(rows: DataFrame, id_col: str = "conv_id", block: int = BLOCK) -> DataFrame:
    """One row per conversation: ``gaps`` in its turn numbers, the rows that are
    ``blank``, ``duplicate`` or ``truncated`` (first fault), ``illegal`` neighbours,
    ``cost`` and ``audit`` of the repair and the digest of the repaired
    ``role:text`` lines. A row whose role and text are null only names its
    conversation; another null counts as a blank."""
    rows = clash_free(rows, id_col, "turn", "role", "text").toDF("conv_id", "turn", "role", "text")
    known = F.col("role").isNotNull() | F.col("text").isNotNull()
    rows = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        *(F.when(known, F.coalesce(c, F.lit(" "))).alias(c) for c in ("role", "text")),
    )
    store, kind = StageStore.for_session(rows.sparkSession), kind_of(rows, "conv_id")
    id_type = to_arrow_type(rows.schema["conv_id"].dataType)
    counts = ", ".join(f"{c} bigint" for c in COUNTS)

    order = ["conv_id", "turn", "role", "digest"]
    marked = _first_of(rows).withColumn("named", F.col("kind") > 0)
    marked = marked.repartition("conv_id").sortWithinPartitions("conv_id", "named", *order[1:], "kind")
    audits = marked.select("conv_id", "turn", "role", "fault", "n", "kind").mapInArrow(
        _audits(id_type, block), f"conv_id {kind}, {counts}, audit string"
    )
    audits = store.border("audits", audits)

    none = {c: F.lit(None).cast("bigint") for c in COUNTS} | {"audit": F.lit(None).cast("string")}
    texts = rows.filter("role is not null").select(
        "conv_id", "turn", "role", "text", _digest(F.col("text")).alias("digest"), F.lit(False).alias("head"), *(v.alias(c) for c, v in none.items()),
    )
    heads = audits.select(
        "conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("binary").alias("digest"), F.lit(True).alias("head"), *COUNTS, "audit",
    )
    dealt = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").desc(), *order[1:])
    found = dealt.drop("turn", "digest").mapInArrow(_hashes(id_type), f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")
    return found.withColumnRenamed("conv_id", id_col)
