"""The prefix trie of conversations, packed into double arrays by prefix shard.

A conversation is the sequence of its turns (role, text). Each distinct sequence
of first d turns is a node at depth d, the root has d = 0; the conversations that
start with it are its members.

1. A turn becomes a 16-byte digest of role and text, so texts are not shuffled.
   Equal conversations are put together before anything else, their ids in runs
   of 2 ** ``ID_BITS`` values.
2. Prefix shards. Paths are range-partitioned and sorted, so that every subtree
   is one run of them, and each task cuts its run into shards of at most
   ``SHARD_TURNS`` turns (or one longer path). So neither a common first turn nor
   a group of copies has to fit one task.
3. Double arrays. A shard numbers its turns densely and packs its trie into BASE
   and CHECK: the child of state s by turn c is t = BASE[s] + c if CHECK[t] = s.
   All paths walk through the arrays in step and leave their counts in the nodes.
4. Merge. Only prefixes of a shard's first or last path can have members in
   another shard. These upper nodes are added up over shards by the digest of
   their prefix; what hangs below them is final. Sums over subtrees then rise in
   the upper trie by doubled ancestor steps, so rounds follow the logarithm of
   its depth, and no step holds it in one place.

Turns are ordered by turn number (nulls first), then role and digest; null role
or text counts as empty. Repeated rows are repeated turns. Rows without a
conversation id belong to no conversation and are left out. An empty table has
no nodes. A task holds the digests of a shard; those of a single conversation, 20
bytes a turn, are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import subject_join
from ..sources.stages import StageStore
from .text import clash_free

ID_BITS = 9
SHARD_TURNS = 1 << 18
# Turns of a path that decide its task; paths that share them all go to one.
RANGE_TURNS = 64
# Free slots that are tried for the children of a node before new ones are added.
TRIED = 64

_DIGEST = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# --- paths ------------------------------------------------------------------------


def turns_of(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns): digest and UTF-8 size of every turn, in order."""
    rows = clash_free(rows, id_col, "turn", "role", "text").toDF("conv_id", "turn", "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).alias("size"))
    held = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return held.select("conv_id", F.transform("turns", lambda t: F.struct(t.digest.alias("digest"), t.size.alias("size"))).alias("turns"))


def shared_heads(turns: DataFrame, head_turns: Column, base: Column, most: int) -> DataFrame:
    """Conversations whose first ``head_turns`` turns (``most`` at the most) are
    those of the conversation ``base`` instead (all if it has fewer, none if it
    is absent); their own turns follow from there on."""
    heads = turns.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    both = turns.select("conv_id", "turns", head_turns.cast("int").alias("_h"), base.alias("_base")).join(heads, "_base", "left")
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return both.select("conv_id", F.concat(head, own).alias("turns"))


# --- double arrays ----------------------------------------------------------------


class DoubleArray:
    """BASE and CHECK of a trie over turn numbers from 1; state 0 is the root."""

    def __init__(self, slots: int):
        self.base = np.zeros(slots, np.int64)
        self.check = np.full(slots, -1, np.int64)
        self.check[0] = 0
        self.top = 1  # all slots from here on are free
        self._free, self._at = np.zeros(0, np.int64), 0

    def _reach(self, slots: int) -> None:
        if slots > len(self.check):
            more = max(slots, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _take(self, n: int) -> np.ndarray:
        """``n`` free slots, the lowest known ones first."""
        found = []
        while n:
            if self._at == len(self._free):
                # No hole is known: look below the top once, then go beyond it.
                holes = np.flatnonzero(self.check[: self.top] < 0)
                beyond = np.arange(self.top, self.top + max(n - len(holes), TRIED))
                self._reach(int(beyond[-1]) + 1)
                self._free, self._at = np.concatenate([holes, beyond]), 0
            some = self._free[self._at : self._at + n]
            self._at += len(some)
            some = some[self.check[some] < 0]
            if len(some):
                self.check[some] = 0  # no longer free; the parents follow
                self.top = max(self.top, int(some.max()) + 1)
            found.append(some)
            n -= len(some)
        return np.concatenate([np.zeros(0, np.int64), *found])

    def _base_for(self, codes: np.ndarray) -> int:
        """A base at which all of the ascending codes find free slots."""
        known = self._free[self._at : self._at + TRIED]
        starts = known[self.check[known] < 0] - codes[0]
        if len(starts):
            places = starts[:, None] + codes
            self._reach(int(places.max()) + 1)
            fits = (self.check[places] < 0).all(1)
            if fits.any():
                return int(starts[fits.argmax()])
        return self.top - int(codes[0])

    def add_children(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """All children of some states at once: pairs grouped by parent."""
        if len(parents) == 0:
            return
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        number = np.diff(np.concatenate([first, [len(parents)]]))
        for at, n in zip(first[number > 1].tolist(), number[number > 1].tolist(), strict=True):
            some = np.sort(codes[at : at + n])
            base = self._base_for(some)
            self._put(np.full(n, parents[at]), np.full(n, base), base + some)
        alone = first[number == 1]
        slots = self._take(len(alone))
        self._put(parents[alone], slots - codes[alone], slots)

    def _put(self, parents: np.ndarray, bases: np.ndarray, slots: np.ndarray) -> None:
        if len(slots):
            self._reach(int(slots.max()) + 1)
            self.base[parents], self.check[slots] = bases, parents
            self.top = max(self.top, int(slots.max()) + 1)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of states by codes; -1 where there is none."""
        to = self.base[states] + codes
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def dense_codes(digests: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Numbers from 1 for equal digests, in order of their first use by depth,
    so that the children of a node mostly get neighbouring numbers."""
    by_depth = np.argsort(depth, kind="stable")
    halves = digests.view(np.uint64).reshape(-1, 2)[by_depth]
    order = np.lexsort((halves[:, 0], halves[:, 1]))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (halves[order[1:]] != halves[order[:-1]]).any(1)
    group = np.cumsum(fresh) - 1
    rank = np.empty(len(order), np.int64)
    rank[np.argsort(order[fresh], kind="stable")] = np.arange(1, fresh.sum() + 1) if len(order) else 0
    codes = np.empty(len(order), np.int64)
    codes[by_depth[order]] = rank[group]
    return codes


def pack_trie(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """The trie of sorted paths, level by level."""
    trie = DoubleArray(len(codes) + TRIED + 1)
    rows, states = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
    for d in range(int(lengths.max(initial=0))):
        going = lengths[rows] > d
        rows, states = rows[going], states[going]
        code = codes[starts[rows] + d]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (states[1:] != states[:-1]) | (code[1:] != code[:-1])
        trie.add_children(states[fresh], code[fresh])
        states = trie.step(states, code)
    return trie


# --- shards -----------------------------------------------------------------------

NODES = (
    "key string, parent_key string, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint,"
    " n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, ends string"
)
_KINDS = [pa.string(), pa.string(), *([pa.int64()] * 8), pa.string()]
_NAMES = [part.split()[0] for part in NODES.split(", ")]


def _prefix_keys(path: bytes) -> list[str]:
    """Digests of all prefixes, the root's first."""
    running, keys = hashlib.md5(), []
    keys.append(running.hexdigest())
    for at in range(0, len(path), _DIGEST):
        running.update(path[at : at + _DIGEST])
        keys.append(running.hexdigest())
    return keys


def shard_nodes(paths: list[bytes], sizes: np.ndarray, n: np.ndarray, first: np.ndarray, ends: list[str]) -> pa.RecordBatch:
    """The nodes of one shard of sorted distinct paths.

    Nodes on the first or last path have a key: their numbers cover this shard
    only, and their sums cover the keyless nodes right below them. All others
    are complete."""
    lengths = np.array([len(p) // _DIGEST for p in paths], np.int64)
    starts = np.cumsum(lengths) - lengths
    depth_at = np.arange(lengths.sum()) - np.repeat(starts, lengths)
    codes = dense_codes(np.frombuffer(b"".join(paths), np.uint8), depth_at)
    trie = pack_trie(codes, starts, lengths)

    slots = len(trie.check)
    members, least = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
    depth, size = np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
    members[0], least[0], depth[0] = n.sum(), first.min(), 0
    key = {}
    ended = np.full(slots, -1, np.int64)
    rows, states = np.arange(len(paths)), np.zeros(len(paths), np.int64)
    border = {0: _prefix_keys(paths[0]), len(paths) - 1: _prefix_keys(paths[-1])}
    for d in range(int(lengths.max()) + 1):
        done = lengths[rows] == d
        ended[states[done]] = rows[done]
        for row, keys in border.items():
            if d <= lengths[row]:
                key[int(states[np.searchsorted(rows, row)])] = (keys[d], keys[d - 1] if d else None)
        rows, states = rows[~done], states[~done]
        if len(rows) == 0:
            break
        at = starts[rows] + d
        states = trie.step(states, codes[at])
        np.add.at(members, states, n[rows])
        np.minimum.at(least, states, first[rows])
        depth[states], size[states] = d + 1, sizes[at]

    nodes = np.flatnonzero(depth >= 0)
    nodes = nodes[np.argsort(-depth[nodes], kind="stable")]
    upper = np.zeros(slots, bool)
    upper[list(key)] = True
    closed = nodes[~upper[nodes]]
    parent = trie.check
    children = np.bincount(parent[closed], minlength=slots)
    leaves, saved = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    leaves[closed] = children[closed] == 0
    saved[closed] = (members[closed] - 1) * size[closed]
    for level in np.split(closed, np.flatnonzero(np.diff(depth[closed])) + 1):  # deepest first
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])

    below = {int(s): key[int(s)][0] for s in np.unique(parent[closed]) if int(s) in key}
    own = [key.get(s, (None, None)) for s in nodes.tolist()]
    parent_keys = [pair[1] if pair[0] else below.get(p) for pair, p in zip(own, parent[nodes].tolist(), strict=True)]
    outside = upper[nodes] | upper[parent[nodes]]
    values = [
        [pair[0] for pair in own], parent_keys, depth[nodes], least[nodes],
        pa.array(least[parent[nodes]], pa.int64(), mask=outside), members[nodes], children[nodes], leaves[nodes],
        saved[nodes], size[nodes], [ends[i] if i >= 0 else None for i in ended[nodes].tolist()],
    ]
    columns = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _shards(shard_turns: int):
    """Sorted (path, sizes, ids, n, first) rows to the nodes of their shards;
    rows of an equal path follow one another."""

    def run(batches: Iterator[pa.RecordBatch]):
        paths, sizes, n, first, hashes, held = [], [], [], [], [], 0

        def nodes():
            found = [h.hexdigest() for h in hashes]
            return shard_nodes(paths, np.concatenate([np.zeros(0, np.int64), *sizes]), np.array(n), np.array(first), found)

        for batch in batches:
            turn_sizes = batch.column("sizes")
            for i, (path, ids, count, least) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("path", "ids", "n", "first")), strict=True)
            ):
                if paths and path == paths[-1]:
                    hashes[-1].update(b"," + ids.encode())
                    n[-1] += count
                    first[-1] = min(first[-1], least)
                    continue
                if held >= shard_turns:
                    yield nodes()
                    paths, sizes, n, first, hashes, held = [], [], [], [], [], 0
                paths.append(path)
                sizes.append(turn_sizes[i].values.to_numpy().astype(np.int64))
                n.append(count)
                first.append(least)
                hashes.append(hashlib.sha256(ids.encode()))
                held += len(path) // _DIGEST + 1
        if paths:
            yield nodes()

    return run


# --- the whole trie ---------------------------------------------------------------


def trie_nodes(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of the trie of (conv_id, turns) rows, one row per conversation.

    Each has its smallest member ``conv_id``, ``depth``, the parent's
    ``parent_conv_id``, ``n_convs`` members, ``n_children``, and over its subtree
    ``n_leaves`` and ``saved_tokens``: for each node the bytes of its last text
    times its members but one. ``ends_sha256`` is the digest of the ascending ids
    of the members that end there."""
    store = StageStore.for_session(turns.sparkSession)
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), ""))
    paths = turns.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t.size).alias("sizes"))
    block = F.shiftright(F.col("conv_id").cast("bigint"), ID_BITS)
    ids = F.sort_array(F.collect_list("conv_id"))
    copies = paths.groupBy("path", "sizes", block.alias("block")).agg(
        F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"),
        F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("first"),
    )
    copies = store.border("paths", copies.withColumn("range", F.substring("path", 1, RANGE_TURNS * _DIGEST)))
    dealt = copies.repartitionByRange("range").sortWithinPartitions("path", "block")
    found = dealt.select("path", "sizes", "ids", "n", "first").mapInArrow(_shards(shard_turns), NODES)
    found = store.border("shards", found)

    closed = found.filter("key is null")
    upper = _upper(found.filter("key is not null"), store)
    ids_of = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    hanging = subject_join(closed.filter("parent_key is not null").drop("parent_conv_id"), ids_of, "parent_key")
    top = upper.drop("parent_conv_id").join(ids_of, "parent_key", "left")
    every = closed.filter("parent_key is null").select(*_out(F.col("parent_conv_id")))
    for part in (hanging, top):
        every = every.unionByName(part.select(*_out(F.col("_parent"))))
    return every


def _out(parent: Column) -> list[Column]:
    ends = F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    return [parent.alias(c) if c == "parent_conv_id" else ends if c == "ends_sha256" else F.col(c) for c in COLUMNS]


def _upper(parts: DataFrame, store: StageStore) -> DataFrame:
    """The upper nodes, added up over shards, with sums over their subtrees."""
    added = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.max(c).alias(c) for c in ("parent_key", "depth", "size", "ends")]
    nodes = store.border("upper", parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *added, *same))
    more = nodes.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("_more"))
    nodes = nodes.join(more, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0))).drop("_more")
    nodes = nodes.withColumns({
        "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint"),
        "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"),
        "above": F.col("parent_key"),
    })
    nodes, turn = store.border("upper_0", nodes), 0
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    # Sums cover descendants less than 2**turn steps down; ``above`` is 2**turn steps up.
    while 1 << turn <= deepest:
        rise = nodes.filter("above is not null").groupBy(F.col("above").alias("key")).agg(
            F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")
        )
        far = nodes.select(F.col("key").alias("above"), F.col("above").alias("_above"))
        nodes = nodes.join(rise, "key", "left").join(far, "above", "left")
        nodes = nodes.withColumns({
            "n_leaves": F.col("n_leaves") + F.coalesce("_leaves", F.lit(0)),
            "saved_tokens": F.col("saved_tokens") + F.coalesce("_saved", F.lit(0)),
            "above": F.col("_above"),
        }).drop("_leaves", "_saved", "_above")
        turn += 1
        nodes = store.border(f"upper_{turn}", nodes)
    return nodes
