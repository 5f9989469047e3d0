"""SimHash near duplicates with BK-trees.

A text's fingerprint is the majority, bit by bit, of the XXH64 values of its
four-word shingles, repeats included. Fingerprints of at most ``RADIUS``
differing bits are linked; components are found over the links.

1. Equal fingerprints are one node, named after its smallest id.
2. Shards. The 64 bits are cut into blocks, ``equal`` more than the radius. Two
   linked fingerprints agree in at least ``equal`` whole blocks, so each choice
   of that many blocks, with their bits, names a shard, and every link lies
   within some shard. ``equal`` grows with the number of nodes, so that shards
   of unrelated fingerprints stay small; any value gives the same links.
3. Trees. Shard members are sorted over all tasks and cut into packs of at most
   ``PACK`` members, however many a shard has. A pack becomes a BK-tree: a child
   hangs under the edge that carries its Hamming distance to the parent. A
   search for q that stands at distance d from a node follows only the edges
   from d - RADIUS to d + RADIUS, which loses nothing (triangle inequality).
4. Search. Each pack is searched for its own members. Where a shard has several
   packs, their trees are joined with one another's packs by shard, so a tree is
   broadcast if Spark finds the trees small enough, and shuffled if not.
5. Links of a pack leave the task as a spanning forest, at most one edge a
   member, so that n near copies never become n * n rows.

Rows: null, empty and blank texts have fingerprint zero, and link like any other.
Rows with equal id count as one document with the links of all its texts. A null
id has a fingerprint, is linked with nothing and has a null component. An empty
table gives an empty result. A text is read in runs of ``RUN`` words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from ..sources.stages import StageStore
from .linking import components
from .text import clash_free, kind_of, slices, utf8

WIDTH = 4
SEED = 42
BITS = 64
RADIUS = 4
PACK = 1 << 14
RUN = 1 << 16
# Node and query meetings that one step of a search may hold in memory.
STEP = 1 << 21

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


# --- fingerprints -----------------------------------------------------------------


def _runs(text: np.ndarray, width: int) -> Iterator[list[bytes]]:
    """The words of one text in runs that overlap by width - 1 words."""
    if len(text) <= RUN:
        yield text.tobytes().translate(_FOLD).split()
        return
    space = _SPACES[text]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    for first in range(0, max(len(begins) - width + 1, 1), RUN):
        after = first + RUN + width - 1
        end = begins[after] if after < len(begins) else len(text)
        yield text[begins[first] if len(begins) else 0 : end].tobytes().translate(_FOLD).split()


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """XXH64 of every run of ``width`` space-joined words, or of all if fewer."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.array(hashes, "<u8")


def fingerprint(text: np.ndarray, width: int = WIDTH) -> np.uint64:
    """The fingerprint of one text, given as its UTF-8 bytes."""
    total, ones = 0, np.zeros(BITS, np.int64)
    for words in _runs(text, width):
        if words:
            hashes = shingle_hashes(words, width)
            total += len(hashes)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, fp) of every row; the fingerprint as a signed 64-bit value."""
    kind = kind_of(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, text_col):
                data, at = utf8(part.column(1))
                found = [fingerprint(data[at[i] : at[i + 1]], width) for i in range(part.num_rows)]
                values = pa.array(np.array(found, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), values], [id_col, "fp"])

    return clash_free(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


# --- trees ------------------------------------------------------------------------


def build_trees(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of all groups at once. Returns the members in tree order, roots
    first and then level by level, and each one's edge: parent's place * 65 +
    distance, -1 for a root. Edges ascend, so a node's children are a run of them.
    ``group`` is sorted and counts from 0; fingerprints are distinct per group."""
    order, edges = [], []
    left, edge, placed, top = np.arange(len(fps)), group, 0, True
    while len(left):
        first = np.ones(len(left), bool)
        first[1:] = edge[1:] != edge[:-1]
        nodes = left[first]
        order.append(nodes)
        edges.append(np.full(len(nodes), -1) if top else edge[first])
        place = placed + np.cumsum(first) - 1
        below = ~first
        parent = nodes[place[below] - placed]
        edge = place[below] * 65 + np.bitwise_count(fps[left[below]] ^ fps[parent])
        sort = np.argsort(edge, kind="stable")
        left, edge = left[below][sort], edge[sort]
        placed, top = placed + len(nodes), False
    return np.concatenate([np.zeros(0, np.int64), *order]), np.concatenate([np.zeros(0, np.int64), *edges])


def search(
    tree: np.ndarray, edges: np.ndarray, queries: np.ndarray, roots: np.ndarray, radius: int = RADIUS
) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of all members within the radius, each query in the tree
    below its root."""
    query, place, found = np.arange(len(queries)), roots, []
    while len(query):
        far = np.bitwise_count(tree[place] ^ queries[query]).astype(np.int64)
        near = far <= radius
        found.append((query[near], place[near]))
        low = np.searchsorted(edges, place * 65 + np.maximum(far - radius, 1))
        high = np.searchsorted(edges, place * 65 + np.minimum(far + radius, BITS), "right")
        number = high - low
        query = np.repeat(query, number)
        place = np.repeat(low - (np.cumsum(number) - number), number) + np.arange(len(query))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([q for q, _ in found]), np.concatenate([p for _, p in found])


class Forest:
    """Which members are connected, as a label (a member) for each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.label[a], self.label[b]
            open_ = a != b
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return moved, self.label[moved]


def _steps(costs: np.ndarray) -> Iterator[slice]:
    """Runs of queries whose groups hold at most ``STEP`` members in sum."""
    start, held = 0, 0
    for i, cost in enumerate(costs.tolist()):
        if i > start and held + cost > STEP:
            yield slice(start, i)
            start, held = i, 0
        held += cost
    if len(costs):
        yield slice(start, len(costs))


def linked_within(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (member, member) of the links inside each group."""
    order, edges = build_trees(fps, group)
    tree, sizes = fps[order], np.bincount(group)
    roots = np.arange(len(sizes))  # the trees' roots come first, in order of their groups
    forest = Forest(len(fps))
    for run in _steps(sizes[group]):
        query, place = search(tree, edges, fps[run], roots[group[run]], radius)
        forest.join(query + run.start, order[place])
    return forest.edges()


# --- shards and links -------------------------------------------------------------


def shard_masks(equal: int, radius: int = RADIUS) -> list[int]:
    """One mask for each choice of ``equal`` of the blocks, as signed values."""
    blocks = radius + equal
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(parts, equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def equal_blocks(nodes: int, radius: int = RADIUS) -> int:
    """As many blocks as leave a shard of unrelated fingerprints about eight members."""
    equal = 2
    while equal < 8 and nodes >> (BITS * equal // (radius + equal)) > 8:
        equal += 1
    return equal


def _packs(pack: int, id_type: pa.DataType, radius: int):
    """Turns sorted (choice, bits, fp, id) rows into links within packs, and into
    trees of the packs whose shard has, or may have, others: those of a shard
    with more than ``pack`` members, and the first and last shard of the rows
    that are held at a time."""
    lists = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(id_type)]
    names = ["a", "b", "choice", "bits", "tree", "edges", "ids"]

    def links(a: pa.Array, b: pa.Array) -> pa.RecordBatch:
        blank = [pa.nulls(len(a), t) for t in (pa.int32(), pa.int64(), *lists)]
        return pa.RecordBatch.from_arrays([a, b, *blank], names)

    def tree(choice, bits, fps: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        order, edges = build_trees(fps, np.zeros(len(fps), np.int64))
        own = ids.take(pa.array(order))
        packed = [pa.array([fps[order].view(np.int64)], lists[0]), pa.array([edges], lists[1])]
        packed.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))
        none = pa.nulls(1, id_type)
        return pa.RecordBatch.from_arrays([none, none, pa.array([choice], pa.int32()), pa.array([bits], pa.int64()), *packed], names)

    def links_and_trees(rows: pa.Table):
        choice, bits = (rows.column(i).to_numpy() for i in (0, 1))
        fps = rows.column(2).to_numpy().view(np.uint64)
        ids = pa.concat_arrays(rows.column(3).chunks)
        fresh = np.ones(len(fps), bool)
        fresh[1:] = (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])
        shard = np.cumsum(fresh) - 1
        fresh |= (np.arange(len(fps)) - np.flatnonzero(fresh)[shard]) % pack == 0
        a, b = linked_within(fps, np.cumsum(fresh) - 1, radius)
        if len(a):
            yield links(ids.take(pa.array(a)), ids.take(pa.array(b)))
        starts = np.flatnonzero(fresh)
        ends, of = np.concatenate([starts[1:], [len(fps)]]), shard[starts]
        several = (np.bincount(of)[of] > 1) | (of == 0) | (of == shard[-1])
        for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
            yield tree(choice[s], bits[s], fps[s:e], ids.slice(s, e - s))

    def run(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 4 * pack:
                yield from links_and_trees(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from links_and_trees(pa.Table.from_batches(held))

    return run


def _between(id_type: pa.DataType, radius: int):
    """Links between two packs of a shard: one's members, looked up in the other's tree."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                tree, edges, other = (batch.column(c)[i].values.to_numpy() for c in ("tree", "edges", "other"))
                ids, other_ids = batch.column("ids")[i].values, batch.column("other_ids")[i].values
                tree, other = tree.view(np.uint64), other.view(np.uint64)
                forest = Forest(len(tree) + len(other))
                for part in _steps(np.full(len(other), len(tree))):
                    query, place = search(tree, edges, other[part], np.zeros(part.stop - part.start, np.int64), radius)
                    forest.join(query + part.start + len(tree), place)
                a, b = forest.edges()
                every = pa.concat_arrays([ids, other_ids])
                yield pa.RecordBatch.from_arrays([every.take(pa.array(a)), every.take(pa.array(b))], ["a", "b"])

    return run


def near_links(nodes: DataFrame, store: StageStore, equal: int, radius: int = RADIUS, pack: int = PACK) -> DataFrame:
    """Links (a, b) between node ids that connect whatever fingerprints within
    the radius connect. ``nodes`` has (id, fp), each fingerprint once."""
    kind = kind_of(nodes, "id")
    id_type = to_arrow_type(nodes.schema["id"].dataType)
    shards = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(shard_masks(equal, radius))))
    members = nodes.select(F.explode(shards).alias("s"), "fp", "id").select("s.choice", "s.bits", "fp", "id")
    by = ["choice", "bits", "fp"]
    dealt = members.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = f"a {kind}, b {kind}, choice int, bits bigint, tree array<bigint>, edges array<bigint>, ids array<{kind}>"
    found = store.border("packs", dealt.mapInArrow(_packs(pack, id_type, radius), schema))
    trees = found.filter("tree is not null").select("choice", "bits", "tree", "edges", "ids")
    others = found.filter("tree is not null").select(
        "choice", "bits", F.col("tree").alias("other"), F.col("ids").alias("other_ids")
    )
    # Packs of a shard hold different fingerprints; the least one orders them.
    pairs = trees.join(others, ["choice", "bits"]).filter(F.array_min("tree") < F.array_min("other"))
    across = pairs.select("tree", "edges", "ids", "other", "other_ids").mapInArrow(_between(id_type, radius), f"a {kind}, b {kind}")
    return found.filter("tree is null").select("a", "b").unionByName(across)


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    radius: int = RADIUS,
    equal: int | None = None,
    pack: int = PACK,
) -> DataFrame:
    """(id, fingerprint, component_id) for every row: 16 hexadecimal digits, and
    the smallest id that links lead to."""
    store = StageStore.for_session(docs.sparkSession)
    signed = store.border("fingerprints", fingerprints(docs, id_col, text_col, width))
    known = signed.filter(F.col(id_col).isNotNull())
    nodes = store.border("nodes", known.groupBy("fp").agg(F.min(id_col).alias("id")).select("id", "fp"))
    links = near_links(nodes.select("id", "fp"), store, equal or equal_blocks(nodes.count(), radius), radius, pack)
    # An id with several texts ties their nodes together.
    owned = known.select(id_col, "fp").distinct().join(nodes.withColumnRenamed("id", "node"), "fp")
    several = owned.groupBy(id_col).agg(F.min("node").alias("a"), F.max("node").alias("_top")).filter("a < _top")
    ties = owned.join(several, id_col).filter("node <> a").select("a", F.col("node").alias("b"))
    links = store.border("links", links.unionByName(ties).filter("a <> b").distinct())
    found = store.border("classes", components(links, store))
    labelled = nodes.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    rows = signed.join(labelled, "fp", "left")
    return rows.select(
        id_col,
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"),
    )
