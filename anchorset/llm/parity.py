"""N-gram Jaccard join with parity sketches.

A document is its set of distinct ``WIDTH``-word shingles. Two documents link
when their sets overlap by at least 90 % of their union, so that a set of n and
one of m shingles differ in at most (n + m) / 19 of them. Each shingle flips one
bit of a sketch; the Hamming distance of two sketches is then at most the number
of shingles in which the sets differ. The sketch is cut into more parts than
that number, so at least one part of two linked documents is equal (pigeonhole),
and equal parts are joined. A part spans 2**32 bits, kept as the XOR of one
64-bit word per odd bit. A second, short sketch rules out most candidates by its
Hamming distance before their sets are compared.

Sizes fall into bands that grow by half; a document is sketched for its own band
and, near the lower end, for the band below. A part without any odd bit would be
equal for unrelated documents, so a band has so many parts that even its smallest
sets fill more of them than linked sets can differ in, by ``SPARE`` standard
deviations: the pigeonhole then holds among filled parts alone. A set that still
fills fewer (one in 30,000) joins its empty parts too. Everything is exact: no
group is capped, candidates are verified on the whole sets.

Rows: null, empty and blank texts have an empty set and no links. Rows with equal
id count as one document with the links of all their texts. A null id is linked
with nothing and has a null component. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import StageStore
from .linking import WIDE, link_classes, parity_bits, wide_sketches
from .text import clash_free, distinct, kind_of, list_array, mix, shingles, slices, stream, utf8, words

WIDTH = 3
SHARE = (90, 100)
GROWTH = 1.5
SPARE = 4
_SEEDS = stream(4, 71)


def band_edges(limit: int) -> list[int]:
    """Lower ends of the size bands up to ``limit``."""
    edges = [1]
    while edges[-1] <= limit:
        edges.append(max(edges[-1] + 1, int(edges[-1] * GROWTH)))
    return edges


def most_different(n: int, share: tuple[int, int] = SHARE) -> int:
    """In how many shingles linked sets can differ if the smaller has at most n."""
    num, den = share
    larger = n * den // num
    return (n + larger) * (den - num) // (den + num)


def filled_parts(n: int, parts: int) -> tuple[float, float]:
    """Expected number of parts that n values fill, and its standard deviation."""
    load = n / parts
    empty = math.exp(-load)
    return parts * (1 - empty), math.sqrt(max(parts * (empty - (1 + load) * empty**2), 0))


@lru_cache(maxsize=1024)
def parts_of_band(lower: int, upper: int, share: tuple[int, int] = SHARE) -> tuple[int, int]:
    """Parts and largest distance for a band of sizes from ``lower`` to below
    ``upper``. A single part is always filled."""
    distance = most_different(upper - 1, share)
    parts = distance + 1 + (distance + 19) // 20
    while parts > 1:
        mean, deviation = filled_parts(lower, parts)
        if mean - SPARE * deviation > distance:
            break
        parts += 1 + parts // 32
    return parts, distance


def sketch_keys(values: np.ndarray, share: tuple[int, int] = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(key, position) of the parts of one distinct set that have to be joined."""
    n, edges = len(values), band_edges(len(values))
    own = int(np.searchsorted(edges, n, "right")) - 1
    keys = []
    for band in (own, own - 1):
        # The band below holds partners with at least num / den times as many shingles.
        if band < 0 or (band < own and (edges[own] - 1) * share[1] < n * share[0]):
            continue
        parts, distance = parts_of_band(edges[band], edges[band + 1], share)
        word = mix(values ^ _SEEDS[0])
        part = (word % np.uint64(parts)).astype(np.int64)
        bit = (mix(values ^ _SEEDS[1]) >> np.uint64(32)) + _SEEDS[2]
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=parts)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        filled = counts > 0
        sums = np.zeros(parts, np.uint64)
        sums[filled] = np.bitwise_xor.reduceat(mix(bit)[order], starts[filled])
        some = sums != 0
        use = some if some.sum() > distance else np.ones(parts, bool)
        place = np.flatnonzero(use).astype(np.uint64)
        keys.append(mix(sums[use] ^ mix(place * _SEEDS[3] + np.uint64(band + 1))))
    return np.concatenate(keys)


def _sets(part: pa.RecordBatch, at: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(part.column(at))
    hashes, row = words(data, offsets)
    return distinct(*shingles(hashes, row, part.num_rows, width))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, share: tuple[int, int]) -> DataFrame:
    """(id, n, set_a, set_b, keys, bits): size, 128-bit digest, keys of the
    sketch parts and the short sketch."""
    kind = kind_of(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, text_col):
                values, row = _sets(part, 1, width)
                number = np.bincount(row, minlength=part.num_rows)
                starts = np.concatenate([[0], np.cumsum(number)])
                keys = [
                    sketch_keys(values[starts[i] : starts[i + 1]], share) if number[i] else np.zeros(0, np.uint64)
                    for i in range(part.num_rows)
                ]
                digests = []
                for seed in _SEEDS[:2]:
                    sums = np.zeros(part.num_rows, np.uint64)
                    some = number > 0
                    if some.any():
                        sums[some] = np.add.reduceat(mix(values ^ mix(values + seed)), starts[:-1][some])
                    digests.append(pa.array(sums.view(np.int64)))
                owner = np.repeat(np.arange(part.num_rows), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(number, pa.int64()), *digests,
                     list_array(np.concatenate(keys), owner, part.num_rows), parity_bits(values, row, part.num_rows)],
                    [id_col, "n", "set_a", "set_b", "keys", "bits"],
                )

    schema = "n bigint, set_a bigint, set_b bigint, keys array<bigint>, bits array<bigint>"
    return docs.mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int, wide: bool = False) -> DataFrame:
    """(id, values): the distinct shingle hashes of every text; or their wide sketches."""
    kind = kind_of(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, text_col):
                values, row = _sets(part, 1, width)
                sets = pa.RecordBatch.from_arrays(
                    [part.column(0), list_array(values, row, part.num_rows)], ["id", "values"]
                )
                yield wide_sketches(sets) if wide else sets

    return docs.mapInArrow(run, f"id {kind}, {WIDE if wide else 'values array<bigint>'}")


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    share: tuple[int, int] = SHARE,
) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the size of its set and the
    smallest id it is linked with, directly or through others."""
    store = StageStore.for_session(docs.sparkSession)
    rows = clash_free(docs, id_col, text_col)
    signed = store.border("signatures", signatures(rows, id_col, text_col, width, share))
    # Equal sets form one node, named after its smallest id.
    known = signed.filter((F.col("n") > 0) & F.col(id_col).isNotNull())
    nodes = known.groupBy("set_a", "set_b", "n").agg(F.min_by(F.struct(F.col(id_col).alias("id"), "keys", "bits"), id_col).alias("first"))
    nodes = store.border("nodes", nodes.select("set_a", "set_b", "n", "first.*"))
    keys = nodes.select(F.explode("keys").alias("key"), "id")

    def sets_of(ids: DataFrame, wide: bool = False) -> DataFrame:
        some = rows.join(ids.withColumnRenamed("id", id_col), id_col, "left_semi")
        return shingle_sets(some.select(id_col, text_col), id_col, text_col, width, wide)

    member = known.select(id_col, "set_a", "set_b", "n").join(
        nodes.select("set_a", "set_b", "n", F.col("id").alias("node")), ["set_a", "set_b", "n"]
    )
    # An id with several texts ties their nodes together.
    several = member.groupBy(id_col).agg(F.min("node").alias("a"), F.max("node").alias("_top")).filter("a < _top")
    ties = member.join(several, id_col).filter("node <> a").select("a", F.col("node").alias("b"))
    linked = link_classes(keys, nodes.select("id", "n", "bits"), sets_of, share, store, ties)
    found = member.join(linked.withColumnRenamed("id", "node"), "node", "left").select(
        id_col, F.coalesce("component", "node").alias("component_id")
    )
    least = found.groupBy(id_col).agg(F.min("component_id").alias("component_id"))
    return signed.select(id_col, F.col("n").alias("n_shingles")).join(least, id_col, "left").select(
        id_col, "n_shingles", F.coalesce("component_id", id_col).alias("component_id")
    )
