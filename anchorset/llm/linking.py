"""Connected classes of documents from shared keys and verified set similarity.

Shared by the operators that link documents by sets of hashes. Links are found
without forming all pairs of a group: each key compares its members with one
pivot, classes are formed, and only members of different classes that still
share a key are compared with each other afterwards, where parity sketches rule
out most pairs, and sketches as wide as the sets those of large sets. So no link between two classes is lost, and a large group of
copies costs one verification per member and pivot.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import StageStore
from .text import mix

SKETCH_WORDS = 16


def components(edges: DataFrame, store: StageStore, name: str = "components") -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id that
    can be reached. Labels take the least of their neighbours' and then their
    label's label, until nothing changes; each round is a stored table."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = store.border(f"{name}_edges", both.distinct())
    labels = store.border(f"{name}_0", both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    turn = 0
    while True:
        turn += 1
        near = (
            both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("seen")), "b")
            .groupBy("a")
            .agg(F.min("seen").alias("seen"))
        )
        lower = labels.join(near, "a").select(
            "a", F.least("label", "seen").alias("label"), (F.col("seen") < F.col("label")).alias("moved")
        )
        lower = store.border(f"{name}_{turn}_near", lower)
        if lower.filter("moved").isEmpty():
            return lower.select(F.col("a").alias("id"), F.col("label").alias("component"))
        over = lower.select(F.col("a").alias("label"), F.col("label").alias("next"))
        jumped = lower.join(over, "label", "left").select("a", F.coalesce("next", "label").alias("label"))
        labels = store.border(f"{name}_{turn}", jumped)


def parity_bits(values: np.ndarray, row: np.ndarray, n_rows: int) -> pa.Array:
    """A sketch of ``SKETCH_WORDS`` 64-bit words per row: each of its distinct
    values flips one bit. Two sketches differ in at most as many bits as the
    sets differ in values."""
    places = SKETCH_WORDS * 64
    place = (mix(values + np.uint64(places)) % np.uint64(places)).astype(np.int64)
    odd = np.bincount(row * places + place, minlength=n_rows * places).astype(np.uint8) & 1
    flat = np.packbits(odd).view(np.int64)
    ends = np.arange(n_rows + 1, dtype=np.int32) * SKETCH_WORDS
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def may_link(a: str, b: str, share: tuple[int, int]) -> Column:
    """Whether sizes and sketches of two sides (columns ``n_<side>`` and
    ``bits_<side>``) allow a link. Never false for linked sets."""
    num, den = share
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    apart = F.lit(0)
    for i in range(SKETCH_WORDS):
        apart += F.bit_count(F.col(f"bits_{a}")[i].bitwiseXOR(F.col(f"bits_{b}")[i]))
    fits = (n_a * den >= n_b * num) & (n_b * den >= n_a * num)
    return fits & (apart * (den + num) <= (n_a + n_b) * (den - num))


def wide_level(n: int) -> int:
    """0 if a sketch of ``SKETCH_WORDS`` has a bit per value; each level has four times the bits."""
    level = 0
    while SKETCH_WORDS * 64 * 4**level < n:
        level += 1
    return level


WIDE = "n bigint, level int, own boolean, wide array<bigint>"


def wide_sketches(sets: pa.RecordBatch) -> pa.RecordBatch:
    """(id, n, level, own, wide) of the large sets in (id, values): the parity
    sketch of the set's own level and of those of its possible partners. Done in
    the pass that makes the sets, so that no task needs a second Python worker."""
    at, sizes, levels, own, wide = [], [], [], [], []
    for i, values in enumerate(sets.column(1)):
        values = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
        n = len(values)
        for level in sorted({wide_level(n // 2), wide_level(n), wide_level(2 * n)} - {0}):
            places = SKETCH_WORDS * 64 * 4**level
            place = (mix(values + np.uint64(places)) % np.uint64(places)).astype(np.int64)
            odd = np.bincount(place, minlength=places).astype(np.uint8) & 1
            at.append(i)
            sizes.append(n)
            levels.append(level)
            own.append(level == wide_level(n))
            wide.append(np.packbits(odd).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [sets.column(0).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()), pa.array(levels, pa.int32()),
         pa.array(own, pa.bool_()), pa.array(wide, pa.list_(pa.int64()))],
        ["id", "n", "level", "own", "wide"],
    )


def plausible(pairs: DataFrame, wide: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) but those of large sets that differ in too many bits of
    their wide sketches. Linked sets never do."""
    num, den = share
    a = wide.filter("own").select(F.col("id").alias("a"), F.col("n").alias("n_a"), "level", F.col("wide").alias("w_a"))
    b = wide.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("level").alias("level_b"), F.col("wide").alias("w_b"))
    beside = pairs.join(a, "a").join(b, "b").filter("level = level_b")
    apart = F.aggregate(
        F.zip_with("w_a", "w_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x
    )
    unlike = beside.filter(apart * (den + num) > (F.col("n_a") + F.col("n_b")) * (den - num)).select("a", "b")
    return pairs.join(unlike, ["a", "b"], "left_anti")


def side(sketches: DataFrame, name: str) -> DataFrame:
    return sketches.select(
        F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}")
    )


def verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets overlap by at least ``share`` (numerator,
    denominator) of their union. ``sets`` has (id, values)."""
    num, den = share
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("values").alias("v_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("values").alias("v_b")), "b"
    )
    inter = F.size(F.array_intersect("v_a", "v_b"))
    union = F.size("v_a") + F.size("v_b") - inter
    return full.filter((inter * den >= union * num) & (union > 0)).select("a", "b").distinct()


def link_classes(
    keys: DataFrame,
    sketches: DataFrame,
    sets_of: Callable[..., DataFrame],
    share: tuple[int, int],
    store: StageStore,
    known: DataFrame | None = None,
) -> DataFrame:
    """(id, component) for every id with a link.

    ``keys`` has (key, id) rows; linked documents share at least one key.
    ``sketches`` has (id, n, bits) with sizes and parity sketches; pairs that
    these rule out are dropped inside the join that forms them. ``sets_of``
    returns (id, values) for a table of ids, or with True their ``wide_sketches``. ``known`` holds links (a, b) that
    need no check. A key with very many members is split by Spark's skew-join
    handling; its pairs are compared, but only plausible ones leave the join."""

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        large = _ids(pairs).join(sketches.filter(F.col("n") * 2 > SKETCH_WORDS * 64).select("id"), "id", "left_semi")
        wide = store.border(f"{name}_wide", sets_of(large, True))
        return store.border(f"{name}_likely", plausible(pairs, wide, share))

    by_key = Window.partitionBy("key")
    shared = (
        keys.withColumn("low", F.min("id").over(by_key))
        .withColumn("high", F.max("id").over(by_key))
        .filter("low < high")
    )
    shared = store.border("shared_keys", shared.select("key", "id", "low"))

    pairs = shared.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").filter(may_link("a", "b", share))
    pairs = store.border("pivot_pairs", pairs.select("a", "b").distinct())
    near = likely(pairs, "pivot")
    sets = store.border("pivot_sets", sets_of(_ids(near)))
    edges = verified(near, sets, share)
    edges = store.border("pivot_links", edges if known is None else edges.unionByName(known.select("a", "b")))
    found = components(edges, store, "pivot_classes")

    # Members outside a key's first class, against those of other classes.
    members = shared.select("key", "id").join(found, "id", "left")
    members = members.withColumn("component", F.coalesce("component", "id"))
    mixed = (
        members.withColumn("low", F.min("component").over(by_key))
        .withColumn("high", F.max("component").over(by_key))
        .filter("low < high")
        .select("key", "id", "component", "low")
    )
    mixed = store.border("open_keys", mixed.join(sketches.select("id", "n", "bits"), "id"))
    sides = [
        mixed.select(
            "key", *(F.col(c).alias(f"{c}_{name}") for c in ("id", "component", "low", "n", "bits"))
        )
        for name in ("a", "b")
    ]
    sides[1] = sides[1].filter("component_b <> low_b")
    other = "component_a <> component_b and (component_a = low_a or id_a < id_b)"
    every = sides[0].join(
        sides[1].withColumnRenamed("key", "key_b"),
        (F.col("key") == F.col("key_b")) & F.expr(other) & may_link("a", "b", share),
    )
    more = every.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
    more = store.border("open_pairs", more.join(pairs, ["a", "b"], "left_anti"))
    if more.isEmpty():
        return found
    more = likely(more, "open")
    if more.isEmpty():
        return found
    sets = store.border("open_sets", sets_of(_ids(more)))
    edges = store.border("links", edges.unionByName(verified(more, sets, share)))
    return components(edges, store, "classes")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
