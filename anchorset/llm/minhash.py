"""MinHash document fingerprints and near-duplicate classes.

A document is its set of distinct ``WIDTH``-word shingles (64-bit hashes, words
split at ASCII white space, A-Z lower-cased). ``PERMUTATIONS`` universal hashes
(odd multiplier, addend, upper bits) permute the shingles of a whole slice at
once in numpy; the least value of each is the signature. The fingerprint is the
hexadecimal form of the values' upper 16 bits, and the likeness of two
fingerprints the share of equal places, an estimate of the Jaccard similarity.

For near-duplicate classes, signatures are cut into ``BANDS`` bands that are
joined in Spark; pairs that share a band are verified by the exact Jaccard
similarity of their sets.

Rows: null, empty and blank texts have no shingles and the fingerprint of all
ones; two of these are alike (1.0). A text with fewer words than ``WIDTH`` is one
shingle. In ``neighbour_fingerprints`` rows are ordered by descending id, null
ids last, then by text; repeated rows follow one another, and the last row's
next document is the first. A single row is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stages import StageStore
from .linking import WIDE, link_classes, parity_bits, wide_sketches
from .text import SLICE_BYTES, clash_free, distinct, kind_of, list_array, mix, shingles, slices, stream, utf8, words

WIDTH = 5
PERMUTATIONS = 128
BANDS = 32
SHARE = (8, 10)

_FACTORS = stream(PERMUTATIONS, 101) | np.uint64(1)
_ADDENDS = stream(PERMUTATIONS, 102)
_SEEDS = stream(2, 103)


def shingle_hashes(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (repeats included) and their rows, ordered by row."""
    data, offsets = utf8(column)
    hashes, row = words(data, offsets)
    return shingles(hashes, row, len(offsets) - 1, width)


def signatures(values: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """The least of each permuted hash per row (rows x permutations, 32 bits)."""
    out = np.full((n_rows, PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    if len(values) == 0:
        return out
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    present = row[starts]
    for j in range(PERMUTATIONS):
        permuted = ((values * _FACTORS[j] + _ADDENDS[j]) >> np.uint64(32)).astype(np.uint32)
        out[present, j] = np.minimum.reduceat(permuted, starts)
    return out


def fingerprints(signature: np.ndarray) -> list[str]:
    """Four hexadecimal digits per permutation."""
    short = (signature >> np.uint32(16)).astype(">u2")
    text, size = short.tobytes().hex(), 4 * signature.shape[1]
    return [text[i : i + size] for i in range(0, len(text), size)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of places in which two fingerprints agree."""
    return ((a >> np.uint32(16)) == (b >> np.uint32(16))).mean(axis=1)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for every row."""
    rows = clash_free(docs, id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, text_col):
                found = fingerprints(signatures(*shingle_hashes(part.column(1)), part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], [id_col, "fingerprint"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


# -- near-duplicate classes --------------------------------------------------


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, set_a, set_b, keys, bits) with one key per band."""
    kind = kind_of(docs, id_col)
    rows_per_band = PERMUTATIONS // BANDS

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, text_col):
                n_rows = part.num_rows
                values, row = distinct(*shingle_hashes(part.column(1), width))
                number = np.bincount(row, minlength=n_rows)
                starts = np.concatenate([[0], np.cumsum(number)[:-1]])
                digests = []
                for seed in _SEEDS:
                    sums = np.zeros(n_rows, np.uint64)
                    if len(values):
                        sums[number > 0] = np.add.reduceat(mix(values ^ seed), starts[number > 0])
                    digests.append(pa.array(sums.view(np.int64)))
                bands = signatures(values, row, n_rows).astype(np.uint64).reshape(n_rows, BANDS, rows_per_band)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n_rows, BANDS))
                for j in range(rows_per_band):
                    key = mix(key * _FACTORS[0] + bands[:, :, j])
                keys = list_array(key.reshape(-1), np.repeat(np.arange(n_rows), BANDS), n_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(number, pa.int64()), *digests, keys, parity_bits(values, row, n_rows)],
                    [id_col, "n", "set_a", "set_b", "keys", "bits"],
                )

    schema = "n bigint, set_a bigint, set_b bigint, keys array<bigint>, bits array<bigint>"
    return docs.mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, wide: bool = False) -> DataFrame:
    kind = kind_of(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, text_col):
                values, row = distinct(*shingle_hashes(part.column(1), width))
                sets = pa.RecordBatch.from_arrays([part.column(0), list_array(values, row, part.num_rows)], ["id", "values"])
                yield wide_sketches(sets) if wide else sets

    return docs.mapInArrow(run, f"id {kind}, {WIDE if wide else 'values array<bigint>'}")


def near_duplicate_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    share: tuple[int, int] = SHARE,
) -> DataFrame:
    """(id, class_id) for every row: the smallest id among its near duplicates,
    linked directly or through others. Texts with equal sets are one node; empty
    ones are linked with nothing. An id that is repeated counts as one document
    with the links of all its texts; a null id keeps a null class."""
    store = StageStore.for_session(docs.sparkSession)
    rows = clash_free(docs, id_col, text_col)
    signed = store.border("signatures", _signed(rows, id_col, text_col, width))
    known = signed.filter((F.col("n") > 0) & F.col(id_col).isNotNull())
    nodes = known.groupBy("set_a", "set_b", "n").agg(
        F.min_by(F.struct(F.col(id_col).alias("id"), "keys", "bits"), id_col).alias("first")
    )
    nodes = store.border("nodes", nodes.select("set_a", "set_b", "n", "first.*"))

    def sets_of(ids: DataFrame, wide: bool = False) -> DataFrame:
        some = rows.join(ids.withColumnRenamed("id", id_col), id_col, "left_semi")
        return _sets(some.select(id_col, text_col), id_col, text_col, width, wide)

    keys = nodes.select(F.explode("keys").alias("key"), "id")
    member = known.select(id_col, "set_a", "set_b", "n").join(
        nodes.select("set_a", "set_b", "n", F.col("id").alias("node")), ["set_a", "set_b", "n"]
    )
    several = member.groupBy(id_col).agg(F.min("node").alias("a"), F.max("node").alias("_top")).filter("a < _top")
    ties = member.join(several, id_col).filter("node <> a").select("a", F.col("node").alias("b"))
    linked = link_classes(keys, nodes.select("id", "n", "bits"), sets_of, share, store, ties)
    found = member.join(linked.withColumnRenamed("id", "node"), "node", "left")
    least = found.groupBy(id_col).agg(F.min(F.coalesce("component", "node")).alias("class_id"))
    classed = signed.select(id_col).join(least, id_col, "left")
    return classed.select(id_col, F.coalesce("class_id", id_col).alias("class_id"))


# -- fingerprints of documents and edited documents --------------------------


def _bucket(column: Column, bounds: list, low: int = 0, high: int | None = None) -> Column:
    """How many of the sorted bounds lie above the value, as a tree of
    comparisons; descending values have ascending buckets."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(len(bounds) - low)
    middle = (low + high) // 2
    return F.when(column >= F.lit(bounds[middle]), _bucket(column, bounds, middle + 1, high)).otherwise(
        _bucket(column, bounds, low, middle)
    )


def _bounds(ids: DataFrame, id_col: str, parts: int) -> list:
    """Values that cut the known ids into about equal ranges, ascending."""
    if parts < 2:
        return []
    if isinstance(ids.schema[0].dataType, T.NumericType):
        shares = [i / parts for i in range(1, parts)]
        return sorted(set(ids.agg(F.percentile_approx(id_col, shares, 20 * parts)).first()[0] or []))
    # Quantiles are for numbers only; a range partitioning of the ids orders any.
    ranges = ids.filter(F.col(id_col).isNotNull()).repartitionByRange(parts, id_col)
    least = ranges.groupBy(F.spark_partition_id().alias("range")).agg(F.min(id_col).alias("least")).collect()
    return sorted({r["least"] for r in least})[1:]


def in_order_with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, id, text, guest): rows dealt by ranges of descending id and
    sorted within tasks. Each bucket ends with a guest row, a copy of the row
    that follows it in the whole order, so a task sees each row's successor."""
    spark = docs.sparkSession
    rows = docs.withColumn(text_col, F.coalesce(text_col, F.lit("")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(docs.select(id_col), id_col, parts)
    bucket = F.when(F.col(id_col).isNull(), F.lit(len(bounds) + 1)).otherwise(_bucket(F.col(id_col), bounds))
    rows = rows.withColumn("bucket", bucket)
    # One row per range reaches the driver.
    heads = {r["bucket"]: r["head"] for r in rows.groupBy("bucket").agg(F.max(id_col).alias("head")).collect()}
    if not heads:
        return rows.withColumn("guest", F.lit(False)).select("bucket", id_col, text_col, "guest")
    order = sorted(heads)
    before = dict(zip(order[1:] + order[:1], order, strict=True))
    first = rows.filter(F.col(id_col).isin([h for h in heads.values() if h is not None]) | F.col(id_col).isNull())
    first = first.groupBy("bucket", id_col).agg(F.min(text_col).alias(text_col))
    target = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    guests = first.withColumn("bucket", target[F.col("bucket")]).withColumn("guest", F.lit(True))
    every = rows.withColumn("guest", F.lit(False)).unionByName(guests).select("bucket", id_col, text_col, "guest")
    return every.repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "guest", F.desc_nulls_last(id_col), text_col
    )


def _with_successors(batches: Iterator[pa.RecordBatch], limit: int):
    """Runs of consecutive rows of a bucket; the last row of a run is only the
    successor of the one before and opens the next run."""
    held, size, bucket = [], 0, None
    for batch in batches:
        for b, doc_id, text, guest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if b != bucket:
                held, size, bucket = [], 0, b
            held.append((doc_id, text))
            size += len(text)
            if guest or (size > limit and len(held) > 1):
                yield held
                held, size = held[-1:], len(text)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the next text's
    first ones, or all of them."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_chars, the edited text's SHA-256, both fingerprints, and the
    likeness to the edited text and to the next document."""
    rows = clash_free(docs, id_col, text_col)
    kind = rows.schema[0].dataType
    id_type = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]):
        for held in _with_successors(batches, SLICE_BYTES):
            texts = [text for _, text in held]
            changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            own = signatures(*shingle_hashes(pa.array(texts, pa.large_string())), len(texts))
            new = signatures(*shingle_hashes(pa.array(changed, pa.large_string())), len(changed))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_id for doc_id, _ in held[:-1]], id_type),
                    pa.array([len(text) for text in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(text.encode()).hexdigest() for text in changed], pa.string()),
                    pa.array(fingerprints(own[:-1]), pa.string()),
                    pa.array(fingerprints(new), pa.string()),
                    pa.array(likeness(own[:-1], new)),
                    pa.array(likeness(own[:-1], own[1:])),
                ],
                names,
            )

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = (
        f"`{id_col}` {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double"
    )
    return in_order_with_next(rows, id_col, text_col).mapInArrow(run, schema)
