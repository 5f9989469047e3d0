"""Quality classifier: importance resampling with hashed n-gram models.

Words and runs of punctuation are hashed into ``2**BITS`` buckets; one more
bucket counts the pairs in which a word follows itself. Two generative models are
counted over whole texts: the target model over documents labelled good (quality
1, not toxic), the raw model over all documents. A document's weight is the log
ratio of both models summed over its n-grams and divided by the square root of
their number. A bucket only counts as evidence where the target count is at most
``LEAST_RATIO`` of what the raw model expects and lies ``SIGMAS`` standard errors
below it; elsewhere the target model backs off to the raw one. Ratios above one
are cut to one, so long runs of common words do not outweigh bad ones.

Documents are then drawn without replacement by Gumbel top-k: the key is
weight / TEMPERATURE + Gumbel noise, and k is the number of documents whose
weight reaches the value that best separates the labelled documents. Noise
depends on the id and the text only, so repeated rows share their fate, and all
rows that tie at the k-th key are kept.

Rows: null and empty texts have no n-grams and weight 0. Labels with null id are
ignored; null quality or toxic is not good. A document labelled several times is
good if all its labels are. Without good or without other labels nothing can be
told apart: all weights count, and every row is kept.

``TARGET_ROWS`` bounds the labelled rows that the target model is fitted on (a
hash sample beyond that); it bounds the only broadcast. The raw model, weights,
threshold and top-k cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stages import StageStore
from .text import _FOLD, _SPACE, clash_free, place_of, slices, span_hashes, utf8

BITS = 20
TARGET_ROWS = 1 << 18
SIGMAS = 3.5
LEAST_RATIO = 0.4
PRIOR = 0.5
TEMPERATURE = 0.01
SEED = 7
BUCKETS = (1 << BITS) + 1
_BINS = 2048

# Byte classes; 0 white space, 1 letters, digits and bytes beyond ASCII, 2 the rest.
_CLASS = np.ones(256, np.uint8)
_CLASS[:128] = [0 if _SPACE[b] else 1 if chr(b).isalnum() else 2 for b in range(128)]


def _ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word, and of every word that repeats the one
    before it."""
    data, offsets = utf8(column)
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    begins = np.ones(len(data), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    inside = kind[starts] > 0
    starts, ends = starts[inside], ends[inside]
    row = np.searchsorted(offsets, starts, "right") - 1
    word = span_hashes(_FOLD[data], starts, ends)
    again = row[1:][(word[1:] == word[:-1]) & (row[1:] == row[:-1])]
    buckets = np.concatenate([(word >> np.uint64(64 - BITS)).astype(np.int64), np.full(len(again), 1 << BITS)])
    return buckets, np.concatenate([row, again])


def good_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, good) with one row per labelled document."""
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(1)) == 0)
    rows = clash_free(labels, id_col, "quality", "toxic").filter(F.col(id_col).isNotNull())
    return rows.groupBy(id_col).agg(F.min(good.cast("int")).alias("good"))


def ngram_models(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of both models per bucket. ``targets`` holds the ids of the
    target documents and is broadcast."""
    flagged = clash_free(docs, id_col, text_col).join(
        F.broadcast(targets.select(id_col, F.lit(True).alias("_target"))), id_col, "left"
    )

    def count(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, text_col):
                buckets, row = _ngrams(part.column(0))
                counts[0] += np.bincount(buckets, minlength=BUCKETS)
                chosen = part.column(1).fill_null(False).to_numpy(zero_copy_only=False)
                counts[1] += np.bincount(buckets[chosen[row]], minlength=BUCKETS)
        seen = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, *counts[:, seen])], ["bucket", "raw", "target"])

    counted = flagged.select(text_col, "_target").mapInArrow(count, "bucket bigint, raw bigint, target bigint")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bucket = rows.column("bucket").to_numpy()
    raw[bucket], target[bucket] = rows.column("raw").to_numpy(), rows.column("target").to_numpy()
    return log_ratio(raw, target)


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The evidence of every bucket against a document, at most 0."""
    if target.sum() == 0:
        return np.zeros(len(raw), np.float32)
    expected = raw * (target.sum() / raw.sum())
    ratio = (target + PRIOR) / (expected + PRIOR)
    clear = (expected - target >= SIGMAS * np.sqrt(expected + 1)) & (ratio <= LEAST_RATIO)
    return np.where(clear, np.log(ratio), 0).astype(np.float32)


def gumbel(seed: int, *columns: str):
    """Standard Gumbel noise from a hash of the row."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def _weigh(texts: pa.Array, ratio: np.ndarray) -> np.ndarray:
    buckets, row = _ngrams(texts)
    total = np.bincount(row, weights=ratio[buckets], minlength=len(texts))
    number = np.bincount(row, minlength=len(texts))
    return total / np.sqrt(np.maximum(number, 1))


def importance_weights(
    docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, weight, Gumbel noise) for every row."""
    rows = clash_free(docs, id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def weigh(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, text_col):
                weight = _weigh(part.column(1), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(weight), part.column(2)], [id_col, "weight", "gumbel"]
                )

    noise = gumbel(SEED, id_col, text_col).alias("gumbel")
    return rows.select(id_col, text_col, noise).mapInArrow(weigh, f"`{id_col}` {kind}, weight double, gumbel double")


def separating_weight(weights: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> float | None:
    """The weight that best separates labelled documents by balanced accuracy,
    from a histogram of bounded size; None if either kind is missing."""
    step = 1 / 64
    bin_ = F.greatest(F.lit(-_BINS), F.least(F.lit(_BINS), F.floor(F.col("weight") / step))).alias("bin")
    rows = weights.select(id_col, "weight").join(good_ids(labels, id_col), id_col)
    counts = rows.groupBy(bin_).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("other")).toPandas()
    counts = counts.sort_values("bin", ascending=False)
    if counts.empty or not counts["good"].sum() or not counts["other"].sum():
        return None
    kept_good = counts["good"].cumsum() / counts["good"].sum()
    kept_other = counts["other"].cumsum() / counts["other"].sum()
    return float(counts["bin"].iloc[int(np.argmax((kept_good - kept_other).to_numpy()))]) * step


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value (1 <= k <= rows) by narrowing histograms;
    the driver sees at most ``_BINS`` counts a round."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high and (width := (high - low) / _BINS) > 0:
        inside = rows.filter(F.col(column).between(low, high))
        bin_ = F.least(F.lit(_BINS - 1), F.floor((F.col(column) - low) / width).cast("int")).alias("bin")
        counts = inside.groupBy(bin_).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        found: pd.DataFrame = counts.toPandas().sort_values("bin", ascending=False)
        passed = above + found["n"].cumsum().to_numpy()
        at = int(np.searchsorted(passed, k))
        above = int(passed[at - 1]) if at else above
        low, high = float(found["low"].iloc[at]), float(found["high"].iloc[at])
    return float(low)


class _Draw:
    """What both outputs need: the model, the weights and the least key drawn."""

    def __init__(self, docs, labels, id_col, text_col, target_rows, k):
        store = StageStore.for_session(docs.sparkSession)
        targets = good_ids(labels, id_col).filter("good = 1").select(id_col)
        share = target_rows / max(1, targets.count())
        if share < 1:
            slot = F.pmod(F.xxhash64(F.lit(SEED), id_col), F.lit(1 << 20))
            targets = targets.filter(slot < int(share * (1 << 20)))
        self.ratio = ngram_models(docs, targets, id_col, text_col)
        self.weights = store.border("weights", importance_weights(docs, self.ratio, id_col, text_col))
        total = self.weights.count()
        if k is None:
            least = separating_weight(self.weights, labels, id_col)
            k = total if least is None else self.weights.filter(F.col("weight") >= least).count()
        key = (F.col("weight") / TEMPERATURE + F.col("gumbel")).alias("gumbel_key")
        self.keyed = self.weights.select(id_col, "weight", key)
        drawn = min(k, total)
        self.least_key = kth_largest(self.keyed, "gumbel_key", drawn) if drawn > 0 else float("inf")


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_rows: int = TARGET_ROWS,
    k: int | None = None,
) -> DataFrame:
    """(id, weight, gumbel_key, keep) for every row; ``k`` overrides the number
    of rows that are drawn."""
    draw = _Draw(docs, labels, id_col, text_col, target_rows, k)
    return draw.keyed.withColumn("keep", F.col("gumbel_key") >= draw.least_key)


def drawn_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_rows: int = TARGET_ROWS,
    k: int | None = None,
) -> DataFrame:
    """The rows that are drawn, with all their columns; weights are computed
    once more, so that no text has to be shuffled."""
    draw = _Draw(docs, labels, id_col, text_col, target_rows, k)
    shared, least_key, columns = docs.sparkSession.sparkContext.broadcast(draw.ratio), draw.least_key, len(docs.columns)
    places = [f"_{i}" for i in range(columns)]
    where, whose = (place_of(docs, c) for c in (text_col, id_col))

    def choose(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, places[where]):
                weight = _weigh(part.column(where), shared.value)
                key = weight / TEMPERATURE + part.column(columns).to_numpy(zero_copy_only=False)
                yield part.filter(pa.array(key >= least_key)).select(places)

    # Names that clash or need quoting do not pass through a schema string.
    plain = docs.toDF(*places)
    plain = plain.withColumn("gumbel", gumbel(SEED, places[whose], places[where]))
    schema = T.StructType(plain.schema.fields[:-1])
    return plain.mapInArrow(choose, schema).toDF(*docs.columns)
