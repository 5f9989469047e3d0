"""Language identification with a string kernel.

The kernel of two texts is the number of hashed byte n-grams (n = 1 to 3, ASCII
lower-cased) present in both, divided by the geometric mean of their numbers of
n-grams: a blended-spectrum presence kernel. ``LANDMARKS`` texts, dealt evenly to
the languages and two of each at least, span the Nyström feature space, in which
one ridge regression per language is fitted. Scoring a batch takes two matrix
products: presence times landmarks, kernel values times coefficients.

Learning uses at most ``SAMPLE_PER_LANG`` labelled texts of each language (those
with the smallest id hash) and skips every held-out document: crc32 of the id as
text modulo 5 is 0. A null id counts as empty text there. The normal equations
are summed up in tasks; the driver gets the landmarks and ``SUMS`` partial sums.
Every row is predicted, from its whole text only.

Rows: a null text and a text without any letter get ``und`` with score 0.
Repeated rows get repeated results; in learning, an id counts once per language,
with the least of its texts. Ties go to the language that sorts first. Without
any labelled text every row gets ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import StageStore
from .text import _FOLD, clash_free, slices, stream

BITS = 14
SAMPLE_PER_LANG = 400
LANDMARKS = 128
RIDGE = 1e-2
SHARPNESS = 4.0
BATCH = 64
SUMS = 16

_LETTER = re.compile(r"[^\W\d_]")
_FACTORS = stream(3, 41) | np.uint64(1)


def present(text: bytes, out: np.ndarray) -> None:
    """Set the text's n-gram buckets in a row of zeros to one; long texts are
    taken in overlapping blocks."""
    block = 1 << 20
    for at in range(0, max(1, len(text)), block):
        data = _FOLD[np.frombuffer(text, np.uint8, min(len(text) - at, block + 2), at)].astype(np.uint64)
        code = np.zeros(len(data), np.uint64)
        for n in range(min(3, len(data))):
            code = (code[: len(data) - n] << np.uint64(8)) | data[n:]
            out[((code + np.uint64(1)) * _FACTORS[n] >> np.uint64(64 - BITS)).astype(np.int64)] = 1


@dataclass
class Model:
    """Languages, landmark presence (buckets x landmarks, scaled), coefficients."""

    languages: list[str]
    landmarks: np.ndarray
    coefficients: np.ndarray

    def scores(self, presence: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))
        return (presence @ self.landmarks / norm) @ self.coefficients


@dataclass
class Space:
    """The Nyström space of some landmarks: scaled presence rows, and what turns
    kernel values with them into features."""

    basis: np.ndarray
    root: np.ndarray

    def features(self, presence: np.ndarray) -> np.ndarray:
        scaled = presence / np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))
        return (scaled @ self.basis.T).astype(np.float64) @ self.root


def space_of(presence: np.ndarray) -> Space:
    basis = presence / np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    return Space(basis.astype(np.float32), vectors[:, kept] / np.sqrt(values[kept]))


def equations(space: Space, presence: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides of the normal equations for some rows: features by features,
    and features by languages (1 for the row's own, -1 for others)."""
    features = space.features(presence)
    wanted = np.where(label[:, None] == np.arange(len(weight)), 1.0, -1.0)
    heavy = features * weight[label][:, None]
    return features.T @ heavy, heavy.T @ wanted


def solve(names: list[str], space: Space, left: np.ndarray, right: np.ndarray, ridge: float = RIDGE) -> Model:
    solved = np.linalg.solve(left + ridge * np.eye(len(left)), right)
    return Model(names, np.ascontiguousarray(space.basis.T, np.float32), (space.root @ solved).astype(np.float32))


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _texts(column: pa.Array) -> list[str]:
    return [text or "" for text in column.to_pylist()]


def _unpack(bits: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(map(bytes, bits)), np.uint8).reshape(len(bits), (1 << BITS) // 8)
    return np.unpackbits(packed, axis=1).astype(np.float32)


def training_rows(
    docs: DataFrame, per_lang: int, store: StageStore, id_col: str, text_col: str, lang_col: str
) -> DataFrame:
    """(id, lang, bits, place): the bounded sample as packed presence rows, with
    the place of each in its language, from 1."""
    rows = clash_free(docs, id_col, text_col, lang_col)
    usable = rows.filter(~held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    # Ids count once, however often their rows are repeated.
    span = 1 << 40
    slot = F.pmod(F.xxhash64(id_col), F.lit(span)).alias("_slot")
    known = store.border("labelled", usable.select(id_col, lang_col).distinct())
    # The first by hash. Hashes far behind the place that per_lang ids reach are
    # dropped before ids are ranked, so a common language sends few rows.
    number = store.border("languages", known.groupBy(lang_col).agg(F.count(F.lit(1)).alias("_number")))
    near = known.select(id_col, lang_col, slot).join(number, lang_col)
    near = near.filter(F.col("_slot") < F.lit(span) * (4 * per_lang + 100) / F.col("_number"))
    order = Window.partitionBy(lang_col).orderBy("_slot", id_col)
    first = near.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= per_lang)
    first = store.border("first_ids", first.select(id_col, lang_col, "_place"))

    def pack(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, text_col):
                bits = []
                for text in _texts(part.column(2)):
                    row = np.zeros(1 << BITS, np.uint8)
                    present(text.encode("utf-8"), row)
                    bits.append(np.packbits(row).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(bits, pa.binary()), part.column(3)], ["id", "lang", "bits", "place"]
                )

    kind = rows.schema[0].dataType.simpleString()
    # A null id is an id like any other here.
    same = usable[id_col].eqNullSafe(first[id_col]) & (usable[lang_col] == first[lang_col])
    texts = usable.join(first, same).select(usable[id_col], usable[lang_col], usable[text_col], first["_place"])
    one = texts.groupBy(id_col, lang_col, "_place").agg(F.min(text_col).alias(text_col))
    return one.select(id_col, lang_col, text_col, "_place").mapInArrow(pack, f"id {kind}, lang string, bits binary, place int")


def learn(sample: DataFrame, landmarks: int = LANDMARKS) -> Model | None:
    """The model of a stored sample; None without labelled texts."""
    counted = sorted(tuple(r) for r in sample.groupBy("lang").count().collect())
    if not counted:
        return None
    names, weight = [n for n, _ in counted], np.array([1 / n for _, n in counted])
    # Landmarks are taken from the languages in turn, two of each at least.
    landmarks, turns = max(landmarks, 2 * len(names)), 2
    while sum(min(n, turns) for _, n in counted) < min(landmarks, sum(n for _, n in counted)):
        turns += 1
    chosen = sample.filter(F.col("place") <= turns).select("place", "lang", "bits").collect()
    chosen = sorted(chosen, key=lambda r: (r["place"], r["lang"]))[:landmarks]
    space = space_of(_unpack([r["bits"] for r in chosen]))
    shared = sample.sparkSession.sparkContext.broadcast((names, weight, space))

    def add(batches: Iterator[pa.RecordBatch]):
        names, weight, space = shared.value
        size = space.root.shape[1]
        left, right = np.zeros((size, size)), np.zeros((size, len(names)))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                label = np.searchsorted(names, part.column(0).to_pylist())
                a, b = equations(space, _unpack(part.column(1).to_pylist()), label, weight)
                left, right = left + a, right + b
        sums = [pa.array([x.tobytes()], pa.binary()) for x in (left, right)]
        yield pa.RecordBatch.from_arrays(sums, ["left", "right"])

    # Languages weigh the same, whatever their number of texts.
    dealt = sample.repartition(SUMS, "id").sortWithinPartitions("id", "lang").select("lang", "bits")
    sums = dealt.mapInArrow(add, "left binary, right binary").collect()
    size = space.root.shape[1]
    left = sum(np.frombuffer(r["left"]).reshape(size, size) for r in sums)
    right = sum(np.frombuffer(r["right"]).reshape(size, len(names)) for r in sums)
    return solve(names, space, left, right)


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = SAMPLE_PER_LANG,
) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row."""
    store = StageStore.for_session(docs.sparkSession)
    sample = store.border("sample", training_rows(docs, per_lang, store, id_col, text_col, lang_col))
    model = learn(sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]):
        model, rows = shared.value, np.zeros((BATCH, 1 << BITS), np.float32)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = _texts(part.column(1))
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
                known = [i for i, text in enumerate(texts) if model and _LETTER.search(text)]
                for at in range(0, len(known), BATCH):
                    some = known[at : at + BATCH]
                    rows[: len(some)] = 0
                    for row, i in enumerate(some):
                        present(texts[i].encode("utf-8"), rows[row])
                    power = np.exp(SHARPNESS * np.clip(model.scores(rows[: len(some)]).astype(np.float64), -9, 9))
                    best = power.argmax(axis=1)
                    scores[some] = power[np.arange(len(some)), best] / power.sum(axis=1)
                    for i, choice in zip(some, best, strict=True):
                        langs[i] = model.languages[choice]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(langs), pa.array(scores)],
                    [id_col, "held_out", "lang_pred", "score"],
                )

    rows = clash_free(docs, id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()
    rows = rows.withColumn("held_out", held_out(id_col))
    return rows.mapInArrow(predict, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
