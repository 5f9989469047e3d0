"""Language identification: held-out accuracy and rows without letters."""

import zlib

import numpy as np
import pytest

from anchorset.llm import langid
from anchorset.sources.stages import StageStore

ROWS = "doc_id bigint, text string, lang string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [found[i]["lang_pred"] == truth[i] for i in truth if found[i]["held_out"]]
    assert len(held) > 100 and np.mean(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_held_out_rows_teach_nothing(spark):
    """A language that only held-out rows have is never predicted, and their
    labels change nothing."""
    rows = [(i, ("alpha beta " if i % 2 else "xylo zwei ") * 4, "a" if i % 2 else "z") for i in range(80)]
    swapped = [(i, t, "other" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    a, b = ({r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(x, ROWS)).collect()} for x in (rows, swapped))
    assert a == b and set(a.values()) == {"a", "z"}


def test_kernel_is_the_share_of_common_ngrams():
    rows = np.zeros((2, 1 << langid.BITS), np.float32)
    langid.present(b"abcab", rows[0])
    langid.present(b"ABC", rows[1])
    # a b c, ab bc ca, abc bca cab against a b c, ab bc, abc.
    assert rows.sum(axis=1).tolist() == [9, 6] and (rows[0] * rows[1]).sum() == 6


def test_long_texts_in_blocks():
    text = ("abc déf " * 200_000).encode()
    whole, part = (np.zeros(1 << langid.BITS, np.uint8) for _ in range(2))
    langid.present(text, whole)
    langid.present(text[:64], part)
    assert (whole == part).all()


def test_odd_rows(spark, clashing):
    rows = [(i, ("der die das " if i % 2 else "le la les ") * 5, "de" if i % 2 else "fr") for i in range(40)]
    odd = [(100, None, "de"), (101, "", "fr"), (102, "123 !? 4_5", "de"), (103, "é", None), (1, rows[1][1], "de"), (None, "la les", "fr")]
    found = langid.identify(clashing(spark.createDataFrame(rows + odd, ROWS))).collect()
    assert len(found) == 46
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found}
    assert by_id[100] == by_id[101] == by_id[102] == ("und", 0.0)
    assert by_id[None][0] == "fr" and by_id[1][0] == "de" and by_id[103][0] in ("de", "fr")


@pytest.mark.parametrize("rows", [[], [(1, "some text", None), (2, None, "en")]])
def test_without_labels(spark, rows):
    found = langid.identify(spark.createDataFrame(rows, ROWS)).collect()
    assert len(found) == len(rows) and all(r["lang_pred"] == "und" for r in found)


def sampled(df, per_lang, tmp_path):
    store = StageStore(df.sparkSession, str(tmp_path))
    return store, store.border("sample", langid.training_rows(df, per_lang, store, "doc_id", "text", "lang"))


def test_sample_is_bounded(spark, tmp_path):
    rows = [(i, f"word{i} here", "en" if i % 3 else "de") for i in range(300)]
    _, sample = sampled(spark.createDataFrame(rows, ROWS), 10, tmp_path)
    assert sorted((r["lang"], r["place"]) for r in sample.collect()) == [(x, i) for x in ("de", "en") for i in range(1, 11)]


def test_repeated_rows_displace_nothing(spark, tmp_path):
    rows = [(i, f"wort{i} hier", "de") for i in range(125)] + [(200 + i, f"mot{i} ici", "fr") for i in range(125)]
    count = lambda some, at: sampled(spark.createDataFrame(some, ROWS), 400, at)[1].groupBy("lang").count().collect()
    plain = sorted(map(tuple, count(rows, tmp_path / "a")))
    assert sorted(map(tuple, count(rows + [rows[1]] * 5000, tmp_path / "b"))) == plain and min(n for _, n in plain) > 80


def plain_predictions(docs, per_lang=400):
    """The model and every prediction anew: dense kernel matrices, no Spark."""
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    slot = {r[0]: r[1] for r in spark.createDataFrame([(r[0],) for r in rows], "i bigint").select("i", F.pmod(F.xxhash64("i"), F.lit(1 << 40))).collect()}

    def grams(text):
        data = (text or "").encode()
        data = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
        row = np.zeros(1 << langid.BITS)
        for n in (1, 2, 3):
            for g in {data[i : i + n] for i in range(len(data) - n + 1)}:
                code = int.from_bytes(g, "big")
                row[((code + 1) * int(langid._FACTORS[n - 1]) % 2**64) >> (64 - langid.BITS)] = 1
        return row / max(1, np.sqrt(row.sum()))

    known = sorted({(lang, slot[i], i): t for i, t, lang in rows if lang and t is not None and zlib.crc32(str(i).encode()) % 5}.items())
    names = sorted({k[0] for k, _ in known})
    train = [x for n in names for x in [k for k in known if k[0][0] == n][:per_lang]]
    label = np.array([names.index(k[0]) for k, _ in train])
    place = np.concatenate([np.arange((label == i).sum()) for i in range(len(names))])
    x = np.array([grams(t) for _, t in train])
    marks = x[np.lexsort((label, place))[: langid.LANDMARKS]]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    features, weight = x @ marks.T @ root, 1 / np.bincount(label)[label]
    wanted = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    normal = (features * weight[:, None]).T @ features + langid.RIDGE * np.eye(features.shape[1])
    found = np.linalg.solve(normal, (features * weight[:, None]).T @ wanted)
    out = {}
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            out[i] = ("und", 0.0)
            continue
        power = np.exp(langid.SHARPNESS * np.clip(grams(t) @ marks.T @ root @ found, -9, 9))
        out[i] = (names[int(power.argmax())], float(power.max() / power.sum()))
    return out


def test_predictions_equal_a_plain_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain_predictions(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()}
    assert max(abs(got[i][1] - want[i][1]) for i in want) < 1e-3


def test_many_languages(spark, tmp_path):
    """Every language has landmarks, and what reaches the driver stays small."""
    rows = [(10_000 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{(i * 7 + j) % 50}" for j in range(30)), f"l{k:03}") for k in range(200) for i in range(12)]
    store, sample = sampled(spark.createDataFrame(rows, ROWS), 8, tmp_path)
    model = langid.learn(sample)
    assert len(model.languages) == 200 and model.landmarks.shape[1] == 400
    assert model.landmarks.nbytes + model.coefficients.nbytes < 40e6
    got = langid.identify(spark.createDataFrame(rows, ROWS), per_lang=8).collect()
    lang = {i: x for i, _, x in rows}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.95
