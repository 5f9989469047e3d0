"""The pipeline's stages, each against its operator's plain meaning."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from anchorset.llm import bpe

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of every stage, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        folder = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == [
        "quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_level_bpe"]
    assert all(df.columns == NAMES for df in stages[:-1])


def test_each_stage_only_drops_rows(spark, stages):
    before = ids(spark.read.parquet(f"{SF}/documents.parquet"))
    for df in stages:
        assert df.count() == len(ids(df)) and ids(df) <= before
        before = ids(df)
    assert len(before) > 100


def test_quality_keeps_good_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = ids(stages[0])
    good = {r["doc_id"] for r in labels.filter("quality = 1 and toxic = 0").collect()}
    assert len(good & kept) / len(good) > 0.9


def test_last_stage_encodes_what_is_left(stages):
    tokenizer = bpe.tokenizer(cp.RANKS, cp.public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in stages[-2].collect()}
    for r in stages[-1].collect():
        assert r["n_tokens"] == len(tokenizer.encode(texts[r["doc_id"]]))
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))


def table(spark, rows):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_line_dedup_stage(spark):
    block = " ".join(f"w{i}" for i in range(60))
    docs = table(spark, [(1, f"a b\n{block}"), (2, f"{block}\nown line"), (3, block), (4, ""), (5, None), (None, f"{block}\nz")])
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.drop_repeated_lines(spark, docs, SF).collect()}
    assert out == {1: (f"a b\n{block}", len(block) + 4), 2: ("own line", 8), 4: ("", 0), 5: (None, None), None: ("z", 1)}


def test_near_duplicate_stage(spark):
    words = [f"w{i}" for i in range(100)]
    near = " ".join([*words[:99], "other"])
    docs = table(spark, [(3, " ".join(words)), (7, near), (7, near), (8, "apart from these"), (None, near), (9, ""), (10, None), (3, " ".join(words))])
    out = sorted((r["doc_id"] or 0) for r in cp.drop_near_duplicates(spark, docs, SF).collect())
    assert out == [0, 3, 8, 9, 10]


def test_near_duplicate_stage_against_brute_force(spark):
    """Five-word Jaccard of 0.8 over all pairs, many of them between 0.8 and 0.9."""
    rng, texts = random.Random(6), {}
    for group in range(60):
        words = [f"g{group}w{j}" for j in range(rng.choice((6, 30, 60, 120, 250)))]
        texts[10 * group] = " ".join(words)
        for copy in range(1, 4):
            edited = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                edited[rng.randrange(len(words))] = f"n{rng.random()}"
            texts[10 * group + copy] = " ".join(edited)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    held = {}
    for i, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(i)
    both = Counter((a, b) for group in held.values() for a in group for b in group if a < b)
    label, between = {i: i for i in texts}, 0

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for (a, b), k in both.items():
        union = len(sets[a]) + len(sets[b]) - k
        between += 8 * union <= 10 * k < 9 * union
        if 10 * k >= 8 * union:
            low, high = sorted((top(a), top(b)))
            label[high] = low
    assert between > 20
    docs = table(spark, list(texts.items()))
    assert ids(cp.drop_near_duplicates(spark, docs, SF)) == {i for i in texts if label[i] == i}


def test_decontamination_stage(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    docs = table(spark, [(1, f"before {item} after"), (2, "clean words only here now"), (None, item), (None, "clean too"), (3, None)])
    out = cp.drop_contaminated(spark, docs, SF)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [
        (0, "clean too"), (2, "clean words only here now"), (3, "")]


def test_empty_documents(spark, tmp_path):
    docs = table(spark, [])
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.agg(F.count(F.lit(1))).first()[0] == 0
