"""Dictionaries of texts, tie audits, bounded scans, sketches and bucketed stages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from anchorset.functions.patterns import like, similar
from anchorset.operators import dictionary as di
from anchorset.operators import sketches as sk
from anchorset.operators import ties
from anchorset.operators.bounds import within_bounds
from anchorset.plans import bindings, clinical
from anchorset.plans import event_orders as eo
from anchorset.sources.stages import StageStore

RULES = {"a": like("%red%"), "b": similar("(blue|new) %"), "c": like("Red", lower=False), "d": like("%x%", none_of=("%y%",))}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- dictionaries ---


def texts(kinds, n, seed=1):
    rng = random.Random(seed)
    words = ["red", "Red", "blue one", "NEW two", "x", "xy", "", None, "tired", "reD x"]
    some = words + [f"word {i}" for i in range(kinds)]
    return [(rng.randint(1, 40), rng.choice(some)) for _ in range(n)]


@pytest.mark.parametrize("share", [0.0, 0.2, 1.0])
def test_dictionary_gives_the_rules_own_flags(spark, tmp_path, share):
    df = spark.createDataFrame(texts(30, 800), "k int, t string")
    store = StageStore(spark, str(tmp_path))
    got = di.flags_by_dictionary(df, "k", "t", RULES, store, share)
    hits = [F.max(F.when(r.matches("t"), 1).otherwise(0)).alias(n) for n, r in RULES.items()]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.groupBy("k").agg(*hits).collect()))


def test_more_rules_than_bits(spark, tmp_path):
    rules = {f"r{i}": like(f"%word {i}") for i in range(150)}
    df = spark.createDataFrame([(i % 7, f"a word {i % 150}") for i in range(2000)], "k int, t string")
    got = di.flags_by_dictionary(df, "k", "t", rules, StageStore(spark, str(tmp_path))).collect()
    held = {k: {i % 150 for i in range(2000) if i % 7 == k} for k in range(7)}
    assert {r["k"]: {i for i in range(150) if r[f"r{i}"]} for r in got} == held


def test_rules_run_on_distinct_texts(spark, tmp_path):
    """The stored dictionary is made from distinct texts, and nothing behind it
    tests a text again; mostly distinct texts get no dictionary."""
    store, seen = StageStore(spark, str(tmp_path)), []
    border = store.border
    store.border = lambda name, df: seen.append(plan(df)) or border(name, df)
    df = spark.createDataFrame(texts(30, 3000), "k int, t string")
    marked = di.with_dictionary(df, "t", RULES, store)
    assert len(seen) == 1 and seen[0].index("Contains") < seen[0].index("HashAggregate")
    assert "Contains" not in plan(marked) and "RLike" not in plan(marked)
    assert spark.read.parquet(f"{tmp_path}/dictionary").count() <= 10  # texts without a match are left out
    distinct = spark.createDataFrame([(i, f"red {i}") for i in range(300)], "k int, t string")
    assert "Contains" in plan(di.with_dictionary(distinct, "t", RULES, store)) and len(seen) == 1


def test_frequent_texts_are_split(no_broadcast, tmp_path):
    no_broadcast.conf.set("spark.anchorset.hotRows", "50")
    try:
        df = no_broadcast.createDataFrame([(i, "red") for i in range(400)] + [(i, "x") for i in range(30)], "k int, t string")
        got = di.with_dictionary(df, "t", RULES, StageStore(no_broadcast, str(tmp_path)))
        assert "_hot_parts" in plan(got)
        assert sorted(r["_rules_0"] for r in got.collect()) == [1] * 400 + [8] * 30
    finally:
        no_broadcast.conf.unset("spark.anchorset.hotRows")


# --- ties ---


def test_open_picks(spark):
    rows = [(1, 5, 0, "a"), (1, 5, 0, "b"), (1, 4, 0, "c"),  # the last is open
            (2, 5, 0, "a"), (2, 5, 0, "a"), (2, 1, 0, "b"), (2, 1, 0, "c"),  # equal rows; the first is open
            (3, 7, 1, "a"), (3, 7, 2, "b"), (4, None, 0, "a"), (4, None, 0, "b"), (5, 1, 0, None), (5, 1, 0, "x")]
    df = spark.createDataFrame(rows, "g int, t int, tie int, v string")
    pick = lambda order, latest=True: sorted(tuple(r) for r in ties.open_picks(df, "g", order, "v", latest).collect())
    assert pick("t") == [(1, 5, 2), (3, 7, 2), (5, 1, 2)]
    assert pick(["t", "tie"]) == [(1, 5, 0, 2), (5, 1, 0, 2)]
    assert pick("t", latest=False) == [(2, 1, 2), (3, 7, 2), (5, 1, 2)]
    assert "Window" not in plan(ties.open_picks(df, "g", "t", "v"))


# --- bounded scans ---


def scanned_rows(df) -> int:
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size()) if "Scan parquet" in leaves.apply(i).nodeName()]
    return sum(s.metrics().apply("numOutputRows").value() for s in scans)


def test_bounds_reach_the_scan_and_skip_row_groups(spark, tmp_path):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        facts = spark.range(100_000).selectExpr("id % 50 as k", "id as t").repartitionByRange(20, "t").sortWithinPartitions("t")
        facts.write.parquet(f"{tmp_path}/facts")
        index = spark.createDataFrame([(1, 40_000), (2, 41_000), (3, None)], "k long, t0 long")
        whole = spark.read.parquet(f"{tmp_path}/facts")
        cut = within_bounds(whole, "t", index, F.col("t0") - 500, "t0")
        join = lambda df: df.join(F.broadcast(index), "k").filter("t <= t0 and t >= t0 - 500")
        assert "GreaterThanOrEqual(t,39500)" in plan(cut) and "LessThanOrEqual(t,41000)" in plan(cut)
        assert sorted(map(tuple, join(cut).collect())) == sorted(map(tuple, join(whole).collect()))
        assert scanned_rows(join(whole)) == 100_000 and scanned_rows(join(cut)) <= 15_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_bounds_of_an_empty_index(spark):
    facts = spark.createDataFrame([(1, 2), (1, None)], "k int, t int")
    none = spark.createDataFrame([], "k int, t0 int")
    assert within_bounds(facts, "t", none, low="t0").count() == 0
    assert within_bounds(facts, "t", none).count() == 2


def test_the_look_back_query_is_bounded(spark):
    text = plan(eo.lookback_bounded(spark, "/root/testdata/sf0.01"))
    assert "GreaterThanOrEqual(ts,20" in text and re.search(r"ts#\d+ <= 20\d\d-", text)


# --- sketches ---


def test_sketches_are_exact_up_to_their_size_and_close_beyond(spark):
    rows = spark.range(200_000).selectExpr("id % 60000 as k", "id % 3 as day", "id % 24 as hour").unionByName(
        spark.createDataFrame([(None, 0, 0)], "k long, day long, hour long")
    )
    few = sk.coverage(sk.sketched(rows.filter("k < 9000"), "k", "day"), "day")
    assert {r["day"]: r["subjects"] for r in few.collect()} == {0: 3000, 1: 3000, 2: 3000}
    hourly = sk.sketched(rows, "k", "day", "hour")
    for r in sk.coverage(sk.merged(hourly, "day"), "day").collect():
        assert abs(r["subjects"] - 20_000) < 4 * 20_000 / 2**7  # four standard errors
    assert sk.coverage(sk.sketched(rows.limit(0), "k", "day"), "day").collect() == []


def test_stage_overlap(spark):
    a, b = spark.range(0, 50_000).toDF("k"), spark.range(40_000, 70_000).toDF("k")
    got = {(r["stage"], r["other"]): r["subjects"] for r in sk.stage_overlap({"a": a, "b": b, "none": a.limit(0)}, "k").collect()}
    assert abs(got["a", "a"] - 50_000) < 1600 and abs(got["b", "b"] - 30_000) < 1000
    assert abs(got["a", "b"] - 10_000) < 2000 and got["none", "none"] == got["a", "none"] == 0


# --- bucketed stages ---


def test_bucketed_features_join_without_a_shuffle(no_broadcast):
    store = StageStore.for_session(no_broadcast)
    study = clinical.ClinicalStudy(bindings.clinical_source(no_broadcast, "/root/testdata/sf0.001"), store, buckets=6)
    wide = study.table("covariates")
    text = plan(wide)
    assert "Exchange" not in text and "SortMergeJoin" in text and "SelectedBucketsCount: 6 out of 6" in text
    plain = clinical.ClinicalStudy(bindings.clinical_source(no_broadcast, "/root/testdata/sf0.001"), StageStore.for_session(no_broadcast))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(wide) == rows(plain.table("covariates"))
    assert store.tables and all(no_broadcast.catalog.tableExists(t) for t in store.tables)
    store.remove()
    assert not any(no_broadcast.catalog.tableExists(t) for t in store.tables)
