import pytest

from anchorset.functions import scores
from anchorset.functions.patterns import like, similar
from anchorset.operators import cohort as co


def test_subject_detail_does_not_multiply_rows(spark, as_rows):
    stays = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "stay int, hosp int")
    score = spark.createDataFrame([(1, "IV", 5), (1, "IVa", 9), (2, "IVa", 4)], "stay int, version string, score int")
    from pyspark.sql import functions as F

    dim = co.one_per_key(score.filter("version = 'IV'"), "stay", score=F.max("score"))
    hosp = spark.createDataFrame([(7, "north")], "hosp int, region string")
    out = co.subject_detail(stays, [(hosp, "hosp")], {"zero": F.lit(0)}, [(dim, "stay")])
    assert as_rows(out, "stay", "region", "score", "zero") == [
        (1, "north", 5, 0),
        (2, None, None, 0),
        (3, None, None, 0),
    ]


def test_first_stay_ties_and_nulls(spark, as_rows):
    stays = spark.createDataFrame([("a", 2, 10), ("a", 1, 12), ("a", 1, 11), ("b", None, 1), ("b", 3, 2)], "p string, visit int, stay int")
    assert as_rows(co.first_per(stays, "p", ["visit", "stay"]), "p", "stay") == [("a", 11), ("b", 2)]


def test_rank_before_filter(spark, as_rows):
    """A matching treatment in the second stay only does not make a cohort."""
    stays = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("b", 1, 20)], "p string, visit int, stay int")
    events = spark.createDataFrame([(11, "pump"), (20, "pump")], "stay int, text string")
    from pyspark.sql import functions as F

    first = co.first_per(stays, "p", ["visit", "stay"]).withColumn("age", F.lit(30))
    out = co.select_cohort(events, first, "stay", "text", like("%pump%"), "age", 18)
    assert as_rows(out, "stay") == [(20,)]


def test_cohort_drops_unknown_and_young_ages(spark, as_rows):
    stays = spark.createDataFrame(
        [(1, "45"), (2, "17"), (3, "> 89"), (4, ""), (5, None), (6, "18")], "stay int, age string"
    ).withColumn("age", scores.numeric_age("age", 91.4))
    events = spark.createDataFrame([(i, "x pump y") for i in range(1, 7)], "stay int, text string")
    out = co.select_cohort(events, stays, "stay", "text", similar("%pump%|%other%"), "age", 18)
    assert as_rows(out, "stay") == [(1,), (3,), (6,)]


@pytest.mark.parametrize("listed", [[1], [], [1, None], [None]])
@pytest.mark.parametrize("wide", [False, True])
def test_exclusion_with_nulls(spark, request, as_rows, listed, wide):
    if wide:
        request.getfixturevalue("no_broadcast")
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    ids = spark.createDataFrame([(i,) for i in listed], "k int")
    known = [i for i in listed if i is not None]
    kept = [(k,) for k in (None, 1, 2) if k not in known or k is None]
    assert as_rows(co.exclude(df, ids, "k")) == kept
    # SQL: NOT IN over a list with a NULL is never true; an empty list keeps all.
    df.createOrReplaceTempView("left_keys")
    ids.createOrReplaceTempView("listed_keys")
    expected = as_rows(spark.sql("SELECT * FROM left_keys WHERE k NOT IN (SELECT k FROM listed_keys)"))
    assert as_rows(co.exclude(df, ids, "k", null_aware=True)) == expected


def test_variant_counts_literal_and_per_key(spark, as_rows):
    events = spark.createDataFrame(
        [(1, "in"), (1, "in"), (2, "out"), (3, "in"), (3, "out"), (4, "in"), (4, "in2"), (4, "out")],
        "k int, t string",
    )
    removed = events.filter("t = 'out'")
    one = co.keys_with_variant_count(events, ["k", "t"], "t", 1, "k")
    two = co.keys_with_variant_count(events, ["k", "t"], "t", 2, "k")
    literal = co.union_keys(co.exclude(one, removed, "k"), two)
    assert as_rows(literal) == [(1,)]
    one, two = (co.keys_with_variant_count(events, "k", "t", n, "k") for n in (1, 2))
    intent = co.union_keys(co.exclude(one, removed, "k"), two)
    assert as_rows(intent) == [(1,), (3,)]


def test_match_rule_with_subjects_and_value(spark, as_rows):
    df = spark.createDataFrame([(1, "Hgb", 5.0), (1, "hgb", None), (2, "hgb", 6.0), (1, "hgb x", 7.0)], "k int, name string, v double")
    ids = spark.createDataFrame([(1,)], "k int")
    assert as_rows(co.match_rule(df, "name", like("hgb"), ids, "k", "v")) == [(1, "Hgb", 5.0)]


def test_baseline_limit_drops_null(spark, as_rows):
    df = spark.createDataFrame([(1, 99.9), (2, 100.0), (3, None)], "k int, v double")
    assert as_rows(co.baseline_at_least(df, "v", 100), "k") == [(2,)]


def test_attrition_counts_distinct_subjects(spark, as_rows):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    got = as_rows(co.attrition({"a": a, "b": a.filter("k = 1")}, "k"), "step", "stage", "subjects")
    assert got == [(1, "a", 2), (2, "b", 1)]
    rough = as_rows(co.attrition({"a": a}, "k", approximate=True), "subjects")
    assert rough == [(2,)]
