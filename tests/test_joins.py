import pytest
from pyspark.sql import functions as F

from anchorset.operators.joins import HOT_ROWS_SETTING, broadcast_limit, fits_broadcast, subject_join, within


def _tables(spark):
    """3,000 facts: a third belongs to key 0, the rest to 200 keys; every third
    key has no subject and key -1 has no facts."""
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 200).alias("k"),
        (F.col("id") % 7).alias("v"),
        F.col("id").alias("n"),
    )
    subjects = spark.range(-1, 200).filter("id % 3 <> 1").select(F.col("id").alias("k"), (F.col("id") * 10).alias("s"))
    return facts, subjects


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_are_split_without_changing_the_result(no_broadcast, as_rows, how):
    facts, subjects = _tables(no_broadcast)
    plain = facts.join(subjects, "k", how)
    split = subject_join(facts, subjects, "k", how, hot_rows=50)
    assert split.columns == plain.columns
    assert as_rows(split) == as_rows(plain)


def test_a_hot_key_reaches_several_partitions(no_broadcast):
    facts, subjects = _tables(no_broadcast)
    no_broadcast.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        split = subject_join(facts, subjects, "k", hot_rows=50)
        spread = split.groupBy("k", F.spark_partition_id().alias("p")).count()
        per_key = {r["k"]: r["n"] for r in spread.groupBy("k").agg(F.count("*").alias("n")).collect()}
    finally:
        no_broadcast.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert per_key[0] >= 4
    assert all(n == 1 for k, n in per_key.items() if k != 0)


def _largest_share(spark, df) -> int:
    """Rows of the fullest partition, with partitions as the shuffle left them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_rows_reach_the_join_once(no_broadcast):
    """20,000 equal rows: one row with its number passes the shuffle."""
    facts = no_broadcast.range(20_000).select(F.lit(1).alias("k"), F.lit(2).alias("v"))
    subjects = no_broadcast.createDataFrame([(1, "a")], "k int, s string")
    joined = subject_join(facts, subjects, "k", hot_rows=100)
    assert joined.count() == 20_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "_hot_copies" in plan


@pytest.mark.parametrize("how,rows", [("left", 10_000), ("left_anti", 10_000), ("inner", 0), ("left_semi", 0)])
def test_null_keys_are_spread(no_broadcast, how, rows):
    facts = no_broadcast.range(10_000).select(F.lit(None).cast("int").alias("k"), "id")
    subjects = no_broadcast.createDataFrame([(1, "a")], "k int, s string")
    joined = subject_join(facts, subjects, "k", how, hot_rows=100)
    assert joined.count() == rows
    if rows:
        assert _largest_share(no_broadcast, joined) < 3 * 10_000 / 8


def test_hot_rows_come_from_the_session(no_broadcast):
    facts, subjects = _tables(no_broadcast)
    assert "xxhash64" not in subject_join(facts, subjects, "k")._jdf.queryExecution().toString()
    no_broadcast.conf.set(HOT_ROWS_SETTING, "50")
    try:
        assert "xxhash64" in subject_join(facts, subjects, "k")._jdf.queryExecution().toString()
    finally:
        no_broadcast.conf.unset(HOT_ROWS_SETTING)


def test_identical_facts_are_all_kept(no_broadcast):
    facts = no_broadcast.range(500).select(F.lit(1).alias("k"), F.lit(2).alias("v"))
    subjects = no_broadcast.createDataFrame([(1, "a")], "k int, s string")
    assert subject_join(facts, subjects, "k", hot_rows=10).count() == 500


def test_two_column_keys(no_broadcast, as_rows):
    facts, subjects = _tables(no_broadcast)
    facts, subjects = facts.withColumn("j", F.col("k") % 2), subjects.withColumn("j", F.col("k") % 2)
    plain = facts.join(subjects, ["k", "j"])
    assert as_rows(subject_join(facts, subjects, ["k", "j"], hot_rows=50)) == as_rows(plain)


def test_small_subject_side_is_left_to_the_broadcast_planner(spark):
    facts, subjects = _tables(spark)
    assert fits_broadcast(subjects)
    plan = subject_join(facts, subjects, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "xxhash64" not in plan


def test_limit_is_read_from_the_session(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    for text, size in (("10MB", 10 << 20), ("512k", 512 << 10), ("77", 77), ("-1", -1), ("5b", 5)):
        spark.conf.set(name, text)
        assert broadcast_limit(spark.range(1)) == size
    spark.conf.set(name, before)


def test_within_keeps_rows_once_for_duplicate_keys(spark, no_broadcast):
    facts = spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "k int, v int")
    listed = spark.createDataFrame([(1,), (1,)], "k int")
    assert within(facts, listed, "k").count() == 2
