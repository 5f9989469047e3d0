"""What the physical plans have to look like at scale."""

import pytest

import __spark_entry__ as entry
from anchorset.operators.joins import HOT_ROWS_SETTING
from anchorset.plans import bindings, clinical, registry
from anchorset.plans import event_orders as eo
from anchorset.sources.stages import StageStore
from anchorset.sources.tables import TableSource

SF = "/root/testdata/sf0.01"
EVENT_QUERIES = list(eo.QUERIES)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", EVENT_QUERIES)
def test_no_cross_join_no_python_no_collected_groups(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    # A sketch is an object of bounded size.
    objects = () if "theta_sketch" in text or "theta_union" in text else ("ObjectHash",)
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "collect_list", "collect_set", *objects):
        assert banned not in text


@pytest.mark.parametrize("name", EVENT_QUERIES)
def test_shuffled_plans_have_no_unchecked_broadcast(no_broadcast, name):
    """With broadcasting off, only the bounded list of hot keys is broadcast."""
    from pyspark.sql import functions as F

    df = entry.queries()[name](no_broadcast, SF)
    for line in plan(df).splitlines():
        if "BroadcastHashJoin" in line:
            assert "Outer" in line and "BuildRight" in line
    assert df.select(F.lit(1)).limit(1).count() <= 1


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(eo.index_event(spark, SF))
    assert "PushedFilters" in text and "EqualTo(event_type,purchase)" in text
    assert "props" not in text


def test_split_joins_scan_only_what_is_used(no_broadcast):
    """Operators cut whole rows to what they read before a key is split."""
    no_broadcast.conf.set(HOT_ROWS_SETTING, "1")
    try:
        text = plan(eo.cohort(no_broadcast, SF))
        assert "xxhash64" in text
        for unused in ("l_shipdate", "l_quantity", "o_orderdate", "p_type"):
            assert unused not in text
        text = plan(eo.last_before(no_broadcast, SF))
        assert "xxhash64" in text and "props" not in text
        text = plan(eo.extreme_after_min(no_broadcast, SF))
        assert "xxhash64" in text and "event_id" not in text
    finally:
        no_broadcast.conf.unset(HOT_ROWS_SETTING)


def test_a_cohort_of_known_size_is_broadcast(spark):
    text = plan(eo.cohort(spark, "/root/testdata/sf0.1"))
    assert "BroadcastHashJoin" in text and "xxhash64" not in text and "SortMergeJoin" not in text


SCANS = {"variant_count_literal": ("lineitem", 1), "multi_source_flag": ("lineitem", 1), "history_flags": ("documents", 1)}


@pytest.mark.parametrize("name", SCANS)
def test_one_scan(spark, no_broadcast, name):
    table, scans = SCANS[name]
    text = plan(eo.QUERIES[name](spark, SF))
    assert sum(f"{table}.parquet" in line for line in text.splitlines() if "FileScan" in line) == scans


# Scans of each table in one build of all clinical results.
STUDY_SCANS = {"treatment": 2, "patient": 1, "apachepatientresult": 1, "lab": 3, "diagnosis": 1, "medication": 1}


def test_scans_of_the_whole_study(spark, tmp_path):
    """Counted where plans run: every table is a folder of its own."""
    # Plans show whole paths.
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    source = bindings.clinical_source(spark, "/root/testdata/sf0.001")
    for name, columns in registry.TABLES.items():
        source.table(name, columns).write.parquet(f"{tmp_path}/in/{name}.parquet")
    queue = StageStore(spark, f"{tmp_path}/stages")
    border = queue.border
    paths = TableSource(spark, path=f"{tmp_path}/in")
    plans = []  # stages are written from several threads

    def counted(name, df, **params):
        plans.append(plan(df))
        return border(name, df, **params)

    queue.border = counted
    study = clinical.ClinicalStudy(paths, queue)
    for name in clinical.RESULTS:
        plans.append(plan(study.table(name)))
    spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert {t: sum(p.count(f"/in/{t}.parquet]") for p in plans) for t in STUDY_SCANS} == STUDY_SCANS


def test_measures_are_pushed_down(spark):
    assert "In(event_type, [" in plan(eo.measure_profile(spark, SF))


def test_first_stay_is_pruned_before_the_shuffle(spark):
    text = plan(eo.first_stay(spark, SF))
    before, after = text.index("Exchange"), text.rindex("WindowGroupLimit")
    assert text.count("WindowGroupLimit") == 2 and before < after


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("measure_profile", "extreme_after_min", "new_onset", "history_flags"):
        assert "partial_m" in plan(entry.queries()[name](spark, SF))


def test_one_scan_per_source_for_all_measures(spark):
    """Index and profile: two scans of the events, however many measures."""
    assert plan(eo.measure_profile(spark, SF)).count("FileScan") == 2
