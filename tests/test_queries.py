"""Every registered query against its checking SQL."""

import pytest

import __spark_entry__ as entry
from anchorset.operators.joins import HOT_ROWS_SETTING
from anchorset.plans import clinical, event_orders
from checks import oracle_clinical, oracle_events
from checks.compare import checking_engine, difference

SF = "/root/testdata/sf0.001"
# The library's own queries; others have tests of their own.
OWN = {**oracle_events.ORACLES, **oracle_clinical.ORACLES}
QUERIES = {n: q for n, q in entry.queries().items() if n in OWN}
ORACLES = {n: sql for n, sql in entry.oracle_sql().items() if n in OWN}


@pytest.fixture(scope="module")
def engine():
    return checking_engine(SF)


def test_every_query_has_checking_sql():
    every = {*event_orders.QUERIES, *(f"clinical_{n}" for n in (*clinical.RESULTS, "cohort_intent", "covariates_bucketed"))}
    assert every <= set(QUERIES) and set(QUERIES) == set(ORACLES) == set(OWN)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, engine, name):
    problem, _ = difference(QUERIES[name](spark, SF), engine, ORACLES[name])
    assert problem is None


# Of the clinical results those that between them build every stage.
SHUFFLED = [n for n in QUERIES if not n.startswith("clinical_")] + [
    "clinical_cohort",
    "clinical_study_table",
    "clinical_daily_coverage",
]


@pytest.mark.parametrize("name", SHUFFLED)
def test_query_without_broadcast(no_broadcast, engine, name):
    """The same results when every join shuffles and keys count as hot early."""
    no_broadcast.conf.set(HOT_ROWS_SETTING, "20")
    try:
        problem, _ = difference(QUERIES[name](no_broadcast, SF), engine, ORACLES[name])
    finally:
        no_broadcast.conf.unset(HOT_ROWS_SETTING)
    assert problem is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
