"""States that are merged, renewed and retracted, against plain aggregates."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from anchorset.operators import sweep as sw
from anchorset.operators.states import COUNT, SubjectStates, moved
from anchorset.plans.refresh import ProfileAroundIndex
from anchorset.sources.stages import StageStore

FACTS = "k int, t int, id int, v double"
EVENTS = "user_id int, ts int, event_id int, event_type string, value double"


def drawn(seed, n=300, keys=12):
    rng = random.Random(seed)
    return [(rng.choice([*range(keys), None]), rng.choice([*range(60), None]), i, rng.choice([1.0, 2.5, 7.0, None])) for i in range(n)]


def plain(facts):
    out = {}
    for k in {f[0] for f in facts} - {None}:
        own = [f for f in facts if f[0] == k]
        known = [f for f in own if f[3] is not None]
        time = lambda f: (f[1] is not None, f[1] or 0)
        last = max(known, key=lambda f: (time(f), f[2]), default=None)
        low = min(known, key=lambda f: (f[3], time(f)), default=None)
        out[k] = (last and (last[1], last[3]), low and (low[3], low[1]), len(own))
    return out


def found(df):
    return {
        r["k"]: (r["last"] and (r["last"]["at"], r["last"]["value"]), r["low"] and (r["low"]["value"], r["low"]["at"]), r[COUNT])
        for r in df.collect()
    }


@pytest.fixture
def states(spark, tmp_path):
    picks = {"last": sw.latest("t", "id", "v"), "low": sw.lowest("t", "v")}
    return SubjectStates(StageStore(spark, f"{tmp_path}/run"), "s", "k", picks)


def test_folding_equals_building(spark, states):
    facts = drawn(1)
    of = lambda some: spark.createDataFrame(some, FACTS)
    states.build(of(facts[:120]))
    states.fold(of(facts[120:200]))
    assert found(states.fold(of(facts[200:]))) == plain(facts)
    assert states.version() == 3 and found(states.table(1)) == plain(facts[:120])
    assert found(states.fold(of([]))) == plain(facts)


def test_folding_reads_the_new_facts_only(spark, states, tmp_path):
    """The old files are gone, and each new row is read once."""
    facts = drawn(2)
    spark.createDataFrame(facts[:200], FACTS).write.parquet(f"{tmp_path}/old")
    states.build(spark.read.parquet(f"{tmp_path}/old"))
    shutil.rmtree(tmp_path / "old")
    from pyspark.sql import Observation

    read = Observation()
    new = spark.createDataFrame(facts[200:], FACTS).observe(read, F.count(F.lit(1)).alias("rows"))
    assert found(states.fold(new)) == plain(facts)
    assert read.get["rows"] == 100


def test_retracting_recomputes_touched_subjects(spark, states):
    facts = drawn(3)
    gone = [f for f in facts if f[2] % 9 == 0] + [f for f in facts if f[0] == 5 and f[2] % 9]
    kept = [f for f in facts if f not in gone]
    of = lambda some: spark.createDataFrame(some, FACTS)
    states.build(of(facts))
    touched = {r["k"] for r in states.touched_by(of(gone)).collect()}
    before, after = plain(facts), plain(kept)
    # Whoever's best changes is touched; whoever keeps it is left alone or recomputed to the same.
    assert {k for k in before if before[k][:2] != after.get(k, (0, 0))[:2]} <= touched < set(before)
    assert found(states.retract(of(gone), of(kept))) == after and 5 not in after


def test_retracting_uses_facts_of_touched_subjects_only(spark, states):
    """Others' remaining facts could be anything."""
    facts = [(k, t, 10 * k + t, float(t)) for k in range(1, 9) for t in range(5)]
    of = lambda some: spark.createDataFrame(some, FACTS)
    states.build(of(facts))
    gone = [(2, 4, 24, 4.0), (3, 0, 30, 0.0), (4, 2, 42, 2.0)]  # the last one of 2, the lowest of 3, neither of 4
    kept = [f if f[0] in (2, 3) else (f[0], 99, 999, -1.0) for f in facts if f not in gone]
    want = plain([f for f in facts if f not in gone])
    assert found(states.retract(of(gone), of(kept))) == want


def test_the_scan_of_remaining_facts_is_bounded(spark, states, tmp_path):
    facts = [(k, t, 10 * k + t, float(t)) for k in range(1, 9) for t in range(5)]
    spark.createDataFrame(facts, FACTS).write.parquet(f"{tmp_path}/facts")
    states.build(spark.read.parquet(f"{tmp_path}/facts"))
    seen = []
    write = states._write
    states._write = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or write(df)
    remaining = spark.read.parquet(f"{tmp_path}/facts").filter("id <> 54")
    states.retract(spark.createDataFrame([(5, 4, 54, 4.0)], FACTS), remaining)
    assert "GreaterThanOrEqual(k,5)" in seen[0] and "LessThanOrEqual(k,5)" in seen[0]


def test_a_broken_refresh_leaves_the_last_version(spark, states, tmp_path):
    facts = drawn(4)
    states.build(spark.createDataFrame(facts[:100], FACTS))
    states.fold(spark.createDataFrame(facts[100:], FACTS))
    (tmp_path / "run" / "states_s_2" / "_SUCCESS").unlink()
    assert states.version() == 1 and found(states.table()) == plain(facts[:100])
    assert found(states.fold(spark.createDataFrame(facts[100:], FACTS))) == plain(facts)


def test_moved(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 4)], "k int, x int")
    b = spark.createDataFrame([(1, 1), (2, 5), (3, None), (6, 1)], "k int, x int")
    assert sorted(r[0] for r in moved(a, b, "k", "x").collect()) == [2, 4, 6]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_profile_equals_a_full_build(spark, tmp_path, seed):
    """Late events that move the index, withdrawn index events, in any order."""
    rng = random.Random(seed)
    events = [(rng.randint(1, 25), rng.randint(0, 50), i, rng.choice(["start", "read", "read", "x"]), rng.choice([1.0, 2.0, 3.5, None])) for i in range(400)]
    of = lambda some: spark.createDataFrame(some, EVENTS)
    cut = rng.randint(50, 350)
    gone = [e for e in events if rng.random() < 0.15]
    kept = [e for e in events if e not in gone]
    study = ProfileAroundIndex(StageStore(spark, f"{tmp_path}/a"), "start", "read")
    study.build(of(events[:cut]))
    study.fold(of(events[cut:]), of(events))
    whole = ProfileAroundIndex(StageStore(spark, f"{tmp_path}/b"), "start", "read")
    whole.build(of(events))
    rows = lambda s: sorted(map(tuple, s.table().collect()), key=str)
    assert rows(study) == rows(whole)
    study.retract(of(gone), of(kept))
    rest = ProfileAroundIndex(StageStore(spark, f"{tmp_path}/c"), "start", "read")
    rest.build(of(kept))
    assert rows(study) == rows(rest)
