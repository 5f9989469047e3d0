"""Sweeps past many index events per subject, against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from anchorset.operators import sweep as sw
from anchorset.operators.joins import HOT_ROWS_SETTING
from anchorset.plans import event_orders as eo
from checks.compare import checking_engine, difference
from checks.oracle_events import ORACLES

FACTS, ANCHORS = "k int, t int, id int, v double", "k int, t0 int, a int"


def drawn(seed, hot=0):
    rng = random.Random(seed)
    key = lambda: rng.choice([1] * hot + [1, 2, 3, 4, None])
    facts = [(key(), rng.choice([*range(40), None]), i, rng.choice([1.0, 2.0, 3.0, 4.5, None])) for i in range(300)]
    anchors = [(key(), rng.choice([*range(-2, 42), None]), i) for i in range(120)] + [(1, 7, 500)] * 3 + [(9, 1, 501)]
    return facts, anchors


def near(facts, anchor, side):
    k, t0, _ = anchor
    meets = {"before": lambda t: t < t0, "until": lambda t: t <= t0, "from": lambda t: t >= t0, "after": lambda t: t > t0}
    known = [f for f in facts if None not in (f[0], f[1], f[3], k, t0) and f[0] == k]
    return [f for f in known if meets[side](f[1])]


def plain(facts, anchors, side):
    out = []
    for a in anchors:
        seen = near(facts, a, side)
        last = max(seen, key=lambda f: (f[1], f[2]), default=None)
        low = min(seen, key=lambda f: (f[3], f[1]), default=None)
        high = max(seen, key=lambda f: (f[3], -f[1]), default=None)
        pick = lambda f: (f[3], f[1]) if f else (None, None)
        out.append((*a, *pick(last), *pick(low), *pick(high)))
    return sorted(out, key=str)


def swept(spark, facts, anchors, side, **options):
    f, a = spark.createDataFrame(facts, FACTS), spark.createDataFrame(anchors, ANCHORS)
    picks = {"last": sw.latest("t", "id", "v"), "low": sw.lowest("t", "v"), "high": sw.highest(f, "t", "v")}
    found = sw.sweep(a, f, "k", "t0", "t", picks, side, **options)
    names = [F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in picks for c in ("value", "at")]
    return sorted((tuple(r) for r in found.select("k", "t0", "a", *names).collect()), key=str)


@pytest.mark.parametrize("part_rows", [0, 4, 50])
@pytest.mark.parametrize("side", ["before", "until", "from", "after"])
def test_every_anchor_as_searched(spark, side, part_rows):
    facts, anchors = drawn(part_rows, hot=6)
    assert swept(spark, facts, anchors, side, part_rows=part_rows) == plain(facts, anchors, side)


def test_sides_of_one_table(spark):
    facts, anchors = drawn(1)
    f, a = spark.createDataFrame(facts, FACTS), spark.createDataFrame(anchors, ANCHORS)
    for part_rows in (0, 9):
        mixed = sw.sweep(a, f, "k", "t0", "t", {"low": sw.lowest("t", "v")}, F.when(F.col("a") % 2 == 0, "before").otherwise("from"), part_rows)
        got = {r["a"]: r["low"] and (r["low"]["value"], r["low"]["at"]) for r in mixed.collect()}
        for anchor in anchors:
            seen = near(facts, anchor, "from" if anchor[2] % 2 else "before")
            assert got[anchor[2]] == min(((f[3], f[1]) for f in seen), default=None)


def test_empty_sides(spark):
    facts, anchors = drawn(2)
    assert swept(spark, facts, [], "until") == []
    assert swept(spark, [], anchors, "until") == plain([], anchors, "until")


@pytest.mark.parametrize("part_rows", [0, 5])
def test_windows_of_any_length(spark, part_rows):
    facts, _ = drawn(3, hot=4)
    rng = random.Random(8)
    windows = [(rng.choice([1, 1, 2, 3, 9, None]), rng.randint(-5, 40), rng.choice([-3, 0, 1, 2, 3, 5, 8, 20, 64]), i) for i in range(150)]
    w = spark.createDataFrame([(k, s, s + n, i) for k, s, n, i in windows] + [(1, None, 4, 900)], "k int, s int, e int, id int")
    f = spark.createDataFrame([(k, t, i, v) for k, t, i, v in facts], "k int, t int, fact int, v double")
    found = sw.window_extremes(w, f, "k", "id", "s", "e", "t", {"low": sw.lowest("t", "v"), "high": sw.highest(f, "t", "v")}, part_rows)
    got = {r["id"]: tuple(r[n] and (r[n]["value"], r[n]["at"]) for n in ("low", "high")) for r in found.collect()}
    assert got.pop(900) == (None, None) and len(got) == len(windows)
    for k, s, n, i in windows:
        seen = [(v, t) for key, t, _, v in facts if key == k is not None and None not in (t, v) and s <= t < s + n]
        assert got[i] == (min(seen, default=None), max(seen, key=lambda x: (x[0], -x[1]), default=None))


def test_a_hot_subject_is_split_over_tasks(spark):
    """Half of all rows belong to one subject: no task sorts more than a part."""
    facts = [(1, t, t, float(t % 97)) for t in range(4000)] + [(2 + t % 400, t, t, 1.0) for t in range(4000)]
    rows = spark.createDataFrame([(k, t) for k, t, _, _ in facts], "k int, _at int")
    (cut,) = sw.part_cuts(rows, ["k"], "_at", 500).collect()
    parts = [sum(a < t <= b for t in range(4000)) for a, b in zip([-1, *cut["_cuts"]], [*cut["_cuts"], 9999], strict=True)]
    assert cut["k"] == 1 and len(parts) == 8 and max(parts) <= 510
    anchors = [(1, t, t) for t in range(0, 4000, 7)]
    f, a = spark.createDataFrame(facts, FACTS), spark.createDataFrame(anchors, ANCHORS)
    found = sw.sweep(a, f, "k", "t0", "t", {"high": sw.highest(f, "t", "v")}, "until", 500).select("a", "high.value", "high.at").collect()
    best = {t: max(((x % 97, -x) for x in range(t + 1))) for t in range(0, 4000, 7)}
    assert {r[0]: (r[1], -r[2]) for r in found} == best


def test_plans_do_not_multiply_rows(spark):
    """No join of facts with anchors: whatever is joined is the small table of
    cuts and carries, or the found extremes by their own id."""
    sf = "/root/testdata/sf0.01"
    for query in (eo.every_last_before, eo.every_extreme_after):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    plan = eo.every_prior_window(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 2


def test_queries_on_split_keys(spark):
    engine = checking_engine("/root/testdata/sf0.001")
    spark.conf.set(HOT_ROWS_SETTING, "7")
    try:
        for name in ("every_last_before", "every_extreme_after", "every_prior_window"):
            problem, _ = difference(eo.QUERIES[name](spark, "/root/testdata/sf0.001"), engine, ORACLES[name])
            assert problem is None
    finally:
        spark.conf.unset(HOT_ROWS_SETTING)
