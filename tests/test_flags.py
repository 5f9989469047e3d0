from anchorset.functions.patterns import like, similar
from anchorset.operators import flags as fl


def test_ever_and_any_source(spark, as_rows):
    a = spark.createDataFrame([(1, "Red X"), (1, "red"), (2, "blue"), (3, None)], "k int, t string")
    b = spark.createDataFrame([(2, "drug z"), (4, "drug z")], "k int, d string")
    assert as_rows(fl.ever_flag(a, "k", "t", like("%red%"))) == [(1,)]
    listed = fl.any_source_flag([(a, {"t": like("%red%")}), (b, {"d": similar("%(z|y)%")})], "k")
    assert as_rows(listed) == [(1,), (2,), (4,)]
    cohort = spark.createDataFrame([(1,), (3,), (4,)], "k int")
    assert as_rows(fl.as_flag(cohort, listed, "k", "f")) == [(1, 1), (3, 0), (4, 1)]


def test_timed_flag_sides(spark, no_broadcast, as_rows):
    events = spark.createDataFrame([(1, 99, "x"), (2, 100, "x"), (3, 101, "x"), (4, 1, "y")], "k int, off int, t string")
    index = spark.createDataFrame([(k, 100) for k in range(1, 5)], "k int, at int")
    got = {
        side: [r[0] for r in as_rows(fl.timed_flag(events, index, "k", "off", "at", "t", like("x"), side))]
        for side in ("before", "until", "from", "after")
    }
    assert got == {"before": [1], "until": [1, 2], "from": [2, 3], "after": [3]}


def test_many_rules_of_many_sources_in_one_table(spark, as_rows):
    hist = spark.createDataFrame([(1, "old stroke"), (1, "angina"), (2, None), (9, "angina")], "k int, path string")
    diag = spark.createDataFrame([(2, 50, "Angina pectoris"), (3, 150, "angina"), (3, 150, "bleed")], "k int, off int, t string")
    index = spark.createDataFrame([(1, 100), (2, 100), (3, 100), (4, 100)], "k int, at int")
    rules = {"angina": like("%angina%"), "stroke": similar("%stroke%|%tia\\(s%")}
    timed = {"angina": (like("%angina%"), "before"), "bleed": (like("%bleed%"), "from"), "any": (like("%a%"), None)}
    rows = [
        fl.flag_rows(hist, "k", "path", rules, index),
        fl.timed_flag_rows(diag, index, "k", "off", "at", "t", timed),
    ]
    names = ["angina", "stroke", "bleed", "any"]
    got = fl.add_flags(index.select("k"), fl.pivot_flags(rows, "k", names), "k", names)
    assert as_rows(got) == [(1, 1, 1, 0, 0), (2, 1, 0, 0, 1), (3, 0, 0, 1, 1), (4, 0, 0, 0, 0)]
