import pytest
from pyspark.sql import functions as F

from anchorset.functions import scores
from anchorset.functions.numeric import later_first, quotient_by_type, round_to, whole_quotient
from anchorset.functions.patterns import like
from anchorset.operators.features import change, keep_pair


def values(spark, data, schema, *exprs):
    df = spark.createDataFrame(data, schema)
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_rounding_has_no_cap_and_rounds_once(spark):
    rows = [(0.12344999996,), (0.12345,), (50 / 1e-9,), (1e15 + 0.125,), (1e300,), (-0.00005,), (4.9999999999999e-5,)]
    got = values(spark, rows, "x double", round_to("x", 4))
    assert [g[0] for g in got] == [0.1234, 0.1235, 5e10, 1e15 + 0.125, 1e300, -0.0001, 0.0]
    got = values(spark, [(1e-9,)], "b double", change("b", F.lit(50.0), "relative_rise"))
    assert got == [(4.9999999999e10,)]


def test_rounding_is_half_away_from_zero_on_the_decimal_value(spark):
    got = values(spark, [(2.675,), (-2.675,), (1.005,), (0.125,), (None,)], "x double", round_to("x", 2))
    assert [g[0] for g in got] == [2.68, -2.68, 1.01, 0.13, None]


def test_whole_quotient_cuts_towards_zero(spark):
    got = values(spark, [(119,), (-119,), (None,)], "x int", whole_quotient("x", 60))
    assert [g[0] for g in got] == [1, -1, None]


def test_quotient_follows_the_column_type(spark):
    df = spark.createDataFrame([(67, 67.0)], "i int, d double")
    row = df.select(quotient_by_type(df, "i", 10).alias("i"), quotient_by_type(df, "d", 10).alias("d")).first()
    assert (row["i"], row["d"]) == (6, 6.7)


def test_later_first_orders_every_time_type(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 00:00:00', timestamp'2024-01-01 00:00:00', date'2024-01-01'),"
        " (2, timestamp_ntz'2024-01-02 00:00:00', timestamp'2024-01-02 00:00:00', date'2024-01-02') AS t(i, n, z, d)"
    )
    for name in ("i", "n", "z", "d"):
        assert [r["i"] for r in df.orderBy(later_first(df, name)).collect()] == [2, 1]


def test_ages(spark):
    got = values(
        spark, [("45",), ("17",), ("> 89",), ("",), (None,)], "age string", scores.numeric_age("age", 91.4)
    )
    assert [None if g[0] is None else float(g[0]) for g in got] == [45.0, 17.0, 91.4, None, None]


def test_gender_order_of_cases(spark):
    rule = scores.recode("g", [(like("%female%"), 0), (like("%male%"), 1)])
    got = values(spark, [("Female",), ("Male",), ("",), (None,)], "g string", rule)
    assert [g[0] for g in got] == [0, 1, None, None]


def test_status_from_two_columns(spark):
    rule = scores.recode_pair([("unit", like("%alive%"), 0), ("hosp", like("%expired%"), 1)])
    data = [("Alive", "Expired"), ("Expired", "Alive"), ("Expired", "Expired"), (None, None)]
    assert [g[0] for g in values(spark, data, "unit string, hosp string", rule)] == [0, None, 1, None]


def test_band_edges_of_both_conventions(spark):
    data = [(0.25,), (0.5,), (0.75,), (1.0,), (1.2,), (-1.0,), (None,)]
    got = values(
        spark,
        data,
        "x double",
        scores.bands("x", [0.25, 0.5, 0.75], "left", default=0),
        scores.bands("x", [0.25, 0.5, 0.75, 1.0], "right", open_top=False),
    )
    assert got == [(2, 1), (3, 2), (4, 3), (4, 4), (4, None), (1, 1), (0, None)]


def test_descending_labels(spark):
    band = scores.bands("x", [50, 100, 150], "right", [4, 3, 2, 1], default=0)
    got = values(spark, [(50,), (51,), (100,), (150,), (151,), (None,)], "x int", band)
    assert [g[0] for g in got] == [4, 3, 3, 2, 1, 0]


def test_bands_refuse_an_unknown_side():
    with pytest.raises(ValueError):
        scores.bands("x", [1], "both")


def test_bleed_grade_gap_and_order(spark):
    drops = [-1.0, 0.0, 0.5, 3.0, 3.1, 5.0, 5.1, None]
    data = [(d, f) for d in drops for f in (0, 1)]
    got = values(spark, data, "d double, f int", scores.bleed_grade("d", "f"))
    plain, flagged = [g[0] for g in got[::2]], [g[0] for g in got[1::2]]
    assert plain == [None, None, 1, None, 2, 2, 3, None]
    assert flagged == [None, None, 1, 3, 2, 2, 3, 3]


def test_severe_event_treats_null_as_not_met(spark):
    data = [(None, 1, 0, 0), (3.5, 1, 0, 0), (3.5, 0, 0, 0), (5.5, 0, 0, 0), (None, 0, 1, 0), (None, 0, 0, 1)]
    got = values(spark, data, "d double, w int, s int, t int", scores.severe_event("d", "w", "s", "t"))
    assert [g[0] for g in got] == [0, 1, 0, 1, 1, 1]


def test_body_mass_index_without_height(spark):
    data = [(80.0, 200.0), (80.0, 0.0), (80.0, None), (None, 170.0)]
    got = values(spark, data, "w double, h double", scores.body_mass_index("w", "h"))
    assert [g[0] for g in got] == [20.0, None, None, None]


def test_pressure_weights(spark):
    got = values(
        spark,
        [(120.0, 60.0), (120.0, None)],
        "s double, d double",
        scores.weighted_pressure("s", "d", 1 / 3, 0.0),
        scores.weighted_pressure("s", "d", 1 / 3, 2 / 3),
    )
    assert got == [(40.0, 80.0), (None, None)]


def test_any_flag_and_earliest_time(spark):
    data = [(1, 5, 1, 3), (1, 5, 0, None), (0, None, 1, 3), (0, None, 0, None)]
    got = values(
        spark,
        data,
        "a int, at int, b int, bt int",
        scores.any_flag("a", "b"),
        scores.earliest_time(("a", "at"), ("b", "bt")),
    )
    assert got == [(1, 3), (1, 5), (1, 3), (0, None)]


def test_change_needs_both_values_and_a_base(spark):
    data = [(200.0, 150.0), (0.0, 1.0), (None, 1.0), (1.0, None)]
    kinds = ("relative_drop", "absolute_drop", "relative_rise")
    got = values(spark, data, "b double, e double", *[change("b", "e", k) for k in kinds])
    assert got == [(0.25, 50.0, -0.25), (None, -1.0, None), (None, None, None), (None, None, None)]


def test_pair_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None), (None, 2.0)], "b double, e double")
    both = [tuple(r) for r in keep_pair(df, "b", "e", "both").collect()]
    base = [tuple(r) for r in keep_pair(df, "b", "e", "base").collect()]
    assert both == [(1.0, 2.0), (None, None), (None, None)]
    assert base == [(1.0, 2.0), (1.0, None), (None, None)]


def test_threshold_flag(spark):
    got = values(spark, [(0.49,), (0.5,), (None,)], "x double", scores.threshold_flag("x", 0.5))
    assert [g[0] for g in got] == [0, 1, None]


def test_day_buckets_from_whole_hours(spark):
    got = values(
        spark,
        [(0,), (1,), (59,), (60,), (1439,), (1440,), (1441,), (1500,)],
        "m int",
        F.ceil(whole_quotient("m", 60) / 24),
    )
    assert [g[0] for g in got] == [0, 0, 0, 1, 1, 1, 1, 2]
