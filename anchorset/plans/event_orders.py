"""The operators on the order and event tables.

Roles: a user is a subject, the first purchase is the index event, the other
event types are measures and events; an order is a stay of a customer, and a line
item with its part is a treatment with a text. Every plan reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.numeric import divide, micros, round_to
from ..functions.patterns import like, similar
from ..operators import cohort as co
from ..operators import dictionary as di
from ..operators import features as fe
from ..operators import flags as fl
from ..operators import sketches as sk
from ..operators import sweep as sw
from ..operators import ties
from ..operators import timeline as tl
from ..operators.bounds import within_bounds
from ..operators.joins import attach_index, on_side, subject_join
from ..sources.stages import StageStore
from ..sources.tables import TableSource
from .refresh import ProfileAroundIndex

USER, TS, INDEX_TS = "user_id", "ts", "index_ts"
BASELINE_LIMIT = 10.0
SEGMENTS = ((like("%machine%"), 0), (like("%house%"), 1), (like("%build%"), 2))
RED_WIDGETS = similar("%red%widget%|%blue%ring%|old gear")


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return TableSource(spark, path=sf_dir).table(name, columns or None)


def _events(spark, sf_dir, *types: str) -> DataFrame:
    events = _table(spark, sf_dir, "events", USER, TS, "event_id", "event_type", "value")
    return events.filter(F.col("event_type").isin(*types)) if types else events


def _index_plan(spark, sf_dir) -> DataFrame:
    first = tl.index_event(_events(spark, sf_dir, "purchase"), USER, TS, "event_id", ["value"])
    return first.select(USER, F.col(TS).alias(INDEX_TS), F.col("value").alias("index_value"))


def _index(spark, sf_dir) -> DataFrame:
    """The index as a stage table: it is computed once however many parts of a
    query read it, and Spark knows its size instead of guessing it from the
    events."""
    return _staged(spark, "index", _index_plan(spark, sf_dir))


def _staged(spark, name: str, df: DataFrame) -> DataFrame:
    return StageStore.for_session(spark).border(name, df)


def _span():
    return F.expr("INTERVAL 72 HOURS")


# --- cohort side -------------------------------------------------------------


def subject_detail(spark, sf_dir):
    region = _table(spark, sf_dir, "nation").join(
        _table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    region = region.select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region")
    )
    derived = {
        "segment_code": scores.recode("c_mktsegment", SEGMENTS),
        "balance_hours": F.expr("cast(c_acctbal as int) div 60"),
        "start": F.lit(0),
    }
    out = co.subject_detail(_table(spark, sf_dir, "customer"), [(region, "c_nationkey")], derived)
    return out.select("c_custkey", "region", "segment_code", "balance_hours", "start")


def _priority_age():
    token = F.substring_index("o_orderpriority", "-", 1)
    text = (
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("> "), token))
        .when(token == "4", F.lit(""))
        .otherwise(token)
    )
    return scores.numeric_age(text, 91.4)


def age_string_cast(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    out = orders.select("o_orderkey", _priority_age().cast("double").alias("age"))
    return out.filter(F.col("age") >= 2)


def first_stay(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    first = co.first_per(orders, "o_custkey", ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey", micros("o_orderdate").alias("order_us"))


def _parts(spark, sf_dir):
    return _table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")


def pattern_like(spark, sf_dir):
    return co.match_rule(_parts(spark, sf_dir), "p_name", like("%widget%"))


def pattern_not_like(spark, sf_dir):
    rule = similar("%ring%|%gear%", none_of=("%small%", "%old%"))
    return co.match_rule(_parts(spark, sf_dir), "p_name", rule)


def pattern_similar(spark, sf_dir):
    rule = similar("(red|blue|hot) (ring|bolt)|%large gi_mo|new%d%t|col[cd] rod+")
    return co.match_rule(_parts(spark, sf_dir), "p_name", rule)


def pattern_similar_text(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    rule = similar("%(thorre|ondernt|[aeiou]ationh)%|%é.%\\(%", none_of=("%copyright%",))
    return co.match_rule(docs, "text", rule).select("doc_id", "lang")


def pattern_within(spark, sf_dir):
    """Readings by name, restricted to listed subjects, with a value. Users with
    an error above 120 are listed."""
    subjects = _events(spark, sf_dir, "error").filter("value > 120").select(USER)
    rows = co.match_rule(
        _events(spark, sf_dir), "event_type", like("%i%"), subjects, USER, "value"
    )
    return rows.select(USER, "event_id", "event_type", "value")


def _treatments(spark, sf_dir, *columns: str) -> DataFrame:
    """Line items with the name and type of their part, and further columns."""
    lines = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", *columns)
    parts = _parts(spark, sf_dir).withColumnRenamed("p_partkey", "l_partkey")
    return subject_join(lines, parts, "l_partkey").withColumnRenamed("l_orderkey", "o_orderkey")


def _stays(spark, sf_dir) -> DataFrame:
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    customer = _table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    return subject_join(orders, customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")


def cohort(spark, sf_dir):
    treatments = _treatments(spark, sf_dir, "l_linenumber").drop("l_partkey", "p_type")
    stays = _staged(spark, "stays", _stays(spark, sf_dir))
    rows = co.select_cohort(
        treatments, stays, "o_orderkey", "p_name", RED_WIDGETS, "c_acctbal", 18
    )
    return rows.select("o_orderkey", "l_linenumber", "p_name", "o_custkey", "c_acctbal")


def exclude_ids(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    listed = orders.filter("o_orderstatus = 'F'").filter(F.col("o_orderpriority").like("1-%"))
    customers = _table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    return co.exclude(
        customers, listed.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", unique=True
    )


def not_in_list(spark, sf_dir):
    """NOT IN as SQL defines it, against a list that could hold NULLs: customers
    without an order above 300,000."""
    orders = _table(spark, sf_dir, "orders", "o_custkey", "o_totalprice")
    listed = orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    customers = _table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    return co.exclude(customers, listed, "c_custkey", null_aware=True, unique=True)


def variant_count(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus")
    return co.keys_with_variant_count(
        lines, "l_orderkey", ["l_returnflag", "l_linestatus"], 2, "l_orderkey"
    )


def variant_count_literal(spark, sf_dir):
    """Grouped by key and variant each count is 1: what remains are the keys
    without the excluded variant."""
    lines = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag")
    return co.keys_without(lines, "l_orderkey", F.col("l_returnflag") == "R")


def baseline_threshold(spark, sf_dir):
    return co.baseline_at_least(last_before(spark, sf_dir), "last_value", BASELINE_LIMIT)


def exclude_by_flag(spark, sf_dir):
    """An error above 150 is the flag."""
    high = _events(spark, sf_dir, "error").filter("value > 150")
    return co.exclude(_index(spark, sf_dir).select(USER, "index_value"), high, USER, unique=True)


# --- index event and readings around it ----------------------------------------


def index_event(spark, sf_dir):
    return _index_plan(spark, sf_dir).select(USER, micros(INDEX_TS).alias("index_us"), "index_value")


def _last_view(spark, sf_dir, method="aggregate", index=None):
    return tl.last_before(
        _events(spark, sf_dir, "view"),
        _index(spark, sf_dir) if index is None else index,
        USER,
        TS,
        "value",
        INDEX_TS,
        "event_id",
        out_ts="last_ts",
        method=method,
    )


def last_before(spark, sf_dir):
    rows = _last_view(spark, sf_dir, "window")
    return rows.select(USER, "last_value", micros("last_ts").alias("last_us"))


def last_before_onepass(spark, sf_dir):
    rows = _last_view(spark, sf_dir)
    return rows.select(USER, "last_value", micros("last_ts").alias("last_us"))


def _extreme(spark, sf_dir, kind, which):
    return tl.extreme_after(
        _events(spark, sf_dir, kind),
        _index(spark, sf_dir),
        USER,
        TS,
        "value",
        INDEX_TS,
        which,
        out_ts="extreme_ts",
    )


def extreme_after_min(spark, sf_dir):
    rows = _extreme(spark, sf_dir, "view", "min")
    return rows.select(USER, "min_value", micros("extreme_ts").alias("extreme_us"))


def extreme_after_max(spark, sf_dir):
    rows = _extreme(spark, sf_dir, "click", "max")
    return rows.select(USER, "max_value", micros("extreme_ts").alias("extreme_us"))


MEASURES = {name: like(name, lower=False) for name in ("view", "click", "error", "signup")}


def _profile(spark, sf_dir) -> DataFrame:
    return _profile_at(spark, sf_dir, _index(spark, sf_dir))


def _profile_at(spark, sf_dir, index) -> DataFrame:
    return tl.measure_profile(
        _events(spark, sf_dir), index, USER, TS, "value", INDEX_TS, "event_id", "event_type", MEASURES
    )


def measure_profile(spark, sf_dir):
    return _profile(spark, sf_dir).select(
        USER,
        "measure",
        "last_value",
        micros("last_ts").alias("last_us"),
        micros("min_ts").alias("min_us"),
        "min_value",
        "max_value",
    )


def _view_pair(spark, sf_dir) -> DataFrame:
    columns = {
        "last_value": ("view", "last_value"),
        "min_value": ("view", "min_value"),
        "max_value": ("view", "max_value"),
    }
    return tl.pivot_profile(_profile(spark, sf_dir), USER, columns)


def change_scores(spark, sf_dir):
    pair = _view_pair(spark, sf_dir)
    return pair.select(
        USER,
        fe.change("last_value", "min_value", "relative_drop").alias("relative_drop"),
        fe.change("last_value", "min_value", "absolute_drop").alias("absolute_drop"),
        fe.change("last_value", "max_value", "relative_rise").alias("relative_rise"),
    )


def change_pairs(spark, sf_dir):
    """NULL rules of a pair: both values needed, or the baseline only."""
    pair = _view_pair(spark, sf_dir).select(
        USER,
        F.col("last_value").alias("both_last"),
        F.col("min_value").alias("both_min"),
        F.col("last_value").alias("base_last"),
        F.col("max_value").alias("base_max"),
    )
    pair = fe.keep_pair(pair, "both_last", "both_min", "both")
    return fe.keep_pair(pair, "base_last", "base_max", "base")


def _flagged_onset(index, times):
    out = index.select(USER).join(times, USER, "left")
    return out.select(
        USER,
        F.col("first_time").isNotNull().cast("int").alias("flag"),
        micros("first_time").alias("first_us"),
    )


def first_event_after(spark, sf_dir):
    """Errors above 60 are the event."""
    errors = _events(spark, sf_dir, "error").filter("value > 60")
    index = _index(spark, sf_dir)
    return _flagged_onset(index, tl.first_event_after(errors, index, USER, TS, INDEX_TS))


def new_onset(spark, sf_dir):
    """Errors above 60 are the event, before the index too."""
    errors = _events(spark, sf_dir, "error").filter("value > 60")
    index = _index(spark, sf_dir)
    return _flagged_onset(index, tl.new_onset(errors, index, USER, TS, INDEX_TS))


def merged_measurements(spark, sf_dir):
    """One measure from two sources, by the hour; ties go to the higher value."""
    hour = F.date_trunc("hour", TS).cast("timestamp_ntz").alias(TS)
    parts = [_events(spark, sf_dir, kind).select(USER, hour, "value") for kind in ("view", "click")]
    merged = tl.merge_sources(parts, "value")
    rows = tl.last_before(
        merged, _index(spark, sf_dir), USER, TS, "value", INDEX_TS, "value", out_ts="last_ts"
    )
    return rows.select(USER, "last_value", micros("last_ts").alias("last_us"))


def source_union(spark, sf_dir):
    """Set union of keys and values of three sources."""
    parts = [_events(spark, sf_dir, k).select(USER, "value") for k in ("view", "click", "signup")]
    return tl.merge_sources(parts, "value")


def _nadir(spark, sf_dir):
    rows = _extreme(spark, sf_dir, "view", "min")
    nadir = rows.select(USER, F.col("min_value").alias("nadir"), F.col("extreme_ts").alias("nadir_ts"))
    return _staged(spark, "nadir", nadir)


def prior_window_extreme(spark, sf_dir):
    nadir = _nadir(spark, sf_dir)
    prior = tl.prior_window_extreme(
        _events(spark, sf_dir, "view"), nadir, USER, TS, "value", "nadir_ts", _span()
    )
    return nadir.join(prior, USER, "left").select(
        USER,
        "nadir",
        micros("nadir_ts").alias("nadir_us"),
        "max_window",
        micros("max_window_ts").alias("max_window_us"),
        "max_prior",
        micros("max_prior_ts").alias("max_prior_us"),
        round_to(F.col("max_window") - F.col("nadir"), 4).alias("delta_window"),
        round_to(F.col("max_prior") - F.col("nadir"), 4).alias("delta_prior"),
    )


def lookback_readings(spark, sf_dir):
    """All readings in the look-back window before the nadir."""
    rows = attach_index(_events(spark, sf_dir, "view"), _nadir(spark, sf_dir), USER, "nadir_ts")
    rows = rows.filter(on_side(TS, "nadir_ts", "before"))
    rows = rows.filter(F.col(TS) >= F.col("nadir_ts") - _span())
    return rows.select(USER, "event_id", "value")


# --- every purchase as an index event --------------------------------------------


def _purchases(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir, "purchase").select(USER, "event_id", F.col(TS).alias(INDEX_TS))


def every_last_before(spark, sf_dir):
    """The last view at or before each purchase."""
    picks = {"last": sw.latest(TS, "event_id", "value")}
    found = sw.sweep(_purchases(spark, sf_dir), _events(spark, sf_dir, "view"), USER, INDEX_TS, TS, picks)
    return found.select(USER, "event_id", F.col("last.value").alias("last_value"), micros("last.at").alias("last_us"))


def every_extreme_after(spark, sf_dir):
    """Lowest and highest view at or after each purchase."""
    views = _events(spark, sf_dir, "view")
    picks = {"low": sw.lowest(TS, "value"), "high": sw.highest(views, TS, "value")}
    found = sw.sweep(_purchases(spark, sf_dir), views, USER, INDEX_TS, TS, picks, "from")
    return found.select(
        USER,
        "event_id",
        F.col("low.value").alias("min_value"),
        micros("low.at").alias("min_us"),
        F.col("high.value").alias("max_value"),
        micros("high.at").alias("max_us"),
    )


def every_prior_window(spark, sf_dir):
    """Highest view in the 72 hours before each purchase; the spans overlap."""
    views = _events(spark, sf_dir, "view")
    spans = _purchases(spark, sf_dir).withColumn("start", F.col(INDEX_TS) - _span())
    picks = {"high": sw.highest(views, TS, "value")}
    found = sw.window_extremes(spans, views, USER, "event_id", "start", INDEX_TS, TS, picks)
    return found.select(
        USER, "event_id", F.col("high.value").alias("max_window"), micros("high.at").alias("max_window_us")
    )


def refreshed_profile(spark, sf_dir):
    """The profile built on the first half of the time, then refreshed with the
    events of the second half, then with those above 150 withdrawn."""
    events = _events(spark, sf_dir)
    span = events.agg(F.min(TS).alias("low"), F.max(TS).alias("high"))
    middle = span.select(F.expr("timestampadd(MICROSECOND, timestampdiff(MICROSECOND, low, high) div 2, low)")).first()[0]
    study = ProfileAroundIndex(StageStore.for_session(spark), "purchase", "view")
    if middle is not None:
        middle = F.lit(middle).cast("timestamp_ntz")
        study.build(events.filter(F.col(TS) <= middle))
        study.fold(events.filter((F.col(TS) > middle) | F.col(TS).isNull()), events)
    else:
        study.build(events)
    withdrawn = F.coalesce(F.col("value") > 150, F.lit(False))
    study.retract(events.filter(withdrawn), events.filter(~withdrawn))
    return study.table().select(
        USER, micros(INDEX_TS).alias("index_us"), "index_value", "last_value", "min_value", micros("min_ts").alias("min_us"), "max_value"
    )


def lookback_bounded(spark, sf_dir):
    """The look-back readings from a scan cut to the span of all windows."""
    nadir = _nadir(spark, sf_dir)
    views = within_bounds(_events(spark, sf_dir, "view"), TS, nadir, F.col("nadir_ts") - _span(), "nadir_ts")
    rows = attach_index(views, nadir, USER, "nadir_ts")
    rows = rows.filter(on_side(TS, "nadir_ts", "before"))
    rows = rows.filter(F.col(TS) >= F.col("nadir_ts") - _span())
    return rows.select(USER, "event_id", "value")


def tie_audit(spark, sf_dir):
    """Users whose last view by the hour could be one of several values."""
    hour = F.date_trunc("hour", TS).cast("timestamp_ntz").alias("hour")
    views = _events(spark, sf_dir, "view").select(USER, hour, "value")
    return ties.open_picks(views, USER, "hour", "value").select(USER, micros("hour").alias("hour_us"), "n_rows")


def coverage_sketches(spark, sf_dir):
    """Users with an event per day and kind, from merged sketches of the hours."""
    hours = _events(spark, sf_dir).select(USER, "event_type", F.date_trunc("hour", TS).cast("timestamp_ntz").alias("hour"))
    hourly = _staged(spark, "hourly_sketches", sk.sketched(hours, USER, "event_type", "hour"))
    days = hourly.withColumn("day", F.datediff(F.col("hour"), F.lit("2024-01-01").cast("date")))
    return sk.coverage(sk.merged(days, "event_type", "day"), "event_type", "day")


def attrition_overlap(spark, sf_dir):
    """Users that two steps of the selection share."""
    base = _staged(spark, "base", _last_view(spark, sf_dir))
    return sk.stage_overlap(
        {
            "index": _index(spark, sf_dir),
            "baseline": base,
            "limit": co.baseline_at_least(base, "last_value", BASELINE_LIMIT),
            "error": _events(spark, sf_dir, "error").filter("value > 60"),
        },
        USER,
    )


# --- flags ---------------------------------------------------------------------

TREATMENT_RULES = {
    "has_red": like("red %"),
    "has_widget": like("%widget%"),
    "has_ring_or_rod": similar("%(ring|rod)"),
    "has_plain_gear": like("%gear%", none_of=("%small%", "%old%")),
    "has_cold": similar("col[cd] %|%new%d%t"),
}


def dictionary_flags(spark, sf_dir):
    """Rules over the part names of all line items, run once per distinct name."""
    store = StageStore.for_session(spark)
    treatments = _treatments(spark, sf_dir).select("o_orderkey", "p_name")
    return di.flags_by_dictionary(treatments, "o_orderkey", "p_name", TREATMENT_RULES, store)


DOCUMENT_RULES = {
    "has_and": like("% and %"),
    "has_number": similar("%[0-9][0-9][0-9]%"),
    "has_mail": similar("%[a-z]@[a-z]%"),
    "has_license": similar("%(license|copyright|lizenz)%"),
    "has_paren": similar("%\\(%\\)%"),
    "has_break": like("%\n%", none_of=("%the%",)),
    "has_upper": like("%The %", lower=False),
}


def history_flags(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    names = list(DOCUMENT_RULES)
    # The flagged table is the subject table too, so the flags need no join.
    return fl.flag_columns(docs, "doc_id", "text", DOCUMENT_RULES).select("doc_id", *names)


def ever_flag(spark, sf_dir):
    """Existence of a matching row as a 0/1 column of the subject table."""
    hits = fl.ever_flag(_treatments(spark, sf_dir), "o_orderkey", "p_name", RED_WIDGETS)
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    return fl.as_flag(orders, hits, "o_orderkey", "matched")


def timed_flags(spark, sf_dir):
    rules = {
        "error_before": (like("error"), "before"),
        "error_from": (similar("err%|fail%"), "from"),
        "signup_until": (like("sign%"), "until"),
        "click_ever": (like("click"), None),
    }
    index = _index(spark, sf_dir)
    rows = fl.timed_flag_rows(_events(spark, sf_dir), index, USER, TS, INDEX_TS, "event_type", rules)
    flags = fl.pivot_flags([rows], USER, list(rules))
    return fl.add_flags(index.select(USER), flags, USER, list(rules))


def treatment_before_stay(spark, sf_dir):
    """Orders with a matching part shipped before the order date."""
    index = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    rule = like("%gear%", none_of=("%small%",))
    return fl.timed_flag(
        _treatments(spark, sf_dir, "l_shipdate"), index, "o_orderkey", "l_shipdate", "o_orderdate", "p_name", rule, "before"
    )


def multi_source_flag(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    treatments = _treatments(spark, sf_dir)
    listed = fl.any_source_flag(
        [
            (treatments, {"p_name": similar("%red%(ring|rod)%"), "p_type": like("promo")}),
            (orders, {"o_orderpriority": like("%urgent%")}),
        ],
        "o_orderkey",
    )
    return fl.as_flag(orders.select("o_orderkey", "o_orderstatus"), listed, "o_orderkey", "flagged")


# --- scores and wide tables -------------------------------------------------------


def bands(spark, sf_dir):
    drop = fe.change("last_value", "min_value", "relative_drop")
    pair = _view_pair(spark, sf_dir).withColumn("drop", drop)
    return pair.select(
        USER,
        scores.bands("drop", [0.25, 0.5, 0.75], "left", default=0).alias("left_bands"),
        scores.bands("drop", [0.25, 0.5, 0.75, 1.0], "right", open_top=False).alias("right_bands"),
        scores.bands("min_value", [1, 5, 10], "right", [4, 3, 2, 1], default=0).alias("nadir_band"),
        scores.threshold_flag("drop", 0.5).alias("limit_flag"),
        scores.bleed_grade(F.col("last_value") - F.col("min_value"), F.lit(0)).alias("grade"),
    )


def _feature_wide(spark, sf_dir, index=None, profile=None) -> DataFrame:
    index = _index(spark, sf_dir) if index is None else index
    columns = {}
    for name in MEASURES:
        columns[f"last_{name}"] = (name, "last_value")
        columns[f"min_{name}"] = (name, "min_value")
        columns[f"max_{name}"] = (name, "max_value")
    profile = _profile_at(spark, sf_dir, index) if profile is None else profile
    high = {
        "error_time": (F.col("event_type") == "error") & (F.col("value") > 60),
        "signup_time": (F.col("event_type") == "signup") & (F.col("value") > 60),
    }
    onsets = tl.onset_times(_events(spark, sf_dir), index, USER, TS, INDEX_TS, high, ["error_time"])
    customer = _table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    customer = customer.withColumnRenamed("c_custkey", USER)
    return fe.assemble(index, USER, [customer, tl.pivot_profile(profile, USER, columns), onsets], unique=True)


def feature_matrix(spark, sf_dir):
    wide = _feature_wide(spark, sf_dir)
    times = [micros(c).alias(c.replace("_time", "_us")) for c in ("error_time", "signup_time")]
    kept = [c for c in wide.columns if c not in (INDEX_TS, "error_time", "signup_time")]
    return wide.select(*kept, *times)


def composite_scores(spark, sf_dir):
    wide = _feature_wide(spark, sf_dir).withColumns(
        {
            "new_error": F.col("error_time").isNotNull().cast("int"),
            "late_signup": F.col("signup_time").isNotNull().cast("int"),
            "drop": F.col("max_view") - F.col("min_view"),
        }
    )
    first = scores.earliest_time(("new_error", "error_time"), ("late_signup", "signup_time"))
    return wide.select(
        USER,
        scores.any_flag("new_error", "late_signup").alias("any_flag"),
        micros(first).alias("first_us"),
        scores.severe_event("drop", "new_error", "late_signup", F.lit(0)).alias("severe"),
        scores.bleed_grade("drop", "late_signup").alias("grade"),
        scores.weighted_pressure("last_view", "last_click", 1 / 3, 0.0).alias("mean_literal"),
        scores.weighted_pressure("last_view", "last_click", 1 / 3, 2 / 3).alias("mean_usual"),
        scores.body_mass_index("max_click", "max_view").alias("ratio_pow"),
        scores.scaled("c_acctbal", 18).alias("scaled"),
        F.coalesce("last_signup", "min_signup").alias("filled"),
        scores.recode("c_mktsegment", SEGMENTS, 9).alias("segment_code"),
    )


def _ratios(spark, sf_dir) -> DataFrame:
    index = _index(spark, sf_dir)
    base = tl.last_before(
        _events(spark, sf_dir, "view"), index, USER, TS, "value", INDEX_TS, "event_id", out="base"
    )
    base = _staged(spark, "base", index.select(USER, INDEX_TS).join(base, USER))
    readings = _events(spark, sf_dir, "view").select(USER, TS, "event_id", "value")
    return tl.ratio_series(
        readings, base, USER, TS, "value", INDEX_TS, "base"
    ).withColumns(
        {
            "ratio": round_to(divide("value", "base"), 3),
            "hour_offset": F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts) div 60"),
        }
    ).withColumn("day_offset", F.ceil(F.col("hour_offset") / 24))


def ratio_series(spark, sf_dir):
    return _ratios(spark, sf_dir).select(USER, "event_id", "ratio", "hour_offset", "day_offset")


def daily_coverage(spark, sf_dir):
    return tl.daily_coverage(_ratios(spark, sf_dir), USER, "day_offset")


def event_pipeline(spark, sf_dir):
    """Index, baseline, extremes, onsets, look-back, bands and scores of every
    user with a baseline and a nadir, in one row each. The index and the profile
    are stage tables: both have several readers, which then know their size."""
    store = StageStore.for_session(spark)
    index = store.border("index", _index_plan(spark, sf_dir))
    profile = store.border("profile", _profile_at(spark, sf_dir, index))
    wide = _feature_wide(spark, sf_dir, index, profile)
    nadir = profile.filter((F.col("measure") == "view") & F.col("min_value").isNotNull())
    nadir = nadir.select(USER, F.col("min_ts").alias("nadir_ts"))
    wide = wide.filter(F.col("last_view").isNotNull() & F.col("min_view").isNotNull())
    prior = tl.prior_window_extreme(
        _events(spark, sf_dir, "view"), nadir, USER, TS, "value", "nadir_ts", _span()
    ).select(USER, "max_window", "max_prior")
    wide = wide.join(prior, USER, "left").withColumns(
        {
            "drop": fe.change("last_view", "min_view", "relative_drop"),
            "delta_window": round_to(F.col("max_window") - F.col("min_view"), 4),
            "new_error": F.col("error_time").isNotNull().cast("int"),
            "late_signup": F.col("signup_time").isNotNull().cast("int"),
        }
    )
    excluded = _events(spark, sf_dir, "error").filter("value > 150")
    return co.exclude(wide, excluded, USER, unique=True).select(
        USER,
        micros(INDEX_TS).alias("index_us"),
        "index_value",
        "c_mktsegment",
        "last_view",
        "min_view",
        "drop",
        scores.bands("drop", [0.25, 0.5, 0.75], "left", default=0).alias("drop_band"),
        "last_click",
        "max_click",
        fe.change("last_click", "max_click", "relative_rise").alias("click_rise"),
        "new_error",
        "late_signup",
        scores.any_flag("new_error", "late_signup").alias("any_flag"),
        "max_prior",
        "delta_window",
        scores.severe_event("delta_window", "new_error", F.lit(0), "late_signup").alias("severe"),
        scores.scaled("c_acctbal", 10).alias("balance_10"),
    )


def attrition(spark, sf_dir):
    index = _index(spark, sf_dir)
    base = _staged(spark, "base", _last_view(spark, sf_dir, index=index))
    return co.attrition(
        {
            "users": _events(spark, sf_dir).select(USER),
            "index": index,
            "baseline": base,
            "limit": co.baseline_at_least(base, "last_value", BASELINE_LIMIT),
        },
        USER,
    )


QUERIES = {
    f.__name__: f
    for f in (
        subject_detail,
        age_string_cast,
        first_stay,
        pattern_like,
        pattern_not_like,
        pattern_similar,
        pattern_similar_text,
        pattern_within,
        cohort,
        exclude_ids,
        not_in_list,
        variant_count,
        variant_count_literal,
        index_event,
        last_before,
        last_before_onepass,
        extreme_after_min,
        extreme_after_max,
        measure_profile,
        baseline_threshold,
        change_scores,
        change_pairs,
        first_event_after,
        new_onset,
        merged_measurements,
        source_union,
        history_flags,
        ever_flag,
        timed_flags,
        treatment_before_stay,
        multi_source_flag,
        feature_matrix,
        bands,
        composite_scores,
        prior_window_extreme,
        lookback_readings,
        every_last_before,
        every_extreme_after,
        every_prior_window,
        refreshed_profile,
        lookback_bounded,
        tie_audit,
        coverage_sketches,
        attrition_overlap,
        dictionary_flags,
        exclude_by_flag,
        ratio_series,
        daily_coverage,
        event_pipeline,
        attrition,
    )
}
