"""Readings and events seen from each subject's index time.

All operators attach the index time to the long table once and then aggregate
per subject. ``min``, ``max``, ``min_by`` and ``max_by`` combine on the map side,
so a subject with a third of all rows sends one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import later_first
from ..functions.patterns import Rule, any_of, fold_rules, tag_rows
from .joins import attach_index, fits_broadcast, on_side, subject_join


def order_of(ts: str, tie: str | Sequence[str]) -> Column:
    return F.struct(ts, *([tie] if isinstance(tie, str) else tie))


def _known(readings: DataFrame, value: str, *columns: str) -> DataFrame:
    """Readings with a value, cut to the columns an operator reads: the skew-safe
    join looks at whole rows, so other columns would be scanned for nothing."""
    return readings.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*columns, value]))


def index_event(
    events: DataFrame,
    key: str,
    ts: str,
    tie: str | Sequence[str],
    carry: Sequence[str] = (),
    unless: Column | None = None,
) -> DataFrame:
    """Earliest event per subject with the columns it carries. Events without a
    time are no index events. Subjects with any event that meets ``unless`` are
    left out."""
    order = F.when(F.col(ts).isNotNull(), order_of(ts, tie))
    aggs = [F.min_by(F.struct(ts, *carry), order).alias("_first")]
    if unless is not None:
        aggs.append(F.max(unless.cast("int")).alias("_unless"))
    first = events.groupBy(key).agg(*aggs).filter(F.col("_first")[ts].isNotNull())
    if unless is not None:
        first = first.filter(F.coalesce(F.col("_unless"), F.lit(0)) == 0)
    return first.select(key, *[F.col("_first")[c].alias(c) for c in (ts, *carry)])


def last_before(
    readings: DataFrame,
    index: DataFrame,
    key: str,
    ts: str,
    value: str,
    index_ts: str,
    tie: str | Sequence[str],
    inclusive: bool = True,
    out: str = "last_value",
    out_ts: str | None = None,
    method: str = "aggregate",
) -> DataFrame:
    """Latest reading at or before the index; ties go to the highest ``tie``.

    ``aggregate`` keeps one running row per subject. ``window`` ranks instead;
    it gives the same rows and serves as a check.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    seen = attach_index(_known(readings, value, key, ts, *ties), index, key, index_ts)
    seen = seen.filter(on_side(ts, index_ts, "until" if inclusive else "before"))
    picked = [F.col(value).alias(out)] + ([F.col(ts).alias(out_ts)] if out_ts else [])
    names = [out] + ([out_ts] if out_ts else [])
    if method == "window":
        by = [F.col(c).desc_nulls_last() for c in (ts, *ties)]
        rank = F.row_number().over(Window.partitionBy(key).orderBy(*by))
        return seen.withColumn("_rank", rank).filter("_rank = 1").select(key, *picked)
    last = F.max_by(F.struct(*picked), order_of(ts, tie)).alias("_last")
    return seen.groupBy(key).agg(last).select(key, *[F.col("_last")[n].alias(n) for n in names])


def extreme_after(
    readings: DataFrame,
    index: DataFrame,
    key: str,
    ts: str,
    value: str,
    index_ts: str,
    which: str = "min",
    inclusive: bool = True,
    out: str | None = None,
    out_ts: str | None = None,
) -> DataFrame:
    """Lowest or highest reading at or after the index, with the earliest time
    it was reached if ``out_ts`` asks for it."""
    out = out or f"{which}_value"
    seen = attach_index(_known(readings, value, key, ts), index, key, index_ts)
    seen = seen.filter(on_side(ts, index_ts, "from" if inclusive else "after"))
    aggs = [(F.min if which == "min" else F.max)(value).alias(out)]
    if out_ts:
        aggs.append(extreme_time(seen, ts, value, which).alias(out_ts))
    return seen.groupBy(key).agg(*aggs)


def extreme_time(df: DataFrame, ts: str, value: str, which: str) -> Column:
    """Earliest time of the lowest or highest value of a group."""
    if which == "min":
        return F.min_by(ts, F.struct(value, ts))
    return F.max_by(ts, F.struct(F.col(value), later_first(df, ts)))


def measure_rows(df: DataFrame, text: str, measures: dict[str, Rule]) -> DataFrame:
    """One row per reading and measure whose rule its name matches."""
    if all(rule.exact and not rule.lower for rule in measures.values()):
        # Plain equalities exclude one another and can be pushed into the scan.
        names = {rule.pattern: name for name, rule in measures.items()}
        marks = [F.when(F.col(text) == p, F.lit(n)) for p, n in names.items()]
        return df.filter(F.col(text).isin(list(names))).withColumn("measure", F.coalesce(*marks))
    df, hits = fold_rules(df, text, measures)
    return tag_rows(df, "measure", hits)


def measure_profile(
    readings: DataFrame,
    index: DataFrame,
    key: str,
    ts: str,
    value: str,
    index_ts: str,
    tie: str | Sequence[str],
    text: str,
    measures: dict[str, Rule],
) -> DataFrame:
    """Baseline and extremes of every measure in one pass over the readings.

    One row per subject and measure: the last value at or before the index, and
    the lowest (with its earliest time) and highest value at or after it. The
    group key includes the measure, so the plan does not widen with their
    number and one subject's readings spread over several tasks.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    known = _known(readings, value, key, ts, text, *ties)
    if fits_broadcast(index.select(key, index_ts)):
        seen = measure_rows(attach_index(known, index, key, index_ts), text, measures)
    else:
        rows = measure_rows(known, text, measures).drop(text)
        seen = attach_index(rows, index, key, index_ts)
    before, after = on_side(ts, index_ts, "until"), on_side(ts, index_ts, "from")
    return seen.groupBy(key, "measure").agg(
        F.max_by(value, F.when(before, order_of(ts, tie))).alias("last_value"),
        F.max(F.when(before, F.col(ts))).alias("last_ts"),
        F.min_by(ts, F.when(after, F.struct(value, ts))).alias("min_ts"),
        F.min(F.when(after, F.col(value))).alias("min_value"),
        F.max(F.when(after, F.col(value))).alias("max_value"),
    )


def pivot_profile(
    profile: DataFrame, key: str, columns: dict[str, tuple[str, str]]
) -> DataFrame:
    """Wide form: ``columns`` maps an output name to (measure, profile column)."""
    picks = [
        F.max(F.when(F.col("measure") == measure, F.col(source))).alias(name)
        for name, (measure, source) in columns.items()
    ]
    wanted = sorted({measure for measure, _ in columns.values()})
    return profile.filter(F.col("measure").isin(wanted)).groupBy(key).agg(*picks)


def onset_times(
    events: DataFrame,
    index: DataFrame,
    key: str,
    ts: str,
    index_ts: str,
    rules: dict[str, Column],
    new_only: Sequence[str] = (),
    ever: dict[str, Column] | None = None,
) -> DataFrame:
    """First time of each kind of event at or after the index, in one pass.

    ``rules`` maps an output column to the condition of its events. Names in
    ``new_only`` are new-onset events: a subject with such an event strictly
    before the index gets no time. ``ever`` adds 0/1 columns for events at any
    time. Subjects without any time or flag are left out.
    """
    ever = ever or {}
    if not fits_broadcast(index.select(key, index_ts)):
        # The outcome of a rule is smaller to shuffle than what it looks at.
        every = {**rules, **ever}
        marks = [cond.alias(f"_is_{name}") for name, cond in every.items()]
        events = events.filter(any_of(every.values())).select(key, ts, *marks)
        rules, ever = ({name: F.col(f"_is_{name}") for name in some} for some in (rules, ever))
    seen = attach_index(events, index, key, index_ts)
    before, after = on_side(ts, index_ts, "before"), on_side(ts, index_ts, "from")
    aggs = []
    for name, cond in rules.items():
        aggs.append(F.min(F.when(cond & after, F.col(ts))).alias(name))
        if name in new_only:
            aggs.append(F.max(F.when(cond & before, F.lit(1))).alias(f"_prior_{name}"))
    aggs += [F.max(F.when(cond, 1).otherwise(0)).alias(name) for name, cond in ever.items()]
    times = seen.groupBy(key).agg(*aggs)
    kept = {
        name: F.when(F.col(f"_prior_{name}").isNull(), F.col(name)) if name in new_only else F.col(name)
        for name in rules
    }
    known = [F.col(n).isNotNull() for n in rules] + [F.col(n) == 1 for n in ever]
    return times.select(key, *[c.alias(n) for n, c in kept.items()], *ever).filter(any_of(known))


def first_event_after(events, index, key, ts, index_ts, out="first_time") -> DataFrame:
    """Time of the first event at or after the index."""
    return onset_times(events, index, key, ts, index_ts, {out: F.lit(True)})


def new_onset(events, index, key, ts, index_ts, out="first_time") -> DataFrame:
    """The same, without subjects that had the event before the index."""
    return onset_times(events, index, key, ts, index_ts, {out: F.lit(True)}, [out])


def merge_sources(
    sources: Sequence[DataFrame], value: str, distinct: bool = True
) -> DataFrame:
    """The same measure from several tables, without NULLs. Equal rows collapse
    unless ``distinct`` is off, which is safe ahead of a minimum, maximum or
    latest value."""
    out = sources[0]
    for part in sources[1:]:
        out = out.unionByName(part)
    out = out.filter(F.col(value).isNotNull())
    return out.distinct() if distinct else out


def prior_window_extreme(
    readings: DataFrame,
    anchor: DataFrame,
    key: str,
    ts: str,
    value: str,
    anchor_ts: str,
    lookback: Column | int,
) -> DataFrame:
    """Highest reading in ``[anchor - lookback, anchor)`` and the highest before
    the anchor at all, each with its earliest time. One pass, two conditional
    aggregates; subjects without a reading before the anchor are left out."""
    seen = attach_index(_known(readings, value, key, ts), anchor, key, anchor_ts)
    seen = seen.filter(on_side(ts, anchor_ts, "before"))
    span = lookback if isinstance(lookback, Column) else F.lit(lookback)
    recent = F.col(ts) >= F.col(anchor_ts) - span
    order = F.struct(F.col(value), later_first(seen, ts))
    return seen.groupBy(key).agg(
        F.max(F.when(recent, F.col(value))).alias("max_window"),
        F.max_by(ts, F.when(recent, order)).alias("max_window_ts"),
        F.max(value).alias("max_prior"),
        F.max_by(ts, order).alias("max_prior_ts"),
    )


def ratio_series(
    readings: DataFrame,
    baseline: DataFrame,
    key: str,
    ts: str,
    value: str,
    index_ts: str,
    base: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Readings at or after the index next to the subject's baseline columns."""
    rows = subject_join(
        readings.filter(F.col(value).isNotNull()), baseline.select(key, index_ts, base, *carry), key
    )
    return rows.filter(on_side(ts, index_ts, "from"))


def daily_coverage(series: DataFrame, key: str, day: str) -> DataFrame:
    """Number of subjects with a reading per day bucket, in day order."""
    days = series.select(key, day).distinct()
    return days.groupBy(day).agg(F.count(F.lit(1)).alias("subjects")).orderBy(day)
