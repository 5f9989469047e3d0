"""Values as of, and extremes around, any number of index events per subject.

``timeline`` aggregates around one index event per subject. Here a subject may
have many, so that attaching each to all facts would multiply rows. Instead facts
and anchors are put into one table, ordered by time within their key, and swept
once: a running maximum or minimum passes each anchor the best fact before (or,
swept backwards, after) it. Rows shuffled are facts plus anchors, whatever the
number of pairs between them.

A key with more than ``part_rows`` rows is cut into parts along time. Each part is
swept by itself; a small table with the best fact of every part, accumulated over
the parts before it, is carried over to the next ones. So no key has to fit one
task. The cuts reach the driver: at most two times ``rows / part_rows``, plus one
per such key.

Rows: facts without key or time are seen by no anchor; anchors without either are
kept, with nothing found. Repeated anchors are repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import later_first, micros
from .joins import HOT_ROWS, HOT_ROWS_SETTING, keys

# Fixed order of rows at one instant: what must not see the fact, the fact, what must.
SIDES = {"before": 0, "from": 0, "until": 2, "after": 2}
_FACT = 1
_FORWARD = ("before", "until")


@dataclass(frozen=True)
class Pick:
    """The fact with the greatest (or least) value of a struct, which starts with
    what is compared; a null is no candidate."""

    best: Column
    least: bool = False

    def of(self, column) -> Column:
        return (F.min if self.least else F.max)(column)

    def either(self, a: Column, b: Column) -> Column:
        return F.least(a, b) if self.least else F.greatest(a, b)


def latest(ts: str, tie: str | Sequence[str], value: str) -> Pick:
    """The last fact; equal times go to the highest tie-break."""
    ties = [tie] if isinstance(tie, str) else list(tie)
    fields = [F.col(ts).alias("at"), *(F.col(c).alias(f"tie_{i}") for i, c in enumerate(ties)), F.col(value).alias("value")]
    return Pick(F.when(F.col(value).isNotNull(), F.struct(*fields)))


def lowest(ts: str, value: str) -> Pick:
    """The lowest value, at its earliest time."""
    found = F.struct(F.col(value).alias("value"), F.col(ts).alias("at"))
    return Pick(F.when(F.col(value).isNotNull(), found), least=True)


def highest(facts: DataFrame, ts: str, value: str) -> Pick:
    """The highest value, at its earliest time."""
    found = F.struct(F.col(value).alias("value"), later_first(facts, ts).alias("order"), F.col(ts).alias("at"))
    return Pick(F.when(F.col(value).isNotNull(), found))


def _present(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def part_cuts(rows: DataFrame, on: list[str], at: str, part_rows: int) -> DataFrame | None:
    """(key, cuts in ascending order) of the keys with more than ``part_rows``
    rows, as a local table; None if there are none. A key of n rows gets the next
    power of two of n / part_rows parts of about equal size."""
    counted = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > part_rows).collect()
    if not counted:
        return None
    spark, key_type = rows.sparkSession, T.StructType([rows.schema[c] for c in on])
    sizes: dict[int, list] = {}
    for row in counted:
        sizes.setdefault(1 << (-(-row["_n"] // part_rows) - 1).bit_length(), []).append(tuple(row[c] for c in on))
    cuts = []
    for parts, some in sizes.items():
        listed = F.broadcast(spark.createDataFrame(some, key_type))
        fractions = [i / parts for i in range(1, parts)]
        found = rows.join(listed, on).groupBy(*on).agg(F.percentile_approx(at, fractions, 100 * parts).alias("_cuts"))
        cuts += [(*(r[c] for c in on), sorted(set(r["_cuts"]))) for r in found.collect()]
    return spark.createDataFrame(cuts, key_type.add("_cuts", T.ArrayType(rows.schema[at].dataType)))


def sweep(
    anchors: DataFrame,
    facts: DataFrame,
    key: str | Sequence[str],
    anchor_ts: str,
    ts: str,
    picks: dict[str, Pick],
    side: str | Column = "until",
    part_rows: int = 0,
) -> DataFrame:
    """The anchors with one struct column per pick: the best fact of their key on
    ``side`` of them, or null. The side (``before`` strictly, ``until``, ``from``
    or ``after`` strictly) may be a column, that differs from row to row.
    ``part_rows`` 0 stands for the session's ``spark.anchorset.hotRows``."""
    on = keys(key)
    way = F.lit(side) if isinstance(side, str) else side
    ways = {side in _FORWARD} if isinstance(side, str) else {True, False}
    order = F.coalesce(*(F.when(way == name, F.lit(place)) for name, place in SIDES.items()))
    seen = facts.filter(_present(*on, ts)).select(
        *on, F.col(ts).alias("_at"), F.lit(_FACT).alias("_order"), F.lit(None).cast("boolean").alias("_forward"),
        *(pick.best.alias(f"_best_{name}") for name, pick in picks.items()),
    )
    kinds = {name: seen.schema[f"_best_{name}"].dataType for name in picks}
    nothing = [F.lit(None).cast(kind).alias(f"_best_{name}") for name, kind in kinds.items()]
    row = F.struct(*anchors.columns).alias("_row")
    placed = anchors.filter(_present(*on, anchor_ts)).select(
        *on, F.col(anchor_ts).alias("_at"), order.alias("_order"), way.isin(*_FORWARD).alias("_forward"), *nothing, row
    )
    lost = anchors.filter(~_present(*on, anchor_ts)).select(row, *nothing)
    rows = seen.withColumn("_row", F.lit(None).cast(placed.schema["_row"].dataType)).unionByName(placed)

    cuts = part_cuts(rows.select(*on, "_at"), on, "_at", part_rows or int(rows.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS))))
    if cuts is None:
        rows = rows.withColumn("_part", F.lit(0))
    else:
        rows = rows.join(F.broadcast(cuts), on, "left")
        part = F.size(F.filter("_cuts", lambda c: c <= F.col("_at")))
        rows = rows.withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(part)).drop("_cuts")

    within = Window.partitionBy(*on, "_part").rowsBetween(Window.unboundedPreceding, 0)
    forward = within.orderBy(F.col("_at").asc(), F.col("_order").asc())
    backward = within.orderBy(F.col("_at").desc(), F.col("_order").desc())
    swept = {}
    for name, pick in picks.items():
        best = f"_best_{name}"
        found = [F.when(F.col("_forward") == ahead, pick.of(best).over(forward if ahead else backward)) for ahead in sorted(ways)]
        swept[best] = F.coalesce(*found)
    found = rows.select(*on, "_part", "_forward", "_row", *(c.alias(n) for n, c in swept.items())).filter("_row is not null")
    if cuts is not None:
        found = _carried(found, rows.filter("_row is null"), cuts, on, picks)
    every = found.select("_row", *swept).unionByName(lost)
    return every.select("_row.*", *(F.col(f"_best_{name}").alias(name) for name in picks))


def _carried(found: DataFrame, seen: DataFrame, cuts: DataFrame, on: list[str], picks: dict[str, Pick]) -> DataFrame:
    """What was found within parts, or in the parts before or behind if that is better."""
    parts = cuts.select(*on, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_part"))
    listed = F.broadcast(cuts.select(*on))
    best = [pick.of(f"_best_{name}").alias(f"_best_{name}") for name, pick in picks.items()]
    own = parts.join(seen.join(listed, on, "left_semi").groupBy(*on, "_part").agg(*best), [*on, "_part"], "left")
    others = {
        True: Window.partitionBy(*on).orderBy(F.col("_part").asc()).rowsBetween(Window.unboundedPreceding, -1),
        False: Window.partitionBy(*on).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1),
    }
    carry = own.select(
        *on, "_part",
        *(pick.of(f"_best_{name}").over(window).alias(f"_{ahead}_{name}") for name, pick in picks.items() for ahead, window in others.items()),
    )
    both = found.join(F.broadcast(carry), [*on, "_part"], "left")
    better = {
        f"_best_{name}": pick.either(F.col(f"_best_{name}"), F.when(F.col("_forward"), F.col(f"_True_{name}")).otherwise(F.col(f"_False_{name}")))
        for name, pick in picks.items()
    }
    return both.select("_row", *(c.alias(n) for n, c in better.items()))


# --- windows ----------------------------------------------------------------------


def _ticks(df: DataFrame, name: str) -> Column:
    """A time as a whole number: microseconds, or the number that it is."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return micros(F.col(name).cast("timestamp_ntz"))
    return F.col(name).cast("bigint")


def window_extremes(
    windows: DataFrame,
    facts: DataFrame,
    key: str | Sequence[str],
    ids: str | Sequence[str],
    start: str,
    end: str,
    ts: str,
    picks: dict[str, Pick],
    part_rows: int = 0,
) -> DataFrame:
    """The windows with the best facts of their key in ``[start, end)``.

    ``ids`` identify a window; each may belong to any number of others' spans. A
    window of length between 2**n and 2**(n+1) ticks meets two or three bins of
    2**n: it takes what lies at or after its start in the first one, before its
    end in the last one, and a whole bin between. Facts are binned once for every
    n in use (a table of at most 63 numbers), so overlapping windows share their
    bins and rows grow with facts plus windows. Empty windows find nothing."""
    on, id_cols = keys(key), keys(ids)
    spans = windows.select(*on, *id_cols, _ticks(windows, start).alias("_start"), _ticks(windows, end).alias("_end"))
    length = F.col("_end") - F.col("_start")
    spans = spans.filter(length > 0).withColumn("_level", F.length(F.conv(length.cast("string"), 10, 2)) - 1)
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())
    wanted = F.array(*(F.lit(level) for level in levels)) if levels else F.array().cast("array<int>")
    spans = spans.withColumns({"_first": F.expr("shiftright(_start, _level)"), "_last": F.expr("shiftright(_end, _level)")})
    probe = lambda b, at, side: F.struct(b.alias("_bin"), at.alias("_probe"), F.lit(side).alias("_side"))
    whole = probe(F.col("_first") + 1, F.expr("shiftleft(_first + 1, _level)"), "from")
    every = F.array(
        probe(F.col("_first"), F.col("_start"), "from"),
        F.when(F.col("_last") - F.col("_first") == 2, whole),
        probe(F.col("_last"), F.col("_end"), "before"),
    )
    probes = spans.select(*on, *id_cols, "_level", F.explode(F.array_compact(every)).alias("_p"))
    probes = probes.select(*on, *id_cols, "_level", "_p.*")
    binned = facts.select(*facts.columns, _ticks(facts, ts).alias("_tick"), F.explode(wanted).alias("_level"))
    binned = binned.withColumn("_bin", F.expr("shiftright(_tick, _level)"))
    found = sweep(probes, binned, [*on, "_level", "_bin"], "_probe", "_tick", picks, F.col("_side"), part_rows)
    best = found.groupBy(*id_cols).agg(*(pick.of(name).alias(name) for name, pick in picks.items()))
    return windows.join(best, id_cols, "left")
