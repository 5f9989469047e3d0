"""Banding, recoding and composite scores as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col, divide, round_to
from .patterns import Rule


def first_match(cases: Iterable[tuple[Column, object]], default=None) -> Column:
    """Value of the first true case; a NULL condition counts as not met."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(F.lit(default))


def bands(
    value,
    edges: Sequence[float],
    closed: str = "left",
    labels: Sequence[int] | None = None,
    default: int | None = None,
    open_top: bool = True,
) -> Column:
    """Ordered classes between ascending ``edges``.

    ``closed`` names the side on which a class includes its edge: ``left`` puts
    a value equal to an edge into the class above it, ``right`` into the class
    below. Classes are numbered from 1, or take ``labels`` in ascending order of
    value. NULL gives ``default``, and so do values above the last edge when
    ``open_top`` is off.
    """
    if closed not in ("left", "right"):
        raise ValueError("closed must be 'left' or 'right'")
    col = as_col(value)
    names = list(labels or range(1, len(edges) + 1 + open_top))
    below = [col < F.lit(e) if closed == "left" else col <= F.lit(e) for e in edges]
    cases = list(zip(below, names))
    if open_top:
        cases.append((col.isNotNull(), names[len(edges)]))
    return first_match(cases, default)


def threshold_flag(value, limit: float) -> Column:
    """1 at or above the limit, 0 below, NULL when unknown."""
    col = as_col(value)
    return F.when(col >= F.lit(limit), 1).when(col < F.lit(limit), 0)


def recode(text, cases: Iterable[tuple[Rule, object]], default=None) -> Column:
    """Ordered text recoding; unmatched text gives ``default``."""
    return first_match([(rule.matches(text), value) for rule, value in cases], default)


def recode_pair(cases: Iterable[tuple[Column | str, Rule, object]]) -> Column:
    """Ordered recoding whose cases may look at different text columns."""
    return first_match([(rule.matches(text), value) for text, rule, value in cases])


def numeric_age(text, capped: float) -> Column:
    """Age given as text. A text with ``>`` is a capped age; a text that is no
    number gives NULL."""
    col = as_col(text)
    return F.when(col.contains(">"), F.lit(capped).cast("decimal(10,2)")).otherwise(
        col.try_cast("decimal(10,2)")
    )


def body_mass_index(weight, height_cm) -> Column:
    """Weight over squared height in metres, two digits; NULL without height."""
    metres = as_col(height_cm).cast("double") / F.lit(100.0)
    return round_to(divide(weight, F.pow(metres, F.lit(2.0))), 2)


def weighted_pressure(
    systolic, diastolic, sys_weight: float, dia_weight: float, whole: bool = False
) -> Column:
    """Weighted mean of two pressures, four digits; NULL if either is NULL.
    ``whole`` cuts both shares to whole numbers, as for integer columns; weights
    that are the inverse of a whole number divide exactly."""

    def share(value, weight: float) -> Column:
        col = as_col(value).cast("double")
        divisor = round(1 / weight) if weight else 0
        exact = divisor and abs(1 / divisor - weight) < 1e-12
        if not whole:
            return col * F.lit(weight)
        part = col / F.lit(float(divisor)) if exact else col * F.lit(weight)
        return F.when(part < 0, F.ceil(part)).otherwise(F.floor(part)).cast("double")

    return round_to(share(systolic, sys_weight) + share(diastolic, dia_weight), 4)


def scaled(value, divisor: float, digits: int = 3) -> Column:
    return round_to(divide(value, F.lit(divisor)), digits)


def any_flag(*flags) -> Column:
    """1 if any flag is 1, 0 if all are 0, NULL otherwise."""
    cols = [as_col(f) for f in flags]
    some, none = cols[0] == 1, cols[0] == 0
    for col in cols[1:]:
        some, none = some | (col == 1), none & (col == 0)
    return F.when(some, 1).when(none, 0)


def earliest_time(*flag_times: tuple[object, object]) -> Column:
    """Smallest time among the events whose flag is set."""
    times = [F.when(as_col(flag) == 1, as_col(time)) for flag, time in flag_times]
    return F.least(*times) if len(times) > 1 else times[0]


def bleed_grade(drop, outcome) -> Column:
    """Grade 1 to 3 by the size of a drop; a set outcome flag gives 3, but only
    where the drop itself decides nothing (it is NULL or exactly 3)."""
    col = as_col(drop)
    return first_match(
        [
            (col <= 0, None),
            (col < 3, 1),
            ((col > 3) & (col <= 5), 2),
            (col > 5, 3),
            (as_col(outcome) == 1, 3),
        ]
    )


def severe_event(drop, witnessed, outcome, transfused) -> Column:
    """1 if any of four conditions holds: a witnessed event with a drop above 3,
    the outcome flag, a drop above 5, or a transfusion."""
    col = as_col(drop)
    return first_match(
        [
            ((as_col(witnessed) == 1) & (col > 3), 1),
            (as_col(outcome) == 1, 1),
            (col > 5, 1),
            (as_col(transfused) == 1, 1),
        ],
        0,
    )
