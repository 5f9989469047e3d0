"""Joins of a long event table with a table of one row per subject."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# More rows of one key than this are spread over several tasks; the session
# setting below goes first.
HOT_ROWS = 5_000_000
HOT_ROWS_SETTING = "spark.anchorset.hotRows"

_PARTS, _SALT, _COPIES, _COPY = "_hot_parts", "_hot_salt", "_hot_copies", "_hot_copy"


def keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def planned_bytes(df: DataFrame) -> int | None:
    """Spark's own size estimate for a DataFrame, or None where the client
    cannot ask for it."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = text.strip().lower()
    if len(text) > 1 and text.endswith("b") and text[-2] in units:
        text = text[:-1]
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def fits_broadcast(df: DataFrame) -> bool:
    size = planned_bytes(df)
    return size is not None and size <= broadcast_limit(df)


def session_hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))


def hot_keys(facts: DataFrame, on: list[str], hot_rows: int) -> DataFrame | None:
    """(key, parts) of the keys with at least ``hot_rows`` facts, NULL included,
    as a local table; None if there are none. There are at most
    ``total rows / hot_rows`` of them, which bounds what reaches the driver."""
    counted = facts.groupBy(*on).agg(F.count(F.lit(1)).alias(_PARTS)).filter(F.col(_PARTS) >= hot_rows)
    found = counted.select(*on, F.ceil(F.col(_PARTS) / hot_rows).cast("int").alias(_PARTS))
    rows = found.collect()
    return facts.sparkSession.createDataFrame(rows, found.schema) if rows else None


def subject_join(
    facts: DataFrame,
    subjects: DataFrame,
    key: str | Sequence[str],
    how: str = "inner",
    hot_rows: int | None = 0,
) -> DataFrame:
    """Join many fact rows per key with a subject table of few rows per key.

    When Spark's size estimate lets it broadcast the subject side, the facts are
    not shuffled and skew cannot matter: the plain join is returned. Otherwise a
    key may hold more fact rows than one task should take, so the facts are
    counted per key first (a job of its own). Without a key of ``hot_rows`` facts
    the plain join is returned. Else the facts of hot keys are joined apart:
    equal rows are put together with their number, the rest is cut into
    ``count / hot_rows`` parts by a hash of the whole row, subject rows are copied
    once per part, and the number is unfolded after the join. So neither a key
    nor a row that is repeated goes to one task, and neither do NULL keys, which
    match nothing. Every row is kept.

    ``how`` is inner, left, left_semi or left_anti, seen from the facts.
    ``hot_rows`` 0 stands for the session's setting (``spark.anchorset.hotRows``,
    else ``HOT_ROWS``); with None the caller states that no key has many facts,
    and nothing is counted.
    """
    on = keys(key)
    if hot_rows is None or fits_broadcast(subjects):
        return facts.join(subjects, on, how)
    hot = hot_keys(facts, on, hot_rows or session_hot_rows(facts))
    if hot is None:
        return facts.join(subjects, on, how)
    names = facts.columns
    listed = F.broadcast(hot.withColumnsRenamed({k: f"_hot_{k}" for k in on}))
    match = reduce(lambda a, b: a & b, (facts[k].eqNullSafe(listed[f"_hot_{k}"]) for k in on))
    cold = facts.join(listed, match, "left_anti").join(subjects, on, how)
    some = facts.join(listed, match, "inner").select(*names, _PARTS)
    if any(isinstance(f.dataType, T.MapType) for f in facts.schema):
        some = some.withColumn(_COPIES, F.lit(1).cast("long"))
    else:
        some = some.groupBy(*names, _PARTS).agg(F.count(F.lit(1)).alias(_COPIES))
    some = some.withColumn(_SALT, F.pmod(F.xxhash64(*names), F.col(_PARTS)).cast("int")).drop(_PARTS)
    parts = F.explode(F.sequence(F.lit(0), F.col(_PARTS) - 1))
    copied = subjects.join(F.broadcast(hot), on, "inner").withColumn(_SALT, parts).drop(_PARTS)
    joined = some.join(copied, [*on, _SALT], how).drop(_SALT)
    unfolded = joined.withColumn(_COPY, F.explode(F.sequence(F.lit(1).cast("long"), F.col(_COPIES))))
    return cold.unionByName(unfolded.drop(_COPY, _COPIES))


def within(
    facts: DataFrame, subjects: DataFrame, key: str | Sequence[str], only: Column | None = None
) -> DataFrame:
    """Facts of the listed subjects; see ``attach_index`` for ``only``."""
    listed = subjects.select(*keys(key))
    if not fits_broadcast(listed):
        listed = listed.distinct()
        facts = facts if only is None else facts.filter(only)
    return subject_join(facts, listed, key, "left_semi")


def attach_index(
    facts: DataFrame,
    index: DataFrame,
    key: str,
    index_ts: str,
    only: Column | None = None,
) -> DataFrame:
    """Add the subject's index time to its facts.

    ``only`` is a condition that every fact of interest meets and that is checked
    later on anyway. It is applied up front where the facts have to be shuffled.
    Where the index is broadcast, looking up the subject is cheaper than
    matching texts and drops most rows, so it comes first.
    """
    subjects = index.select(key, index_ts)
    if only is not None and not fits_broadcast(subjects):
        facts = facts.filter(only)
    return subject_join(facts, subjects, key)


def on_side(ts: str, index_ts: str, side: str) -> Column:
    """Time condition against the index: ``before`` (strict), ``until``
    (inclusive), ``from`` (inclusive) or ``after`` (strict)."""
    a, b = F.col(ts), F.col(index_ts)
    sides = {"before": a < b, "until": a <= b, "from": a >= b, "after": a > b}
    return sides[side]
