"""0/1 flags from text rules over one or several sources.

Every source turns into (key, flag) rows; all sources together are reduced by a
single aggregate that combines on the map side.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Rule, any_of, fold_rules, tag_rows
from .joins import attach_index, on_side, within


def flag_rows(
    df: DataFrame,
    key: str,
    text: str,
    rules: dict[str, Rule],
    subjects: DataFrame | None = None,
) -> DataFrame:
    """(key, flag) rows for every rule a row's text matches; one scan per source.

    ``subjects`` restricts to listed keys, which keeps other rows out of the
    shuffle.
    """
    rows, hits = fold_rules(df.select(key, text), text, rules)
    if subjects is not None:
        rows = within(rows, subjects, key, any_of(hits.values()))
    return tag_rows(rows, "flag", hits).select(key, "flag")


def timed_flag_rows(
    df: DataFrame,
    index: DataFrame,
    key: str,
    ts: str,
    index_ts: str,
    text: str,
    rules: dict[str, tuple[Rule, str | None]],
) -> DataFrame:
    """The same with a time bound per flag: ``rules`` maps a flag to its rule
    and a side of the index (see ``on_side``), or None for any time."""
    rows, hits = fold_rules(df.select(key, ts, text), text, {name: rule for name, (rule, _) in rules.items()})
    rows = attach_index(rows, index, key, index_ts, any_of(hits.values()))
    bound = {
        name: cond if rules[name][1] is None else cond & on_side(ts, index_ts, rules[name][1])
        for name, cond in hits.items()
    }
    return tag_rows(rows, "flag", bound).select(key, "flag")


def pivot_flags(sources: Iterable[DataFrame], key: str, names: Sequence[str]) -> DataFrame:
    """One row per subject with any flag, and one 0/1 column per flag name."""
    rows = reduce(lambda a, b: a.unionByName(b), sources)
    hits = [F.max(F.when(F.col("flag") == n, 1).otherwise(0)).alias(n) for n in names]
    return rows.groupBy(key).agg(*hits)


def flag_columns(df: DataFrame, key: str, text: str, rules: dict[str, Rule]) -> DataFrame:
    """One row per key of the table itself with a 0/1 column per rule, where the
    rows to flag are also the subjects: one scan and one aggregate."""
    rows, hits = fold_rules(df.select(key, text), text, rules)
    return rows.groupBy(key).agg(*[F.max(F.when(cond, 1).otherwise(0)).alias(n) for n, cond in hits.items()])


def add_flags(cohort: DataFrame, flags: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Left-join pivoted flags; subjects without a hit get 0, never NULL."""
    joined = cohort.join(flags, key, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})


def ever_flag(df: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """Distinct keys with any matching row."""
    return df.filter(rule.matches(text)).select(key).distinct()


def timed_flag(
    df: DataFrame, index: DataFrame, key: str, ts: str, index_ts: str, text: str, rule: Rule, side: str
) -> DataFrame:
    """Distinct keys with a matching row on one side of the index."""
    rows = attach_index(df.filter(rule.matches(text)).select(key, ts), index, key, index_ts)
    return rows.filter(on_side(ts, index_ts, side)).select(key).distinct()


def any_source_flag(sources: Sequence[tuple[DataFrame, dict[str, Rule]]], key: str) -> DataFrame:
    """Distinct keys matched in any of several tables: (table, rule by text
    column). All rules of a table are tested on one pass over it."""
    parts = [
        df.filter(any_of(rule.matches(text) for text, rule in rules.items())).select(key)
        for df, rules in sources
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def as_flag(cohort: DataFrame, listed: DataFrame, key: str, name: str) -> DataFrame:
    """Existence of the key in a distinct list as a 0/1 column."""
    marked = listed.select(key).withColumn(name, F.lit(1))
    joined = cohort.join(marked, key, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
