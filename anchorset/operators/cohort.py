"""Cohort side: subject table, first stay, selection, exclusion, attrition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import Rule
from .joins import fits_broadcast, keys, subject_join, within


def one_per_key(df: DataFrame, key: str | Sequence[str], **values: Column) -> DataFrame:
    """Reduce a dimension to one row per key before joining it, so that no join
    multiplies rows. ``values`` are aggregates."""
    return df.groupBy(*keys(key)).agg(*[c.alias(n) for n, c in values.items()])


def subject_detail(
    subjects: DataFrame,
    dims: Sequence[tuple[DataFrame, str | Sequence[str]]] = (),
    derived: dict[str, Column] | None = None,
    own: Sequence[tuple[DataFrame, str | Sequence[str]]] = (),
) -> DataFrame:
    """Left-join dimensions (one row per key each) and add derived columns.

    ``dims`` are shared by many subjects; ``own`` tables are keyed by the
    subject itself, so their join cannot be skewed.
    """
    out = subjects
    for dim, key in dims:
        out = subject_join(out, dim, key, "left")
    for table, key in own:
        out = out.join(table, keys(key), "left")
    return out.withColumns(derived or {})


def first_per(
    df: DataFrame, partition: str | Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """First row of each partition by ``order`` (NULLs last), which has to be a
    total order. Spark prunes to one row per partition before the shuffle."""
    by = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    rank = F.row_number().over(Window.partitionBy(*keys(partition)).orderBy(*by))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def match_rule(
    df: DataFrame,
    text: str,
    rule: Rule,
    subjects: DataFrame | None = None,
    key: str | None = None,
    value: str | None = None,
) -> DataFrame:
    """Rows whose text matches; optionally of listed subjects and with a value."""
    out = df.filter(rule.matches(text))
    if value is not None:
        out = out.filter(F.col(value).isNotNull())
    return out if subjects is None else within(out, subjects, key)


def select_cohort(
    events: DataFrame,
    subjects: DataFrame,
    key: str,
    text: str,
    rule: Rule,
    age: str,
    min_age: float,
) -> DataFrame:
    """Matching events joined with subjects of at least ``min_age``; a NULL age
    drops the row."""
    adults = subjects.filter(F.col(age) >= F.lit(min_age))
    return subject_join(match_rule(events, text, rule), adults, key)


def exclude(
    df: DataFrame, listed: DataFrame, key: str, null_aware: bool = False, unique: bool = False
) -> DataFrame:
    """Rows whose key is not listed. ``unique`` states that ``df`` has one row
    per key, so that no key needs splitting.

    By default NULL list entries are ignored. ``null_aware`` gives ``NOT IN``
    as SQL defines it: a NULL in the list removes every row, and a row with a
    NULL key stays only if the list is empty. The list is read through an
    aggregate of two counters, so it never has to fit one task.
    """
    keys_only = listed.select(key).filter(F.col(key).isNotNull())
    if not fits_broadcast(keys_only):
        keys_only = keys_only.distinct()
    hot_rows = None if unique else 0
    out = subject_join(df, keys_only, key, "left_anti", hot_rows)
    if not null_aware:
        return out
    total = listed.agg(F.count(F.lit(1))).scalar()
    known = listed.agg(F.count(F.col(key))).scalar()
    return out.filter((total == known) & (F.col(key).isNotNull() | (total == 0)))


def keys_with_variant_count(
    df: DataFrame, group: str | Sequence[str], variant: str | Sequence[str], n: int, key: str
) -> DataFrame:
    """Keys that have a group with exactly ``n`` distinct variants.

    Grouping by key and variant makes every count 1; grouping by the key alone
    counts its variants.
    """
    cols = list(dict.fromkeys([*keys(group), *keys(variant)]))
    counted = df.select(*cols).distinct().groupBy(*keys(group)).agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter(F.col("_n") == n).select(key).distinct()


def keys_without(df: DataFrame, key: str, removed: Column) -> DataFrame:
    """Keys none of whose rows is removed, by one aggregate; an unknown outcome
    removes nothing."""
    hit = F.max(F.coalesce(removed, F.lit(False))).alias("_removed")
    return df.groupBy(key).agg(hit).filter(~F.col("_removed")).select(key)


def variants_and_removal(df: DataFrame, key: str, variant: str, removed: Column) -> DataFrame:
    """(key, n_variants, removed): the number of distinct variants of each key
    and whether any row of it is removed."""
    hit = F.max(F.coalesce(removed, F.lit(False))).alias("removed")
    variants = df.groupBy(key, variant).agg(hit)
    return variants.groupBy(key).agg(F.count(variant).alias("n_variants"), F.max("removed").alias("removed"))


def union_keys(*parts: DataFrame) -> DataFrame:
    """Set union of key lists."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def baseline_at_least(df: DataFrame, value: str, limit: float) -> DataFrame:
    """Keep baselines at or above the limit; NULL drops."""
    return df.filter(F.col(value) >= F.lit(limit))


def attrition(stages: dict[str, DataFrame], key: str, approximate: bool = False) -> DataFrame:
    """Number of distinct subjects per stage, in the order given."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    rows = [
        df.agg(count(F.col(key)).alias("subjects")).select(
            F.lit(i).alias("step"), F.lit(name).alias("stage"), "subjects"
        )
        for i, (name, df) in enumerate(stages.items(), 1)
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
