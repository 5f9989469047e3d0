"""Distinct subjects from sketches, where counting them exactly would cost too much.

A theta sketch of a set of subjects has a bounded size and merges with others, so
days, stages or new data are sketched once and combined later: in unions, and in
intersections for the overlap of stages. Up to 2 ** ``LG_NOMINAL`` subjects a
sketch is exact; beyond, its standard error is about 1 / sqrt(2 ** LG_NOMINAL).
Exact counts (``timeline.daily_coverage``, ``cohort.attrition``) stay the default.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_NOMINAL = 14


def sketched(rows: DataFrame, key: str, *by: str, lg_nominal: int = LG_NOMINAL) -> DataFrame:
    """(by, sketch) of the distinct keys of each group; combined ahead of the shuffle."""
    known = rows.filter(F.col(key).isNotNull())
    return known.groupBy(*by).agg(F.theta_sketch_agg(key, lg_nominal).alias("sketch"))


def merged(sketches: DataFrame, *by: str, lg_nominal: int = LG_NOMINAL) -> DataFrame:
    """The sketches of coarser groups, or of old and new data together."""
    return sketches.groupBy(*by).agg(F.theta_union_agg("sketch", lg_nominal).alias("sketch"))


def coverage(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, subjects): the estimated number of distinct subjects per group."""
    return sketches.select(*by, F.theta_sketch_estimate("sketch").alias("subjects"))


def stage_overlap(stages: dict[str, DataFrame], key: str, lg_nominal: int = LG_NOMINAL) -> DataFrame:
    """(stage, other, subjects): the estimated number of subjects that two stages
    share, and of each stage by itself; one pass per stage."""
    parts = [sketched(df.select(key), key, lg_nominal=lg_nominal).select(F.lit(name).alias("stage"), "sketch") for name, df in stages.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # One row, with a sketch of bounded size per stage.
    wide = every.groupBy().agg(*(F.first(F.when(F.col("stage") == n, F.col("sketch")), ignorenulls=True).alias(n) for n in stages))
    pairs = [(n, n, F.theta_sketch_estimate(n)) for n in stages]
    pairs += [(a, b, F.theta_sketch_estimate(F.theta_intersection(a, b))) for a, b in combinations(stages, 2)]
    rows = F.array(*(F.struct(F.lit(a).alias("stage"), F.lit(b).alias("other"), F.coalesce(c, F.lit(0)).alias("subjects")) for a, b, c in pairs))
    return wide.select(F.inline(rows))
