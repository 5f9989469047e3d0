"""Picks that the given order leaves open.

A first or last row per group is well defined only if the order decides between
all rows with another content. The audit counts, per group, the rows at the best
place of the order and compares the least and greatest digest of what is picked
from them. All of it combines ahead of the shuffle, so a group may be of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import keys


def open_picks(
    rows: DataFrame, group: str | Sequence[str], order: str | Sequence[str], payload: str | Sequence[str], latest: bool = True
) -> DataFrame:
    """(group, order, n_rows): groups whose latest (or earliest) place in the
    order holds several rows that differ in the payload. Rows without the first
    order column are not picked; equal rows leave nothing open."""
    by, place, picked = keys(group), keys(order), keys(payload)
    digest = F.xxhash64(*picked)
    tied = rows.filter(F.col(place[0]).isNotNull()).groupBy(*by, *place).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(digest).alias("_low"), F.max(digest).alias("_high")
    )
    best = (F.max_by if latest else F.min_by)(F.struct(*place, "n_rows", "_low", "_high"), F.struct(*place)).alias("_best")
    found = tied.groupBy(*by).agg(best).select(*by, "_best.*")
    return found.filter("_low <> _high").select(*by, *place, "n_rows")
