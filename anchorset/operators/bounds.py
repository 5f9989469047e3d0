"""Scans cut to the span of time that an index table asks for.

A join with an index table says nothing to the scan of the facts. The least and
greatest index time do: as literals they are pushed into the scan, which skips
the files and row groups outside. One small aggregate of the index table pays for
that, which should be a stored stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_bounds(
    facts: DataFrame, ts: str, index: DataFrame, low: Column | str | None = None, high: Column | str | None = None
) -> DataFrame:
    """Facts not before the least ``low`` nor after the greatest ``high`` of the
    index table (expressions over it; None leaves a side open). This only drops
    facts that no row of the index table could ask for; the join's own conditions
    still decide. Facts without a time go; an empty index table leaves none."""
    ends = {"low": low, "high": high}
    aggs = [(F.min if n == "low" else F.max)(c).cast(facts.schema[ts].dataType).alias(n) for n, c in ends.items() if c is not None]
    if not aggs:
        return facts
    found = index.agg(*aggs).first()
    kind = facts.schema[ts].dataType
    for name in (n for n, c in ends.items() if c is not None):
        if found[name] is None:
            return facts.filter(F.lit(False))
        limit = F.lit(found[name]).cast(kind)
        facts = facts.filter(F.col(ts) >= limit if name == "low" else F.col(ts) <= limit)
    return facts
