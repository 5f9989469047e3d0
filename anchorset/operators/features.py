"""Change scores and assembly of the wide table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_col, divide, round_to


def change(base, extreme, kind: str, digits: int = 4) -> Column:
    """Change from baseline to extreme: ``relative_drop`` (b-e)/b,
    ``absolute_drop`` b-e or ``relative_rise`` (e-b)/b. Both values are needed;
    a zero baseline gives NULL for the relative kinds."""
    b, e = as_col(base).cast("double"), as_col(extreme).cast("double")
    kinds = {
        "relative_drop": divide(b - e, b),
        "absolute_drop": b - e,
        "relative_rise": divide(e - b, b),
    }
    return round_to(kinds[kind], digits)


def keep_pair(df: DataFrame, base: str, extreme: str, require: str) -> DataFrame:
    """NULL rule for a baseline and its extreme: ``both`` keeps the pair only if
    both are known, ``base`` keeps it whenever the baseline is known."""
    known = F.col(base).isNotNull()
    if require == "both":
        known = known & F.col(extreme).isNotNull()
    return df.withColumns({c: F.when(known, F.col(c)) for c in (base, extreme)})


def unique_per_key(table: DataFrame, key: str) -> DataFrame:
    """The table, which fails when it is read if a key has several rows. Rows
    with a NULL key match nothing and are left out."""
    columns = [c for c in table.columns if c != key]
    grouped = table.filter(F.col(key).isNotNull()).groupBy(key)
    rows = grouped.agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in columns])
    message = F.concat(F.lit("several feature rows for one key: "), F.col(key).cast("string"))
    several = F.when(F.col("_rows") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return rows.filter(several).select(*table.columns)


def assemble(
    cohort: DataFrame, key: str, features: Sequence[DataFrame], unique: bool = False
) -> DataFrame:
    """Left-join feature tables that have one row per subject, so that no join
    multiplies subjects. Each table is checked for that on the partitioning the
    join needs anyway, unless ``unique`` states it, as for aggregates on the key."""
    out = cohort
    for table in features:
        out = out.join(table if unique else unique_per_key(table, key), key, "left")
    return out
