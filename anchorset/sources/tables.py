"""Table access: Parquet directory or catalog, with a check of the columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "table") -> DataFrame:
    """Fail early, by name, if a table lacks a column a plan reads."""
    have = {c.lower() for c in df.columns}
    missing = sorted(c for c in columns if c.lower() not in have)
    if missing:
        raise ValueError(f"{name} lacks column(s): {', '.join(missing)}")
    return df


class TableSource:
    """Named tables below a directory of Parquet data, or in a catalog schema.

    ``TableSource(spark, path="s3a://…/data")`` reads ``<path>/<name>.parquet``
    (a file or a folder); ``TableSource(spark, schema="icu")`` reads
    ``icu.<name>``. Only the columns a plan names are read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, schema: str | None = None):
        if (path is None) == (schema is None):
            raise ValueError("give either path or schema")
        self.spark, self.path, self.schema = spark, path, schema

    def table(self, name: str, columns: Iterable[str] | None = None) -> DataFrame:
        if self.path is not None:
            df = self.spark.read.parquet(f"{self.path.rstrip('/')}/{name}.parquet")
        else:
            df = self.spark.table(f"{self.schema}.{name}")
        if columns is None:
            return df
        wanted = list(columns)
        return require_columns(df, wanted, name).select(*wanted)


class FrameSource:
    """The same access over DataFrames that already exist."""

    def __init__(self, frames: dict[str, DataFrame]):
        self.frames = frames

    def table(self, name: str, columns: Iterable[str] | None = None) -> DataFrame:
        df = self.frames[name]
        if columns is None:
            return df
        wanted = list(columns)
        return require_columns(df, wanted, name).select(*wanted)
