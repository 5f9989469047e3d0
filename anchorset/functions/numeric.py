"""Number handling shared by all operators: exact rounding, safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def as_col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def round_to(value, digits: int) -> Column:
    """Round half away from zero on the decimal value and return a double.

    Spark rounds a double by its shortest decimal form, once and whatever its
    size; decimals are rounded as they are.
    """
    return F.round(as_col(value), digits).cast("double")


def divide(a, b) -> Column:
    """Fractional quotient as a double; NULL when the divisor is zero."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def whole_quotient(name: str, divisor: int) -> Column:
    """Integer quotient of a column, cut towards zero."""
    return F.expr(f"`{name}` div {divisor}")


def is_integral(df, name: str) -> bool:
    return isinstance(df.schema[name].dataType, INTEGRAL)


def quotient_by_type(df, name: str, divisor: int) -> Column:
    """Divide by a whole number the way SQL does for the column's type:
    integer columns give an integer quotient, others a fractional one."""
    if is_integral(df, name):
        return whole_quotient(name, divisor)
    return F.col(name) / F.lit(divisor)


def micros(ts) -> Column:
    """A timestamp without zone as microseconds since 1970."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, as_col(ts))


def later_first(df, ts: str) -> Column:
    """A key that sorts ascending where ``ts`` sorts descending."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(ts)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return -micros(F.col(ts).cast("timestamp_ntz"))
    return -F.col(ts)
