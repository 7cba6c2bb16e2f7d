"""Small column expressions used everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp; sessions run in UTC."""
    return F.unix_micros(col(ts).cast("timestamp"))


def from_micros(us: str | Column) -> Column:
    return F.timestamp_micros(col(us)).cast("timestamp_ntz")


def entity_key(c: str | Column) -> Column:
    """Stream ids are the same when equal after trimming and lower-casing."""
    return F.lower(F.trim(col(c)))


def finite(c: str | Column) -> Column:
    """NaN and infinities become null, so that every aggregate skips them."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (ANSI mode raises otherwise)."""
    return a / F.nullif(b, F.lit(0.0))


def stable(x: Column, digits: int = 6) -> Column:
    """Rounded for reports, nudged off rounding ties so that the order of a sum cannot change the result."""
    return F.round(x + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)
