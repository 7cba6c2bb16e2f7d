"""Checks on tables and series: assertions that raise, and reports as DataFrames."""

from __future__ import annotations

import functools
import inspect
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.errors import SourceError, ValidationError
from pulsegrid.functions.columns import micros
from pulsegrid.functions.ordered import with_neighbours


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValidationError(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame, least: int = 1) -> DataFrame:
    if df.limit(least).count() < least:
        raise ValidationError(f"fewer than {least} rows")
    return df


def require_rate(rate: float | str | None, low: float = 1.0, high: float = 10_000.0) -> float:
    """A sampling rate as a number within bounds."""
    try:
        x = float(rate)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        raise ValidationError(f"not a sampling rate: {rate!r}") from None
    if not low <= x <= high:
        raise ValidationError(f"sampling rate {x:g} is not within {low:g} to {high:g}")
    return x


def require_path(path: str | None, folder: bool = False, extension: str | None = None) -> str:
    """A path of the driver's file system that is there and is a file (or a folder), with the extension if one is named, in
    either case."""
    if not path or not str(path).strip():
        raise ValidationError("no path given")
    if not os.path.exists(path):
        raise SourceError(f"{path} does not exist")
    if os.path.isdir(path) != folder:
        raise ValidationError(f"{path} is {'no' if folder else 'a'} folder")
    if extension and not str(path).lower().endswith(extension.lower()):
        raise ValidationError(f"{path} does not end in {extension}")
    return path


def not_none(name: str, value: Any) -> None:
    if value is None:
        raise ValidationError(f"{name} is missing")


def positive(name: str, value: Any) -> None:
    not_none(name, value)
    if not value > 0:
        raise ValidationError(f"{name} is {value!r}, which is not positive")


def in_range(low: float, high: float) -> Callable[[str, Any], None]:
    """A rule: the value lies from `low` to `high`."""

    def rule(name: str, value: Any) -> None:
        not_none(name, value)
        if not low <= value <= high:
            raise ValidationError(f"{name} is {value!r}, which is not within {low} to {high}")

    return rule


def checked(**rules: Callable[[str, Any], None]) -> Callable:
    """Calls a function only if its arguments keep the rules named for them: @checked(rate=positive)."""

    def wrap(f: Callable) -> Callable:
        names = inspect.signature(f)

        @functools.wraps(f)
        def call(*args: Any, **kwargs: Any) -> Any:
            given = names.bind(*args, **kwargs)
            given.apply_defaults()
            for name, rule in rules.items():
                rule(name, given.arguments.get(name))
            return f(*args, **kwargs)

        return call

    return wrap


def require_readings(report: DataFrame, least: int = 1, most_channels: int | None = None) -> DataFrame:
    """Raises if a series of a report has fewer than `least` rows, a missing or an infinite value, or a stream more than
    `most_channels` channels, or if there is no series."""
    bad = report.where((F.col("rows") < least) | (F.col("missing") > 0) | (F.col("infinite") > 0)).limit(1).collect()
    if bad:
        raise ValidationError(f"{bad[0]['sid']}, session {bad[0]['session']}, channel {bad[0]['channel']} has {bad[0]['rows']} rows, {bad[0]['missing']} missing and {bad[0]['infinite']} infinite values")
    require_rows(report)
    if most_channels is not None:
        wide = report.groupBy("sid", "session").agg(F.count("*").alias("n")).where(F.col("n") > most_channels).limit(1).collect()
        if wide:
            raise ValidationError(f"{wide[0]['sid']}, session {wide[0]['session']} has {wide[0]['n']} channels")
    return report


def columns_like(df: DataFrame, part: str) -> list[str]:
    """The columns of a table whose names contain `part`."""
    return [c for c in df.columns if part in c]


def series_report(signal: DataFrame) -> DataFrame:
    """Per stream, session and channel of raw rows (sid, session, channel, pos, ts, value): rows, missing and infinite
    values, missing times and times that do not come after the one before."""
    n = with_neighbours(signal, ["sid", "session", "channel"], "pos", F.when(F.col("ts").isNotNull(), F.struct(micros("ts").alias("t"))), "_p", "_n")
    v = F.col("value")
    return n.groupBy("sid", "session", "channel").agg(
        F.count("*").alias("rows"), F.count_if(v.isNull() | F.isnan(v)).alias("missing"), F.count_if(F.abs(v) == F.lit(float("inf"))).alias("infinite"),
        F.count_if(F.col("ts").isNull()).alias("no_time"), F.count_if(micros("ts") <= F.col("_p.t")).alias("not_after"),
    )


def require_increasing(report: DataFrame) -> DataFrame:
    """Raises if any series of a report has times that are missing or not increasing."""
    bad = report.where((F.col("no_time") > 0) | (F.col("not_after") > 0)).limit(1).collect()
    if bad:
        raise ValidationError(f"times are not strictly increasing in {bad[0]['sid']}, session {bad[0]['session']}")
    return report
