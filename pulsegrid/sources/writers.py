"""Writers: long signals, feature tables and logs as partitioned Parquet or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.errors import SinkError


def _checked(path: str) -> str:
    if not path or not path.strip():
        raise SinkError("no path given")
    return path


def write_signal(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Long rows by session and modality: a reader of one modality opens only its files."""
    rows.repartition("session", "modality", F.pmod(F.xxhash64("stream_id", F.floor(F.col("pos") / 1_000_000)), F.lit(64))).write.mode(mode).partitionBy("session", "modality").parquet(_checked(path))


def write_features(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A feature table by session; all sessions are read back as one table."""
    rows.write.mode(mode).partitionBy("session").parquet(_checked(path))


def write_all_sessions(rows: DataFrame, folder: str, modality: str, mode: str = "errorifexists") -> None:
    """The features of one modality as one table of all sessions, where read_all_sessions finds it."""
    rows.write.mode(mode).parquet(f"{_checked(folder).rstrip('/')}/{modality.lower()}_all_sessions")


def write_events(log: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Log events as CSV with a header, a folder per log."""
    log.write.mode(mode).partitionBy("log_key").option("header", True).csv(_checked(path))


def safe_name(title: str) -> str:
    """A title as part of a file name."""
    return "".join("_" if c in ' \\/:*?"<>|' else c for c in title)
