"""Session helpers shared by all operators: tables, size checks and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.errors import ConfigurationError

#: Rows up to which a table may be sent to every executor. The rows sent are narrow (under 200 bytes), so a
#: broadcast stays under about 60 MB whatever the input is.
BROADCAST_ROWS = 300_000


def local_session(app: str = "pulsegrid", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests, examples and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where that is unset, a session on one machine takes a temporary folder, which it sets as its checkpoint folder; on a
    cluster there is no folder to guess, and a ConfigurationError says what to set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Folders written by `written` and not removed yet, oldest first.
_folders: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared folder, which `scratch` removes."""
    path = os.path.join(shared_folder(spark), f"pulsegrid-{label}-{uuid.uuid4().hex}")
    _folders.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: later steps start from files that outlive any executor. The files
    stay until the `scratch` that they were written in ends."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what operators wrote to the shared folder inside it. Results that were not written elsewhere by
    then can no longer be read, so the scope has to hold the action too."""
    first = len(_folders)
    try:
        yield
    finally:
        done = _folders[first:]
        del _folders[first:]
        for folder in done:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `rows` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a narrow table for broadcast only if its row count is proven to be small; else Spark joins by shuffle."""
    return F.broadcast(df) if is_small(df, rows) else df


def small_side(df: DataFrame, label: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """An aggregated table as one side of a join: written once, so that neither counting nor joining it computes it
    again, and broadcast if it proves to be small."""
    return broadcast_if_small(written(df, label), rows)
