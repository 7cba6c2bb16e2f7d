"""Structured Streaming forms of the batch operators: epochs by the clock, de-duplication and spaced spikes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.functions.columns import entity_key, finite
from pulsegrid.session import new_folder


def signal_stream(spark: SparkSession, path: str, modality: str | None = None, files: int | None = None) -> DataFrame:
    """Long signal files as a stream; files that arrive later are read later. The path may be a folder or one file. A
    micro-batch takes at most `files` of them, all that are there unless given."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern a path may also name a single file
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    df = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(pattern)
    df = df.where(F.col("modality") == modality) if modality else df
    return df.select(entity_key("stream_id").alias("sid"), "session", "channel", "pos", F.col("ts").cast("timestamp").alias("ts"), finite("value").alias("value"))


def deduplicated(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each key once, among rows that arrive within `late` of each other in event time."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sid", "session", "channel", "pos"])


def tumbling(stream: DataFrame, width: str = "5 seconds", late: str = "1 day") -> DataFrame:
    """Readings and their sum, minimum and maximum per channel and window of the clock; rows later than `late` are dropped."""
    w = F.window("ts", width)
    g = stream.withWatermark("ts", late).groupBy(w.alias("w"), "sid", "session", "channel")
    return g.agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max")).select("sid", "session", "channel", F.col("w.start").alias("start"), "n", "min", "max")


def spaced(stream: DataFrame, threshold: float, apart_us: int, late: str = "1 day") -> DataFrame:
    """Readings above the threshold, each more than `apart_us` after the last one kept of its channel, kept as state.

    Of a channel's hits in a micro-batch a task holds the distinct times only, eight bytes each; how large a micro-batch
    gets is set where the stream is read. The next one kept is found by binary search, not by going through all."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = np.unique(np.concatenate([b["t"].dropna().unique() for b in batches]).astype(np.int64))
        out = []
        at = 0 if last is None else int(np.searchsorted(times, last + apart_us, "right"))
        while at < len(times):
            last = int(times[at])
            out.append(last)
            at = int(np.searchsorted(times, last + apart_us, "right"))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"sid": key[0], "session": key[1], "channel": key[2], "t": pd.Series(out, dtype="int64")})

    hits = stream.withWatermark("ts", late).where(F.col("value") > threshold).select("sid", "session", "channel", F.unix_micros("ts").alias("t"))
    return hits.groupBy("sid", "session", "channel").applyInPandasWithState(keep, "sid string, session int, channel string, t bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs a stream over what is there now, and gives the last row written for each key.

    Micro-batches go to the shared folder with their number; a batch that is repeated after a failure overwrites itself.
    """
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")
    schema = stream.schema

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    q = stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        written = spark.read.parquet(f"{folder}/out")
    except Exception:  # no batch was written: the input is empty
        return spark.createDataFrame([], schema)
    if not keys:
        return written.select(*schema.names)
    return written.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), "batch").alias("r")).select("r.*")
