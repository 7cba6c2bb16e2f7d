"""Where a stream belongs: its log, its user and where its sensor sits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import entity_key
from pulsegrid.sources.readers import modality_of, sensor_location


def stream_owners(recordings: DataFrame) -> DataFrame:
    """Per stream and session: modality, sensor location, log and user number (the digits of the log key's first part;
    null where it has none). Of several logs the first in order counts."""
    user = F.nullif(F.regexp_extract(F.element_at(F.split("log_key", "_"), 1), r"(\d+)$", 1), F.lit("")).try_cast("bigint")
    key = entity_key("stream_id")
    g = recordings.groupBy(key.alias("sid"), "session").agg(F.min("log_key").alias("log_key"))
    return g.select("sid", "session", modality_of(F.col("sid")).alias("modality"), sensor_location(F.col("sid")).alias("location"), "log_key", user.alias("user_id"))


def streams_per_user(recordings: DataFrame) -> DataFrame:
    """How many streams, sessions and recordings each user has, by modality."""
    return stream_owners(recordings).groupBy("user_id", "modality").agg(F.countDistinct("sid").alias("streams"), F.countDistinct("session").alias("sessions"), F.count("*").alias("recordings"))
