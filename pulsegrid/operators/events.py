"""Events and markers: covering epochs, enrichment from logs, spikes, synchronisation and annotations."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.blocks import numbers, sorted_groups
from pulsegrid.functions.columns import entity_key, micros
from pulsegrid.session import broadcast_if_small, small_side, written

EPOCH_S = 5.0
EVENT = ["event_name", "event_type", "event_duration", "metadata"]


def merge_equal(features: DataFrame, events: DataFrame) -> DataFrame:
    """Feature rows with the events whose ordinal is their epoch, of the same stream; a row for each such event."""
    f = features.select("feature_id", entity_key("stream_id").alias("sid"), "epoch")
    e = events.select("event_row_id", entity_key("stream_id").alias("sid"), F.col("event_id").alias("epoch"), *EVENT)
    return f.join(e, ["sid", "epoch"])


def merge_covering(features: DataFrame, events: DataFrame, epoch_s: float = EPOCH_S) -> DataFrame:
    """Every feature row with the event that covers its epoch, null where none does.

    An event covers the epochs from its ordinal to its ordinal plus its whole number of epochs; of several the one
    with the largest ordinal, then the largest row id, counts. A null or negative duration covers one epoch.

    The epochs of an event are cut into stretches whose length is a power of two and that start at a multiple of it, at
    most two of a length, so a duration of millions of epochs gives some forty rows. Events are reduced to one per
    stream and stretch, and a feature row looks up the stretch of each length in use that its epoch lies in.
    """
    pieces = "array<struct<level:int,at:bigint>>"
    last = F.least(F.greatest(F.coalesce(F.floor(F.col("event_duration") / epoch_s), F.lit(0)), F.lit(0)), F.lit(2**40)).cast("bigint")
    state = F.struct(F.col("event_id").cast("bigint").alias("a"), (F.col("event_id") + last).cast("bigint").alias("z"), F.array().cast(pieces).alias("out"))

    def cut(x: Column, level: Column) -> Column:
        odd = (x["a"] <= x["z"]) & (F.pmod(x["a"], F.lit(2)) == 1)
        even = (x["a"] <= x["z"]) & (F.pmod(x["z"], F.lit(2)) == 0)  # never the same stretch as the odd one
        piece = lambda yes, at: F.when(yes, F.array(F.struct(level.cast("int").alias("level"), at.alias("at")))).otherwise(F.array().cast(pieces))
        a, z = F.when(odd, x["a"] + 1).otherwise(x["a"]), F.when(even, x["z"] - 1).otherwise(x["z"])
        done = a > z  # halving could bring them together again
        return F.struct(F.when(done, F.lit(0)).otherwise(F.floor(a / 2)).cast("bigint").alias("a"), F.when(done, F.lit(-1)).otherwise(F.floor(z / 2)).cast("bigint").alias("z"), F.concat(x["out"], piece(odd, x["a"]), piece(even, x["z"])).alias("out"))

    levels = F.sequence(F.lit(0), F.ceil(F.log2(last + 2)).cast("int") + 1)
    stretches = F.aggregate(levels, state, cut, lambda x: x["out"])
    e = events.where(F.col("event_id").isNotNull()).select(entity_key("stream_id").alias("sid"), F.struct("event_id", "event_row_id").alias("rank"), F.struct(*EVENT).alias("e"), F.inline(stretches))
    winner = written(e.groupBy("sid", "level", "at").agg(F.max_by("e", "rank").alias("e"), F.max("rank").alias("rank")), "covering")
    used = sorted(r[0] for r in winner.select("level").distinct().collect())  # some 42 lengths at most
    f = features.withColumn("sid", entity_key("stream_id"))
    if not used:
        return f.select(*features.columns, "sid", *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in EVENT])
    epochs = f.where(F.col("epoch").isNotNull() & F.col("sid").isNotNull()).select("sid", "epoch").distinct()
    looked = epochs.select("*", F.inline(F.array(*[F.struct(F.lit(x).alias("level"), F.floor(F.col("epoch") / 2**x).alias("at")) for x in used])))
    best = looked.join(winner, ["sid", "level", "at"]).groupBy("sid", "epoch").agg(F.max_by("e", "rank").alias("e"))
    return f.join(best, ["sid", "epoch"], "left").select(*features.columns, "sid", *[F.col(f"e.{c}").alias(c) for c in EVENT])


def device_of(stream: Column) -> Column:
    """The device part of a log key that a stream belongs to: m and the id of a headband, e and that of a wristband."""
    head = F.element_at(F.split(stream, "_"), 1)
    return F.when(head.startswith("muses-"), F.concat(F.lit("m"), F.substring(head, 7, 100))).otherwise(F.concat(F.lit("e"), head))


def enrich_events(events: DataFrame, log: DataFrame) -> DataFrame:
    """Every event with the first log row (smallest row_id) of its device whose marker is its name.

    Devices are taken out of log keys once, so that what was a search for substrings is a join by equality."""
    parts = F.split(F.lower("log_key"), "_")
    devices = F.explode(F.array_distinct(F.filter(F.array(F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))), lambda d: d.isNotNull())))
    first = log.where(F.col("marker").isNotNull()).select(devices.alias("device"), F.col("marker").alias("event_name"), "row_id", "category", F.col("metadata").alias("log_metadata"))
    first = first.groupBy("device", "event_name").agg(F.min_by(F.struct(F.col("row_id").alias("log_row_id"), "category", "log_metadata"), "row_id").alias("l"))
    e = events.select("event_row_id", device_of(entity_key("stream_id")).alias("device"), "event_name")
    return e.join(first, ["device", "event_name"], "left").select("event_row_id", "event_name", "l.log_row_id", "l.category", "l.log_metadata")


def magnitudes(wide: DataFrame) -> DataFrame:
    """Adds mag, the length of (x, y, z); null where an axis is missing."""
    return wide.withColumn("mag", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))


def first_and_last(wide: DataFrame, threshold: float) -> DataFrame:
    """First and last position per stream and session at which the magnitude exceeds the threshold."""
    return magnitudes(wide).where(F.col("mag") > threshold).groupBy("sid", "session").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def _following(t: np.ndarray, apart: int) -> np.ndarray:
    """For each of the sorted times, which is the first more than `apart` after it; their number where there is none."""
    return np.searchsorted(t, t + apart, side="right")


def _ways(table: pa.Table, starts: np.ndarray, apart: int) -> pa.Table:
    """What happens in each block: the times that can be the first kept in it, whatever was kept before, and to each of them
    the last one kept then."""
    t = numbers(table, "t")
    first, last = [], []
    for x in np.split(t, starts[1:]):
        after = _following(x, apart)
        ends = np.arange(len(x))
        for i in range(len(x) - 1, -1, -1):
            if after[i] < len(x):
                ends[i] = ends[after[i]]
        n = min(int(after[0]) + 1, len(x))  # those up to `apart` after the first, and one more
        first.append(x[:n])
        last.append(x[ends[:n]])
    keys = table.select(["sid", "session", "block"]).take(pa.array(starts))
    return keys.append_column("first", pa.array(first, pa.list_(pa.int64()))).append_column("last", pa.array(last, pa.list_(pa.int64())))


def _entries(table: pa.Table, starts: np.ndarray, apart: int) -> pa.Table:
    """The first time kept in each block of a series, from the one kept last in the blocks before; null where none is."""
    first, last, out = table["first"].to_pylist(), table["last"].to_pylist(), []
    begins = set(starts.tolist())
    kept = None
    for i in range(table.num_rows):
        kept = None if i in begins else kept
        at = 0 if kept is None else int(np.searchsorted(first[i], kept + apart, side="right"))
        out.append(first[i][at] if at < len(first[i]) else None)
        kept = last[i][at] if at < len(first[i]) else kept
    return table.select(["sid", "session", "block"]).append_column("t", pa.array(out, pa.int64()))


def _walk(table: pa.Table, starts: np.ndarray, apart: int) -> pa.Table:
    """The times kept in each block, from its entry, which is the row that says so and comes first."""
    t, rows = numbers(table, "t", -1), []
    for a, b in zip(starts, np.append(starts[1:], table.num_rows)):
        x = t[a + 1 : b]
        after = _following(x, apart)
        i = int(np.searchsorted(x, t[a]))
        while i < len(x):
            rows.append(a + 1 + i)
            i = int(after[i])
    return table.select(["sid", "session", "t"]).take(pa.array(rows, pa.int64()))


def spaced_spikes(wide: DataFrame, threshold: float, apart_us: int, block_us: int = 600_000_000) -> DataFrame:
    """Times at which the magnitude exceeds the threshold, each more than `apart_us` after the last one kept: (sid, session, t).

    What is kept in a block of time depends on what came before through one time only, the first one kept in it. So the
    blocks are worked out apart, for each time that this can be (those within `apart_us` of the block's first); then one
    small row a block says which it is; then each block is walked from there. No task holds the times of a series.
    """
    hits = magnitudes(wide).where((F.col("mag") > threshold) & F.col("ts").isNotNull()).select("sid", "session", micros("ts").alias("t")).distinct()
    hits = written(hits.withColumn("block", F.floor(F.col("t") / block_us)), "hits")
    block, spot = "sid string, session int, block bigint", ["sid", "session", "block"]
    ways = sorted_groups(hits, spot, ["t"], partial(_ways, apart=apart_us), f"{block}, first array<bigint>, last array<bigint>")
    entries = sorted_groups(ways, ["sid", "session"], ["block"], partial(_entries, apart=apart_us), f"{block}, t bigint")
    entries = written(entries.where(F.col("t").isNotNull()), "entries")
    both = hits.join(entries.select(*spot), spot, "left_semi").withColumn("entry", F.lit(False)).unionByName(entries.withColumn("entry", F.lit(True)))
    return sorted_groups(both, spot, [F.desc("entry"), "t"], partial(_walk, apart=apart_us), "sid string, session int, t bigint")


def sync_markers(log: DataFrame, first: int = 2) -> DataFrame:
    """The first sync markers of each log: (log_key, session, n = 1, 2, ..., start_time)."""
    m = F.lower("marker")
    s = log.where(F.col("log_key").isNotNull() & F.col("start_time").isNotNull() & m.contains("sync") & ~m.contains("instr"))
    w = Window.partitionBy("log_key", "session").orderBy("start_time", "row_id")
    return s.withColumn("n", F.row_number().over(w).cast("bigint")).where(F.col("n") <= first).select("log_key", "session", "n", "start_time")


def sync_shifts(spikes: DataFrame, log: DataFrame, recordings: DataFrame, around_s: float) -> DataFrame:
    """Seconds by which a stream's clock is off: the mean of the spikes near the second sync marker, minus that marker.

    (sid, session, shift) for every stream of a log with two sync markers; 0 where no spike is near."""
    second = sync_markers(log).where(F.col("n") == 2).select("log_key", "session", "start_time")
    streams = recordings.select(entity_key("stream_id").alias("sid"), "session", "log_key").distinct().join(small_side(second, "sync"), ["log_key", "session"])
    near = spikes.join(small_side(streams, "streams"), ["sid", "session"]).withColumn("d", F.col("t") / 1e6 - F.col("start_time")).where(F.abs("d") <= around_s)
    return streams.select("sid", "session").join(near.groupBy("sid", "session").agg(F.avg("d").alias("shift")), ["sid", "session"], "left").na.fill(0.0, ["shift"])


def sync_windows(log: DataFrame) -> DataFrame:
    """The second sync marker of each log with the window to search for its spikes, half its own duration on either side
    of its start: (log_key, session, start_time, opens, closes). A marker without a positive duration has none: opens and closes are null."""
    m = F.lower("marker")
    s = log.where(F.col("log_key").isNotNull() & F.col("start_time").isNotNull() & m.contains("sync") & ~m.contains("instr"))
    w = Window.partitionBy("log_key", "session").orderBy("start_time", "row_id")
    half = F.when(F.col("end_time") > F.col("start_time"), (F.col("end_time") - F.col("start_time")) / 2)
    return s.withColumn("n", F.row_number().over(w)).where(F.col("n") == 2).select("log_key", "session", "start_time", (F.col("start_time") - half).alias("opens"), (F.col("start_time") + half).alias("closes"))


def window_shifts(wide: DataFrame, log: DataFrame, recordings: DataFrame, threshold: float, apart_us: int = 1_000_000) -> DataFrame:
    """Seconds by which a log is off by the accelerometers recorded with it: the mean time of the spikes inside the window
    of its second sync marker, each more than `apart_us` after the last one kept there, minus that marker.

    (sid, session, log_key, shift) for every stream in `wide` of a log with two sync markers; 0 where its own window has no spike."""
    second = small_side(sync_windows(log), "sync")
    owners = recordings.select(entity_key("stream_id").alias("sid"), "session", "log_key").distinct()
    streams = small_side(wide.select("sid", "session").distinct().join(owners, ["sid", "session"]).join(second, ["log_key", "session"]), "streams")
    at = micros("ts") / 1e6
    near = wide.join(streams.select("sid", "session", "opens", "closes"), ["sid", "session"]).where(at.between(F.col("opens"), F.col("closes"))).select(*wide.columns)
    d = spaced_spikes(near, threshold, apart_us).join(streams, ["sid", "session"]).groupBy("sid", "session").agg(F.avg(F.col("t") / 1e6 - F.col("start_time")).alias("shift"))
    return streams.select("sid", "session", "log_key").join(d, ["sid", "session"], "left").na.fill(0.0, ["shift"])


def shift_markers(log: DataFrame, shifts: DataFrame, yoga_early_s: float = 120.0) -> DataFrame:
    """All markers of the logs moved by the shift of their log: (row_id, log_key, session, marker, category, start_time,
    duration_s). Yoga poses start `yoga_early_s` earlier; durations are those before any move. Logs without a shift stay
    as they are; of several accelerometers of a log the last by id counts."""
    s = small_side(shifts.groupBy("log_key", "session").agg(F.max_by("shift", "sid").alias("shift")), "shifts")
    m = log.where(F.col("log_key").isNotNull() & F.col("start_time").isNotNull()).join(s, ["log_key", "session"], "left")
    early = F.when(F.col("category") == "Yoga Poses", yoga_early_s).otherwise(0.0)
    return m.select("row_id", "log_key", "session", "marker", "category", (F.col("start_time") - early + F.coalesce("shift", F.lit(0.0))).alias("start_time"), (F.col("end_time") - F.col("start_time")).alias("duration_s"))


def annotations(recordings: DataFrame, log: DataFrame) -> DataFrame:
    """Log markers that start within a recording of their log: (sid, session, row_id, marker, onset_s, duration_s)."""
    r = recordings.select(entity_key("stream_id").alias("sid"), "session", "log_key", (micros("rec_start") / 1e6).alias("a"), (micros("rec_end") / 1e6).alias("z"))
    e = log.where(F.col("log_key").isNotNull() & F.col("start_time").isNotNull()).select("log_key", "session", "row_id", "marker", "start_time", (F.col("end_time") - F.col("start_time")).alias("duration_s"))
    return e.join(broadcast_if_small(r), ["log_key", "session"]).where(F.col("start_time").between(F.col("a"), F.col("z"))).select("sid", "session", "row_id", "marker", (F.col("start_time") - F.col("a")).alias("onset_s"), "duration_s")


def log_bounds(log: DataFrame) -> DataFrame:
    """First start and last end of each log."""
    return log.where(F.col("log_key").isNotNull()).groupBy("log_key", "session").agg(F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end"))
