"""Cleaning, resampling, scaling and epoching of series: one row per stream, session, channel and position.

All functions take and give rows (sid, session, channel, pos, ts, value) unless they say otherwise. Nulls are missing
readings; NaN and infinities were made null by `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.columns import entity_key, finite, micros, ratio
from pulsegrid.functions.ordered import BLOCK, with_halo, with_neighbours, with_running_sum
from pulsegrid.session import broadcast_if_small, small_side, written

KEYS = ["sid", "session", "channel"]
STREAM = ["sid", "session"]


def clean(signal: DataFrame, modality: str | None = None) -> DataFrame:
    """Readings of one modality (or of all), each key once, NaN and infinite values null, ids normalised."""
    rows = signal.where(F.col("modality") == modality) if modality else signal
    rows = rows.where(F.col("pos").isNotNull())
    return rows.groupBy(entity_key("stream_id").alias("sid"), "session", "channel", "pos").agg(F.min("ts").alias("ts"), F.min(finite("value")).alias("value"))


def widen(rows: DataFrame, channels: list[str]) -> DataFrame:
    """One row per instant, a column per channel in lower case."""
    return rows.groupBy(*STREAM, "pos").agg(F.min("ts").alias("ts"), *[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c.lower()) for c in channels])


def per_group(rows: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Adds aggregates of each row's group, by aggregation and join: a hot group is pre-aggregated, never windowed."""
    return rows.join(small_side(rows.groupBy(*keys).agg(*aggs), "groups"), keys)


def sampling_rates(rows: DataFrame) -> DataFrame:
    """Sampling frequency per stream and session, one over the mean step between instants: (sfreq, sfreq_int, min_sfreq
    = the lowest of the modality, which is the last part of a stream id). Null where fewer than two instants, or none apart, are known."""
    t = rows.where(F.col("ts").isNotNull()).groupBy(*STREAM, "pos").agg(F.min(micros("ts")).alias("t"))
    span = (F.max("t") - F.min("t")) / 1e6
    r = t.groupBy(*STREAM).agg(ratio(F.count("*").cast("double") - 1, span).alias("sfreq"))
    r = written(r.withColumn("modality", F.element_at(F.split("sid", "_"), -1)), "rates")
    low = r.groupBy("modality").agg(F.min("sfreq").alias("min_sfreq"))
    return r.join(low, "modality").withColumn("sfreq_int", F.floor("sfreq")).drop("modality")


def decimate(rows: DataFrame, factor: int) -> DataFrame:
    """Every `factor`-th instant, positions renumbered; a factor of 1 or less keeps all."""
    return rows if factor <= 1 else rows.where(F.pmod("pos", F.lit(factor)) == 0).withColumn("pos", (F.col("pos") / factor).cast("bigint"))


def fill_held(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Missing readings take the last reading before them, leading ones the first after; `value` stays as it was and
    `filled` has the result, null only in a channel without readings."""
    item = F.when(F.col("value").isNotNull(), F.struct("value"))
    n = with_neighbours(rows, KEYS, "pos", item, "_prev", "_next", block)
    return n.withColumn("filled", F.coalesce("value", "_prev.value", "_next.value")).drop("_prev", "_next")


def interpolate(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Missing readings on the line between the readings around them, by position; trailing ones hold the last
    reading, leading ones become 0. The result is `filled`."""
    item = F.when(F.col("value").isNotNull(), F.struct("pos", "value"))
    n = with_neighbours(rows, KEYS, "pos", item, "_p", "_n", block)
    line = F.col("_p.value") + (F.col("_n.value") - F.col("_p.value")) * ((F.col("pos") - F.col("_p.pos")) / (F.col("_n.pos") - F.col("_p.pos")))
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("_p").isNull(), F.lit(0.0)).when(F.col("_n").isNull(), F.col("_p.value")).otherwise(line)
    return n.withColumn("filled", filled).drop("_p", "_n")


def differences(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds `step`, the reading minus the reading before it; null at the first and at missing readings."""
    item = F.when(F.col("value").isNotNull(), F.struct("value"))
    n = with_neighbours(rows, KEYS, "pos", item, "_p", "_n", block)
    return n.withColumn("step", F.col("value") - F.col("_p.value")).drop("_p", "_n")


def moving_average(rows: DataFrame, width: int = 5, block: int = BLOCK) -> DataFrame:
    """Adds `smooth`, the mean over the readings at this position and the width - 1 after it; 0 where fewer than
    `width` positions follow, as a valid-mode convolution padded with zeros."""
    h = with_halo(rows, KEYS, "pos", after=width - 1, block=block)
    w = Window.partitionBy(*KEYS, "_b").orderBy("pos").rangeBetween(0, width - 1)
    full = F.count("*").over(w) == width
    return h.withColumn("smooth", F.when(full, F.avg("value").over(w)).otherwise(0.0)).where("_home").drop("_b", "_home")


def median_filter(rows: DataFrame, width: int = 5, block: int = BLOCK) -> DataFrame:
    """Adds `median`, the middle of the `width` readings around each, beyond the ends taken as 0."""
    half = width // 2
    h = with_halo(rows, KEYS, "pos", before=half, after=half, block=block)
    w = Window.partitionBy(*KEYS, "_b").orderBy("pos").rangeBetween(-half, half)
    near = F.collect_list(F.coalesce("value", F.lit(0.0))).over(w)
    padded = F.array_sort(F.concat(near, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(near))))
    return h.withColumn("median", F.element_at(padded, half + 1)).where("_home").drop("_b", "_home")


def z_score(rows: DataFrame, keys: list[str] = KEYS, population: bool = False) -> DataFrame:
    """Adds `scaled` = (value - mean) / deviation of the group; null where the group does not vary."""
    dev = F.stddev_pop("value") if population else F.stddev_samp("value")
    g = per_group(rows, keys, F.avg("value").alias("_m"), dev.alias("_s"))
    return g.withColumn("scaled", ratio(F.col("value") - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def min_max(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Adds `scaled` in 0 to 1 over the group; null where the group does not vary."""
    g = per_group(rows, keys, F.min("value").alias("_a"), F.max("value").alias("_z"))
    return g.withColumn("scaled", ratio(F.col("value") - F.col("_a"), F.col("_z") - F.col("_a"))).drop("_a", "_z")


def remove_ramp(rows: DataFrame) -> DataFrame:
    """Adds `level`: value minus a line from 0 at the first position to the channel's mean at the last."""
    g = per_group(rows, KEYS, F.avg("value").alias("_m"), F.min("pos").alias("_a"), F.max("pos").alias("_z"))
    return g.withColumn("level", F.col("value") - F.col("_m") * F.coalesce(ratio((F.col("pos") - F.col("_a")).cast("double"), (F.col("_z") - F.col("_a")).cast("double")), F.lit(0.0))).drop("_m", "_a", "_z")


def rereference(rows: DataFrame, reference: str) -> DataFrame:
    """Every other channel minus the reference channel at the same instant; null where either is missing."""
    ref = rows.where(F.col("channel") == reference).select(*STREAM, "pos", F.col("value").alias("_ref"))
    return rows.where(F.col("channel") != reference).join(ref, [*STREAM, "pos"], "left").withColumn("value", F.col("value") - F.col("_ref")).drop("_ref")


def count_epochs(rows: DataFrame, size: int) -> DataFrame:
    """Epochs of `size` successive positions; an epoch that is not full, per channel, is dropped."""
    e = rows.withColumn("epoch", F.floor(F.col("pos") / size))
    full = e.groupBy(*KEYS, "epoch").agg(F.count("*").alias("_n")).where(F.col("_n") == size).drop("_n")
    return e.join(full, [*KEYS, "epoch"], "left_semi")


def time_epochs(rows: DataFrame, seconds: float) -> DataFrame:
    """Epochs by the clock from the first reading of a stream, partly filled ones kept, empty ones left out and the rest
    numbered without gaps. As many windows count as the readings would fill at the mean rate."""
    us = int(seconds * 1e6)
    known = rows.where(F.col("ts").isNotNull()).withColumn("_t", micros("ts"))
    g = per_group(known, KEYS, F.min("_t").alias("_a"), F.max("_t").alias("_z"), F.count("*").alias("_n"))
    windows = F.ceil(ratio(F.col("_n") * (F.col("_z") - F.col("_a")).cast("double"), (F.col("_n") - 1) * F.lit(float(us))))
    e = g.withColumn("_w", F.floor((F.col("_t") - F.col("_a")) / us)).where(F.col("_w") < F.greatest(windows, F.lit(1)))
    number = e.select(*KEYS, "_w").distinct().withColumn("epoch", (F.row_number().over(Window.partitionBy(*KEYS).orderBy("_w")) - 1).cast("bigint"))
    return e.join(number, [*KEYS, "_w"]).drop("_t", "_a", "_z", "_n", "_w")


def epoch_starts(epochs: DataFrame) -> DataFrame:
    """First instant of each epoch, for time axes."""
    return epochs.groupBy(*KEYS, "epoch").agg(F.min("ts").alias("first_ts"))


def running_orientation(rows: DataFrame) -> DataFrame:
    """Adds `turned`, the sum of the readings of a channel up to and with each."""
    return with_running_sum(rows, KEYS, "pos", F.coalesce("value", F.lit(0.0)), "turned")


def scale_by_normality(rows: DataFrame, tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds `scaled`: each channel to 0 to 1 if all series pass a test of normality (tests: a p value each), at alpha over
    their number (Bonferroni), else its z-scores."""
    t = tests.agg(F.min("p").alias("p"), F.count("p").alias("n")).first()
    return min_max(rows) if t["n"] and t["p"] >= alpha / t["n"] else z_score(rows)


def overlapping_epochs(rows: DataFrame, size: int) -> DataFrame:
    """Epochs of size + 1 positions that share their border with the next; unfinished ones are dropped."""
    q = F.floor(F.col("pos") / size)
    both = F.when((F.pmod("pos", F.lit(size)) == 0) & (q > 0), F.array(q, q - 1)).otherwise(F.array(q))
    e = rows.withColumn("epoch", F.explode(both))
    full = e.groupBy(*KEYS, "epoch").agg(F.count("*").alias("_n")).where(F.col("_n") == size + 1).drop("_n")
    return e.join(full, [*KEYS, "epoch"], "left_semi")


def crop(rows: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Readings within the closed span of their key; keys without a span have no readings."""
    s = spans.select(*keys, F.col(start).alias("_a"), F.col(end).alias("_z"))
    return rows.join(broadcast_if_small(s), keys).where(F.col("ts").between(F.col("_a"), F.col("_z"))).drop("_a", "_z")


def slice_positions(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Positions start to end - 1."""
    return rows.where((F.col("pos") >= start) & (F.col("pos") < end))


def baseline_by_channel(epochs: DataFrame, reference: str) -> DataFrame:
    """Readings of an epoch minus the mean of the reference channel in that epoch; null where it has no reading."""
    base = epochs.where(F.col("channel") == reference).groupBy(*STREAM, "epoch").agg(F.avg("value").alias("_base"))
    return epochs.join(base, [*STREAM, "epoch"], "left").withColumn("value", F.col("value") - F.col("_base")).drop("_base")


def histogram(rows: DataFrame, keys: list[str], bins: int = 50) -> DataFrame:
    """Readings per group in `bins` equal bins from its smallest to its largest: (keys, bin, from, readings); groups that
    do not vary are in bin 0, empty bins have no row."""
    g = per_group(rows.where(F.col("value").isNotNull()), keys, F.min("value").alias("_a"), F.max("value").alias("_z"))
    width = (F.col("_z") - F.col("_a")) / bins
    b = F.coalesce(F.least(F.floor(ratio(F.col("value") - F.col("_a"), width)), F.lit(bins - 1)), F.lit(0))
    return g.withColumn("bin", b.cast("bigint")).groupBy(*keys, "bin").agg(F.first(F.col("_a")).alias("_a"), F.first(width).alias("_w"), F.count("*").alias("readings")).select(*keys, "bin", (F.col("_a") + F.col("bin") * F.col("_w")).alias("from"), "readings")
