"""Averages over users, codes and indicators, and correlations, from sums that Spark combines before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.columns import ratio
from pulsegrid.session import broadcast_if_small, small_side, written

MEASURES = ["mean_value", "std_value", "min_value", "max_value", "rate_of_change"]
NO_EVENT = "No Event"


def phase(event_type: str = "event_type") -> Column:
    """The phase an event type belongs to; a null type belongs to the second."""
    return F.when(F.col(event_type) == "Yoga Poses", "Yoga Phase").otherwise("Cognitive Load Phase")


def average_over_users(merged: DataFrame, measures: list[str] = MEASURES) -> DataFrame:
    """Mean of each measure per epoch, session and phase; rows with a null key are left out, null measures skipped."""
    keys = ["epoch", "session", "phase"]
    rows = merged.withColumn("phase", phase()).where(F.col("epoch").isNotNull() & F.col("session").isNotNull())
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in measures])


def most_frequent(rows: DataFrame, keys: list[str], value: str, order: str, default: str = NO_EVENT) -> DataFrame:
    """The most frequent value per group, of equally frequent ones the first seen; the default where all are null."""
    n = rows.groupBy(*keys, value).agg(F.count(value).alias("n"), F.min(order).alias("first"))
    top = n.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first"))).alias("t"))
    return top.select(*keys, F.when(F.col("t.n") > 0, F.col(f"t.{value}")).otherwise(default).alias(value))


def with_representatives(averages: DataFrame, representatives: DataFrame) -> DataFrame:
    """Averages with the representative event of their session and phase; those without one are left out."""
    return averages.join(small_side(representatives, "representatives"), ["session", "phase"])


def user_means(features: DataFrame, measure: str = "mean_value") -> DataFrame:
    """Mean of a measure and its number of readings per user, session and epoch."""
    known = features.where((F.col("user_id") >= 1) & (F.col("session") >= 1) & (F.col("epoch") >= 0))
    return known.groupBy("user_id", "session", "epoch").agg(F.avg(measure).alias("mean"), F.count(measure).alias("n"))


def participant_pairs(means: DataFrame) -> DataFrame:
    """The means of the two participants of each pair (1 and 2, 3 and 4, ...) side by side, per session and epoch; null where
    one of them has none."""
    first = F.col("user_id") % 2 == 1
    return means.groupBy(F.floor((F.col("user_id") + 1) / 2).alias("pair"), "session", "epoch").agg(F.max(F.when(first, F.col("mean"))).alias("first"), F.max(F.when(~first, F.col("mean"))).alias("second"))


def padded_average(features: DataFrame, measure: str = "mean_value", tail: int = 20) -> DataFrame:
    """Mean and population deviation over the streams of a session by epoch, a stream without the epoch counting as 0.

    Epochs run to the last but `tail`. Zeros need no rows: sums are divided by the number of streams.
    """
    v = features.where((F.col("session") >= 1) & (F.col("epoch") >= 0)).groupBy("session", "sid", "epoch").agg(F.avg(measure).alias("v"))
    whole = v.groupBy("session").agg(F.countDistinct("sid").alias("streams"), (F.max("epoch") + 1 - tail).alias("horizon"))
    sums = v.groupBy("session", "epoch").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("q"))
    m = F.col("s") / F.col("streams")
    return sums.join(small_side(whole, "horizons"), "session").where(F.col("epoch") < F.col("horizon")).select("session", "epoch", m.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("streams") - m * m, F.lit(0.0))).alias("std"))


def one_hot(df: DataFrame, column: str, values: list[str] | None = None, limit: int = 1000) -> DataFrame:
    """Adds 0/1 columns `{column}_{value}`. Without `values` the distinct ones are taken, of which there may be `limit`."""
    if values is None:
        found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
        if len(found) > limit:
            raise ValueError(f"{column} has more than {limit} values")
        values = sorted(found)
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def codes(df: DataFrame, column: str, order: str) -> DataFrame:
    """Adds code: 0, 1, ... in the order in which values are first seen; -1 for null. Of values first seen together the
    smaller comes first.

    Values are sorted over many tasks; each numbers its own from the number of those before, of which the driver gets
    one count a task."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    placed = first.repartitionByRange(F.col("_first").asc_nulls_last(), column).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(F.asc_nulls_last("_first"), column)
    placed = written(placed.withColumn("_n", F.row_number().over(w) - 1), "codes")
    counts = sorted(placed.groupBy("_part").count().collect())
    starts, so_far = {}, 0
    for part, n in counts:
        starts[part] = so_far
        so_far += n
    before = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_part")) if starts else F.lit(0)
    ranked = placed.select(column, (before + F.col("_n")).cast("bigint").alias("code"))
    return df.join(broadcast_if_small(ranked), column, "left").withColumn("code", F.coalesce("code", F.lit(-1).cast("bigint")))


def indicator_correlations(merged: DataFrame, column: str = "event_type", measures: list[str] = MEASURES, least: float = 0.0) -> DataFrame:
    """Pearson correlation of each measure with each value's indicator: (feature, indicator, r), |r| at least `least`.

    Only counts and sums per value are needed, so the rows are read once. No row where either side does not vary."""
    long = merged.select(F.col(column).alias("indicator"), F.inline(F.array(*[F.struct(F.lit(m).alias("feature"), F.col(m).alias("x")) for m in measures]))).where(F.col("x").isNotNull())
    per = long.groupBy("feature", "indicator").agg(F.count("*").cast("double").alias("k"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    allrows = per.groupBy("feature").agg(F.sum("k").alias("n"), F.sum("s").alias("sx"), F.sum("q").alias("qx"))
    j = per.where(F.col("indicator").isNotNull()).join(allrows, "feature")
    r = ratio(F.col("n") * F.col("s") - F.col("sx") * F.col("k"), F.sqrt((F.col("n") * F.col("qx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("k") - F.col("k") * F.col("k"))))
    return j.select("feature", "indicator", r.alias("r")).where(F.col("r").isNotNull() & (F.abs("r") >= least))


def cross_stream_correlations(features: DataFrame, measure: str = "mean_value") -> DataFrame:
    """Correlation over common epochs of any two streams of one device: (sid, other, epochs, r), both orders.

    Streams are reduced to one value per epoch first; a device has a handful of streams, so an epoch joins few rows.
    """
    v = features.where((F.col("session") >= 1) & (F.col("epoch") >= 0)).groupBy("sid", "session", "epoch").agg(F.avg(measure).alias("v")).where(F.col("v").isNotNull()).withColumn("device", F.element_at(F.split("sid", "_"), 1))
    o = v.select(F.col("sid").alias("other"), "device", "session", "epoch", F.col("v").alias("w"))
    j = v.join(o, ["device", "session", "epoch"]).where(F.col("sid") != F.col("other"))
    r = ratio(F.covar_pop("v", "w"), F.stddev_pop("v") * F.stddev_pop("w"))
    return j.groupBy("sid", "other").agg(F.count("*").alias("epochs"), r.alias("r"))
