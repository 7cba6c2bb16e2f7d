"""Exact medians per group without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import small_side

#: Histogram bins to a doubling of the value.
BINS_PER_OCTAVE = 64


def exact_medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """The median of positive, non-null values per group, equal to sorting each group.

    Values are counted in logarithmic bins first (map-side combined, at most a few thousand bins a group). Only
    the bins that hold the two middle ranks are read again, and there equal values are counted before they are
    ranked. So a group that has a third of all rows costs no task more than its share. Groups without a positive
    value have no row.
    """
    v = df.where(F.col(value) > 0).select(*keys, F.col(value).alias("v"), F.floor(F.log2(value) * BINS_PER_OCTAVE).cast("int").alias("bin"))
    by_bin = Window.partitionBy(*keys).orderBy("bin")
    hist = v.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    hist = hist.withColumn("upto", F.sum("n").over(by_bin)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor((F.col("all") + 2) / 2)
    middle = hist.where((F.col("upto") >= low) & (F.col("upto") - F.col("n") < high)).select(*keys, "bin", (F.col("upto") - F.col("n")).alias("before"), low.alias("low"), high.alias("high"))
    inside = v.join(small_side(middle, "middle"), [*keys, "bin"]).groupBy(*keys, "bin", "before", "low", "high", "v").agg(F.count("*").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "bin").orderBy("v"))
    ranked = inside.withColumn("upto", upto)
    lower = F.min(F.when(F.col("upto") >= F.col("low"), F.col("v")))
    upper = F.min(F.when(F.col("upto") >= F.col("high"), F.col("v")))
    return ranked.groupBy(*keys).agg(((lower + upper) / 2).alias(name))
