"""Continuous periods and gaps of overlapping intervals, by a sweep over their boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of one bucket of the sweep: at most as many distinct instants, so a bucket is bounded.
BUCKET_MS = 60_000


def periods_and_gaps(intervals: DataFrame, keys: list[str], start: str, end: str, slack: int, bucket: int = BUCKET_MS) -> DataFrame:
    """Periods covered per entity, and the gaps between them.

    intervals: `keys`, and `start` and `end` as whole numbers. Intervals not more than `slack` apart belong to one
    period. Result: (*keys, kind 'period' or 'gap', start, end). Rows with a null start or end, or that end before
    they start, are left out, and so are rows whose first key is null; other null keys form an entity of their own.
    Repeated and enclosed intervals change nothing; an instant is an interval; an empty table gives no rows.

    Every start counts plus one and every end, moved by the slack, minus one; a period runs while the sum is above
    zero. Scale: boundaries at one instant are added up before the shuffle; running sums are taken inside buckets
    of time, on top of the sums of the buckets before, so a hot entity is spread over its buckets.
    """
    key = F.col(keys[0])
    ok = intervals.where(key.isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    edge = F.inline(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("plus"), F.lit(0).alias("minus")), F.struct((F.col(end) + slack).alias("t"), F.lit(0).alias("plus"), F.lit(1).alias("minus"))))
    # entities are told apart by a struct, in which null keys are equal to themselves
    events = ok.select(F.struct(*keys).alias("entity"), edge).withColumn("b", F.floor(F.col("t") / bucket)).groupBy("entity", "b", "t").agg(F.sum("plus").alias("plus"), F.sum("minus").alias("minus"))
    across = Window.partitionBy("entity").orderBy("b")
    sums = events.groupBy("entity", "b").agg(F.sum(F.col("plus") - F.col("minus")).alias("net"))
    carried = sums.select("entity", "b", (F.sum("net").over(across) - F.col("net")).alias("carried"))
    inside = Window.partitionBy("entity", "b").orderBy("t")
    after = F.col("carried") + F.sum(F.col("plus") - F.col("minus")).over(inside)
    swept = events.join(carried, ["entity", "b"]).withColumn("after", after).withColumn("before", F.col("after") - F.col("plus") + F.col("minus"))
    turns = swept.where((F.col("before") == 0) | (F.col("after") == 0)).select("entity", "b", "t", (F.col("after") > 0).alias("opens"))
    firsts = turns.groupBy("entity", "b").agg(F.min("t").alias("first"))
    following = firsts.select("entity", "b", F.lead("first").over(across).alias("later"))
    until = turns.withColumn("next", F.lead("t").over(inside)).join(following, ["entity", "b"], "left").withColumn("next", F.coalesce("next", "later")).where(F.col("next").isNotNull())
    s = F.when(F.col("opens"), F.col("t")).otherwise(F.col("t") - slack)
    e = F.when(F.col("opens"), F.col("next") - slack).otherwise(F.col("next"))
    return until.select("entity.*", F.when(F.col("opens"), "period").otherwise("gap").alias("kind"), s.alias("start"), e.alias("end"))
