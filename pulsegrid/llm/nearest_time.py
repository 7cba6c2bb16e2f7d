"""Matching records by nearest time, in expanding rings of time buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.hot_deck import nearest_donors
from pulsegrid.session import written

#: Doublings from the finest ring to the tolerance.
DOUBLINGS = 3


def _best(*candidates: Column) -> Column:
    """The candidate struct (d, id) with the smallest distance, then the smallest id; nulls do not count."""
    return F.array_min(F.filter(F.array(*candidates), lambda c: c.isNotNull()))


def _candidate(point: str) -> Column:
    return F.when(F.col(point).isNotNull(), F.struct(F.abs(F.col("t") - F.col(f"{point}.t")).alias("d"), F.col(f"{point}.rid").alias("rid")))


def _edges(points: DataFrame, width: int) -> DataFrame:
    """For every bucket that has a point in it or beside it: last point before, first and last inside, first after."""
    b = F.floor(F.col("t") / width)
    ends = points.groupBy("sid", b.alias("b")).agg(F.min(F.struct("t", "rid")).alias("first"), F.max(F.struct("t", "rid")).alias("last"))
    spread = ends.select("sid", "first", "last", F.explode(F.array(*[F.struct((F.col("b") + o).alias("b"), F.lit(o).alias("o")) for o in (-1, 0, 1)])).alias("s")).select("sid", "s.b", "s.o", "first", "last")
    o = F.col("o")
    return spread.groupBy("sid", "b").agg(F.max(F.when(o == 1, F.col("last"))).alias("before"), F.max(F.when(o == 0, F.col("first"))).alias("inner_first"), F.max(F.when(o == 0, F.col("last"))).alias("inner_last"), F.max(F.when(o == -1, F.col("first"))).alias("after"))


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int, doublings: int = DOUBLINGS) -> DataFrame:
    """Pairs each left record with the right record of the same entity that is nearest in time.

    left: (lid, sid, t), right: (rid, sid, t), times and tolerance in whole microseconds, tolerance a multiple of
    2 ** doublings. Result: (lid, rid, d) for every left record that has a right one at most `tolerance` away; of equally near ones the
    smaller rid. Records with a null entity or time are in no pair; repeated left records get a pair each; an empty
    table on either side gives no rows; a right record may be in many pairs.

    The first ring looks through buckets of tolerance / 2 ** doublings and those beside them. What is found within a
    bucket's width is provably nearest and accepted. Unresolved records go on to buckets twice as wide; as nothing
    lies within half such a width of them, only the first and last right record of each bucket can be nearest, so
    later rings join one row per bucket. No ring pairs up the records of a bucket. Each ring is written to the
    shared folder, so a ring is computed once and survives lost executors.
    """
    points = right.where(F.col("sid").isNotNull() & F.col("t").isNotNull()).groupBy("sid", "t").agg(F.min("rid").alias("rid"))
    todo = left.where(F.col("sid").isNotNull() & F.col("t").isNotNull()).select("lid", "sid", "t")
    rings, points = [], written(points, "points")
    for k in range(doublings, -1, -1):
        width = tolerance >> k
        if k == doublings:
            both = todo.select("lid", "sid", "t", F.lit(None).cast("bigint").alias("rid"), F.lit(True).alias("is_left")).unionByName(points.select(F.lit(None).cast("bigint").alias("lid"), "sid", "t", "rid", F.lit(False).alias("is_left")))
            around = nearest_donors(both, ["sid"], "t", ~F.col("is_left"), ["rid"], width).where("is_left")
            found = around.select("lid", "sid", "t", _best(_candidate("before"), _candidate("after")).alias("best"))
        else:
            near = todo.withColumn("b", F.floor(F.col("t") / width)).join(_edges(points, width), ["sid", "b"], "left")
            found = near.select("lid", "sid", "t", _best(*map(_candidate, ("before", "inner_first", "inner_last", "after"))).alias("best"))
        ring = written(found.withColumn("done", F.coalesce(F.col("best.d") <= width, F.lit(False))), f"ring{k}")
        rings.append(ring.where("done").select("lid", "best.rid", "best.d"))
        todo = ring.where(~F.col("done")).select("lid", "sid", "t")
    return reduce(DataFrame.unionAll, rings)
