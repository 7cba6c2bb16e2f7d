"""Order-dependent building blocks for long series: neighbours, halos and running sums without one task per series.

A series is cut into blocks by its position. Windows run inside blocks; what crosses a block's border is one small
row per block. So a series that has a third of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192


def _block(pos: str, block: int) -> Column:
    return F.floor(F.col(pos) / block)


def with_neighbours(df: DataFrame, keys: list[str], pos: str, item: Column, prev: str, after: str, block: int = BLOCK) -> DataFrame:
    """Adds the nearest non-null item strictly before (`prev`) and strictly after (`after`) each row; positions are unique per series."""
    d = df.withColumn("_b", _block(pos, block)).withColumn("_item", item)
    k = [*keys, "_b"]
    up, down = Window.partitionBy(*k).orderBy(pos), Window.partitionBy(*k).orderBy(F.col(pos).desc())
    to_here = (Window.unboundedPreceding, -1)
    at = F.when(F.col("_item").isNotNull(), F.col(pos))
    spine = d.groupBy(*k).agg(F.max_by("_item", at).alias("_last"), F.min_by("_item", at).alias("_first"))  # null in a block without items
    w, v = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys).orderBy(F.col("_b").desc())
    carried = spine.select(*k, F.last("_last", ignorenulls=True).over(w.rowsBetween(*to_here)).alias("_from"), F.last("_first", ignorenulls=True).over(v.rowsBetween(*to_here)).alias("_to"))
    inside = d.withColumn("_in_p", F.last("_item", ignorenulls=True).over(up.rowsBetween(*to_here))).withColumn("_in_n", F.last("_item", ignorenulls=True).over(down.rowsBetween(*to_here)))
    out = inside.join(carried, k)
    return out.withColumn(prev, F.coalesce("_in_p", "_from")).withColumn(after, F.coalesce("_in_n", "_to")).drop("_b", "_item", "_in_p", "_in_n", "_from", "_to")


def with_halo(df: DataFrame, keys: list[str], pos: str, before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """Adds `_b` and `_home`: every row in its own block, and rows near a border also in the block beside it."""
    b, at = _block(pos, block), F.pmod(F.col(pos), F.lit(block))
    places = F.array(
        F.struct(b.alias("_b"), F.lit(True).alias("_home")),
        F.when(at >= block - before, F.struct((b + 1).alias("_b"), F.lit(False).alias("_home"))) if before else F.lit(None).cast("struct<_b:bigint,_home:boolean>"),
        F.when(at < after, F.struct((b - 1).alias("_b"), F.lit(False).alias("_home"))) if after else F.lit(None).cast("struct<_b:bigint,_home:boolean>"),
    )
    return df.select("*", F.inline(F.filter(places, lambda p: p.isNotNull())))


def with_running_sum(df: DataFrame, keys: list[str], pos: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the sum of `value` over the rows of the series up to and with each row."""
    d = df.withColumn("_b", _block(pos, block)).withColumn("_v", value)
    k = [*keys, "_b"]
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy(*k).agg(F.sum("_v").alias("_s")).select(*k, F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy(*k).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(name, inside).join(before, k).withColumn(name, F.col(name) + F.col("_before")).drop("_b", "_v", "_before")
