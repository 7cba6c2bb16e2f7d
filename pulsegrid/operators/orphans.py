"""References to records that are missing, gone by then or not there yet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import micros

#: Fewest ranges of the key hash, and references, and parents on average, that one probing task takes of one range.
RANGES = 256
PER_TASK = 2_000_000
REASONS = ["missing", "later", "deleted"]
NEVER = np.iinfo(np.int64).max


def references(df: DataFrame, tbl: str, row_id: str, field: str, key: Column, ts: str = "ts") -> DataFrame:
    """The references that a table's column makes: (tbl, row_id, field, key, t), none where the key is null."""
    return df.select(F.lit(tbl).alias("tbl"), F.col(row_id).cast("bigint").alias("row_id"), F.lit(field).alias("field"), key.cast("string").alias("key"), micros(ts).alias("t")).where(F.col("key").isNotNull())


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents come first: they become arrays sorted by hash, in which batches of references are searched."""
    parts: list[pa.Table] = []
    h = start = end = keys = None
    for b in batches:
        t = pa.Table.from_batches([b])
        is_ref = t["is_ref"].combine_chunks().to_numpy(zero_copy_only=False)
        n = int(np.searchsorted(is_ref, True))
        if n:
            parts.append(t.slice(0, n))
        if n == t.num_rows:
            continue
        if h is None:
            p = pa.concat_tables(parts) if parts else t.slice(0, 0)
            p = p.sort_by([("hash", "ascending")])
            h, start, end = (p[c].combine_chunks().fill_null(0).to_numpy() for c in ("hash", "start", "end"))
            keys = p["key"].combine_chunks()
        r = t.slice(n)
        rh, ts = r["hash"].combine_chunks().to_numpy(), r["t"].combine_chunks()
        known_t, ts = np.asarray(ts.is_valid()), ts.fill_null(0).to_numpy()
        rk = r["key"].combine_chunks()
        at = np.searchsorted(h, rh)
        found = np.full(len(rh), -1)
        todo = np.flatnonzero(at < len(h))
        while len(todo):  # more than one round only where different keys share a hash
            todo = todo[h[at[todo]] == rh[todo]]
            same = np.asarray(keys.take(pa.array(at[todo])).to_numpy(zero_copy_only=False) == rk.take(pa.array(todo)).to_numpy(zero_copy_only=False), bool)
            found[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < len(h)]
        hit = found >= 0
        reason = np.full(len(rh), -1, np.int8)
        reason[~hit] = 0
        f = found[hit]
        late, gone = start[f] > ts[hit], end[f] <= ts[hit]
        sub = np.where(late, 1, np.where(gone, 2, -1)).astype(np.int8)
        sub[~known_t[hit]] = -1
        reason[hit] = sub
        miss = pa.array(np.flatnonzero(reason >= 0))
        out = r.select(["tbl", "row_id", "field", "t"]).take(miss).append_column("reason", pa.array(reason).take(miss))
        yield from out.combine_chunks().to_batches()


def orphans(refs: DataFrame, parents: DataFrame, per_task: int = PER_TASK, ranges: int | None = None) -> DataFrame:
    """References (tbl, row_id, field, key, t) that no parent (key, start, end in microseconds) satisfies at time t.

    Result: (tbl, row_id, field, t, reason). 'missing': no parent has the key; 'later': the parent starts after t;
    'deleted': it ended at or before t; 'later' goes before 'deleted'. Without t only 'missing' can hold. A parent
    without start has always been there, one without end still is. Of several parents with one key the earliest
    start and the latest end count. A null key is no reference. Repeated references come out each. Empty parents:
    every reference is missing.

    Scale: both sides are cut into ranges of the key's 64-bit hash, which are even whatever the keys are. A task
    holds the parents of its ranges as sorted arrays and searches batches of references in them. A range with more
    than `per_task` references, as of a hot key, is split among several tasks, each with the parents of that range;
    the counts per range, one row each, are all that is broadcast. Unless given, `ranges` grows with the parents, so
    that a range has about `per_task` of them at most.
    """
    ranges = ranges or max(RANGES, -(-parents.count() // per_task))
    h = F.xxhash64("key")
    width = (1 << 64) // ranges
    rng = F.floor(h / F.lit(float(width))).cast("int")
    r = refs.where(F.col("key").isNotNull()).withColumn("hash", h).withColumn("rng", rng)
    p = parents.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.coalesce("start", F.lit(-NEVER))).alias("start"), F.max(F.coalesce("end", F.lit(NEVER))).alias("end")).withColumn("hash", h).withColumn("rng", rng)
    splits = F.broadcast(r.groupBy("rng").agg(F.ceil(F.count("*") / per_task).cast("int").alias("splits")))
    r = r.join(splits, "rng").select("rng", F.pmod(F.xxhash64("row_id", "t"), F.col("splits")).cast("int").alias("split"), F.lit(True).alias("is_ref"), "hash", "key", "tbl", "row_id", "field", "t", F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"))
    p = p.join(splits, "rng").select("rng", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), F.lit(False).alias("is_ref"), "hash", "key", F.lit(None).cast("string").alias("tbl"), F.lit(None).cast("bigint").alias("row_id"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("bigint").alias("t"), "start", "end")
    found = p.unionByName(r).repartition("rng", "split").sortWithinPartitions("is_ref").mapInArrow(_probe, "tbl string, row_id bigint, field string, t bigint, reason byte")
    return found.withColumn("reason", F.element_at(F.array(*map(F.lit, REASONS)), F.col("reason").cast("int") + 1))


def by_period(found: DataFrame) -> DataFrame:
    """Counts per table, field, reason and month of the reference; rows without time have a null month."""
    month = F.date_format(F.timestamp_micros("t"), "yyyy-MM")
    return found.groupBy("tbl", "field", "reason", month.alias("month")).agg(F.count("*").alias("refs"))
