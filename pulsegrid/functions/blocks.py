"""Vectorised work on sorted groups: Spark shuffles and sorts, NumPy handles whole Arrow batches of groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group of equal keys begins; the table is sorted by the keys."""
    n = t.num_rows
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        c = t[k].combine_chunks()
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            c = pc.fill_null(c.dictionary_encode().indices, -1)
        elif c.null_count:
            c = pc.fill_null(c, -1)
        v = c.to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def numbers(t: pa.Table, name: str, null: float = np.nan) -> np.ndarray:
    """A column as a NumPy array, nulls replaced."""
    c = t[name].combine_chunks()
    if c.null_count:
        c = pc.fill_null(c, pa.scalar(null, c.type))
    return c.to_numpy(zero_copy_only=False)


def sorted_groups(df: DataFrame, keys: list[str], order: list[str | Column], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Hash-partitions by `keys`, sorts, and calls `fn(table, starts)` with whole groups.

    A call gets the groups that are complete in the Arrow batches read so far; the last, open group is carried
    over. Groups must be of bounded size, which callers see to by making a block number one of the keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            starts = group_starts(t, keys)
            if len(starts) < 2:
                held = t
                continue
            held = t.slice(int(starts[-1]))
            yield from fn(t.slice(0, int(starts[-1])).combine_chunks(), starts[:-1]).to_batches()
        if held is not None and held.num_rows:
            held = held.combine_chunks()
            yield from fn(held, group_starts(held, keys)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
