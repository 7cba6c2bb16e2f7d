"""Irregular readings onto a regular grid, empty cells filled by low-rank factorisation."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions.blocks import numbers, sorted_groups
from pulsegrid.functions.columns import entity_key, micros
from pulsegrid.session import broadcast_if_small

#: Channels of each modality with a grid.
CHANNELS = {m: schema.CHANNELS[m][: 4 if m == "EEG" else None] for m in ("ACC", "EEG", "PPG")}
STATUS = ["observed", "filled", "unsupported"]
#: Slots of one matrix: a recording of any length is cut into matrices of this width.
BLOCK_SLOTS = 2048
RANK, ROUNDS, RIDGE, LARGE = 2, 8, 0.1, 4.0
#: Observed cells that a channel must have in a matrix for its empty cells to be filled.
MIN_OBSERVED = 4
#: Slots on either side of a slot that its column shows as well: a matrix has a row for each channel and lag from -LAGS to LAGS.
LAGS = 4


def _medians(row: np.ndarray, x: np.ndarray, n_rows: int) -> np.ndarray:
    """The lower median of the values of each row, 0 for a row without any."""
    if not len(x):
        return np.zeros(n_rows)
    count = np.bincount(row, minlength=n_rows)
    at = np.cumsum(count) - count + np.maximum(count - 1, 0) // 2
    return np.where(count > 0, x[np.lexsort((x, row))][np.minimum(at, len(x) - 1)], 0.0)


def als_fill(row: np.ndarray, col: np.ndarray, x: np.ndarray, n_rows: int, n_cols: int, tilt: np.ndarray | None = None, rounds: int = ROUNDS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rank-2 alternating least squares over the observed cells (row, col, x) of many matrices at once.

    Rows are channels at a lag and columns slots, numbered across all matrices, so a round is a few bincounts over the
    observed cells and a closed-form 2 x 2 solve per row and column. `tilt` is what rows differ by at first, their lag.
    Readings count from the median of their row, in median deviations and at most LARGE of them, so that an implausible
    one does not bend the factors. Returns the row and column factors and the median and scale of each row.
    """
    mid = _medians(row, x, n_rows)
    scale = 1.4826 * _medians(row, np.abs(x - mid[row]), n_rows)
    scale[scale == 0] = 1.0
    z = np.clip((x - mid[row]) / scale[row], -LARGE, LARGE)
    u = np.stack([np.ones(n_rows), np.where(np.arange(n_rows) % 2, -0.5, 0.5) if tilt is None else tilt])
    v = np.zeros((2, n_cols))

    def solve(index: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
        a = np.bincount(index, other[0] * other[0], n) + ridge
        b = np.bincount(index, other[0] * other[1], n)
        d = np.bincount(index, other[1] * other[1], n) + ridge
        p, q = np.bincount(index, other[0] * z, n), np.bincount(index, other[1] * z, n)
        det = a * d - b * b
        return np.stack([(d * p - b * q) / det, (a * q - b * p) / det])

    for _ in range(rounds):
        v = solve(col, u[:, row], n_cols)
        u = solve(row, v[:, col], n_rows)
    return u, solve(col, u[:, row], n_cols), mid, scale


def _fill(t: pa.Table, starts: np.ndarray, block_slots: int) -> pa.Table:
    """Completes the matrices of one batch. The first row of a group says how many slots and which channels it has;
    a group without such a row lies outside every recording and is dropped."""
    bounds = np.append(starts, t.num_rows)
    head = t.take(pa.array(starts))
    size = np.maximum(numbers(head, "n_slots", 0), 0).astype(np.int64)
    kinds = head["channels"].combine_chunks().dictionary_encode()
    lists = [(c or "").split(",") for c in kinds.dictionary.to_pylist()]
    kind = kinds.indices.fill_null(len(lists)).to_numpy(zero_copy_only=False)
    width = np.where(size > 0, np.array([*map(len, lists), 0])[kind], 0)
    rows_at, cols_at = np.cumsum(width) - width, np.cumsum(size) - size
    cells = width * size
    cell_at = np.cumsum(cells) - cells
    group = np.repeat(np.arange(len(starts)), np.diff(bounds))
    names = t["channel"].combine_chunks().dictionary_encode()
    known = names.dictionary.to_pylist()
    place = np.full((len(lists) + 1, len(known) + 1), -1)  # which row of its matrix a channel is, by the kind of the matrix
    for i, cs in enumerate(lists):
        place[i, : len(known)] = [cs.index(c) if c in cs else -1 for c in known]
    inner = place[kind[group], names.indices.fill_null(len(known)).to_numpy(zero_copy_only=False)]
    x, slot = numbers(t, "value"), numbers(t, "slot", -1).astype(np.int64)
    block0 = numbers(t, "block", 0).astype(np.int64) * block_slots
    k = slot - block0
    keep = (inner >= 0) & (k >= 0) & (k < size[group]) & ~np.isnan(x)
    group, row, k, x = group[keep], (rows_at[group] + inner)[keep], k[keep], x[keep]
    n_rows, n_cols, span = int(width.sum()), int(size.sum()), 2 * LAGS + 1
    # what was seen in a slot stands in the columns of the slots around it too, in the row of the lag: a column without readings is known by its neighbours
    to = k[:, None] + np.arange(-LAGS, LAGS + 1)
    there = (to >= 0) & (to < size[group][:, None])
    lagged_row = (row[:, None] * span + np.arange(span))[there]
    lagged_col = (cols_at[group][:, None] + to)[there]
    tilt = np.tile(np.arange(-LAGS, LAGS + 1) / LAGS, n_rows) + np.repeat(np.where(np.arange(n_rows) % 2, -0.1, 0.1), span)
    u, v, mean, scale = als_fill(lagged_row, lagged_col, np.repeat(x, there.sum(axis=1)), n_rows * span, n_cols, tilt)
    u, mean, scale = u[:, LAGS::span], mean[LAGS::span], scale[LAGS::span]  # the rows without lag

    cell_group = np.repeat(np.arange(len(starts)), cells)
    inner = np.arange(int(cells.sum())) - cell_at[cell_group]
    cell_k = inner % np.maximum(size[cell_group], 1)
    cell_row = rows_at[cell_group] + inner // np.maximum(size[cell_group], 1)
    cell_col = cols_at[cell_group] + cell_k
    value = mean[cell_row] + scale[cell_row] * (u[:, cell_row] * v[:, cell_col]).sum(axis=0)
    supported = (np.bincount(lagged_col, minlength=n_cols) > 0)[cell_col] & (np.bincount(row, minlength=n_rows) >= MIN_OBSERVED)[cell_row]
    status = np.where(supported, 1, 2).astype(np.int8)
    at = cell_at[group] + (row - rows_at[group]) * size[group] + k
    status[at], value[at] = 0, x
    flat = pa.array([c for i, n in zip(kind, size) if n > 0 and i < len(lists) for c in lists[i]], pa.string())
    take = pa.array(cell_group)
    return pa.table({
        "stream_id": head["stream_id"].combine_chunks().take(take), "session": head["session"].combine_chunks().take(take), "channel": flat.take(pa.array(cell_row)),
        "slot": pa.array(block0[starts][cell_group] + cell_k), "value": pa.array(value, mask=status == 2), "status": pa.array(status),
    })


def _kept(hidden: int) -> Column:
    return F.pmod(F.xxhash64("sid", "session", "channel", "slot"), F.lit(1000)) >= hidden


def _cells(readings: DataFrame, recordings: DataFrame, channels: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """The recordings with their slots and channels, and the cells (sid, session, channel, slot, value) that were read."""
    start, step = micros("rec_start"), F.col("step_us")
    modality = F.upper(F.element_at(F.split(F.trim("stream_id"), "_"), -1))
    known = F.create_map(*[F.lit(x) for m, cs in channels.items() for x in (m, ",".join(cs))])
    recs = (
        recordings.where((step > 0) & F.col("session").isNotNull())
        .select("stream_id", entity_key("stream_id").alias("sid"), "session", start.alias("start"), step.alias("step"), ((micros("rec_end") - start) / step).cast("bigint").alias("slots"), F.try_element_at(known, modality).alias("channels"))
        .where((F.col("slots") > 0) & F.col("channels").isNotNull())
        .dropDuplicates(["sid", "session"])
    )
    value = F.col("value")
    slot = F.floor((micros("ts") - F.col("start")) / F.col("step"))
    cells = (
        readings.where(F.upper("modality").isin(*channels) if "modality" in readings.columns else F.lit(True))
        .where(value.isNotNull() & ~F.isnan(value) & F.col("ts").isNotNull())
        .select(entity_key("stream_id").alias("sid"), "session", "channel", "pos", "ts", "value")
        .join(broadcast_if_small(recs.select("sid", "session", "start", "step", "slots")), ["sid", "session"])
        .withColumn("slot", slot)
        .where((F.col("slot") >= 0) & (F.col("slot") < F.col("slots")))
        .groupBy("sid", "session", "channel", "slot")
        .agg(F.min_by("value", F.struct("pos", "value")).alias("value"))
    )
    return recs, cells


def grid_fill(readings: DataFrame, recordings: DataFrame, channels: dict[str, list[str]] = CHANNELS, block_slots: int = BLOCK_SLOTS, hidden: int = 0) -> DataFrame:
    """A regular series for every channel of every recording.

    readings: stream_id, session, channel, pos, ts, value; recordings: stream_id, session, rec_start, rec_end,
    step_us. The modality is what follows the last underscore of a stream id. Result: one row per channel and slot,
    (stream_id as in recordings, session, channel, slot bigint, value double, status): 'observed' has the value of
    the earliest reading of that slot, unchanged; 'filled' has the value of a rank-2 factorisation of a matrix that has a
    row for each channel at each lag of up to LAGS slots and a column for each slot; 'unsupported' has null, as no
    channel of the recording was read within LAGS slots of it, or the channel itself hardly ever.

    With `hidden`, so many of a thousand observed cells, chosen by a hash, are treated as empty: see held_out.

    Null and NaN values, null timestamps and readings outside their recording leave their slots empty; readings
    sent twice count once; a recording without bounds or with a step below 1 has no series; of equal recordings one
    counts; an empty table of readings gives unsupported cells only. Other columns of either table are ignored.

    Scale: readings shrink to one row per cell with map-side combine; recordings of any length are cut into
    matrices of `block_slots` slots, so a hot recording is spread over many tasks.
    """
    recs, cells = _cells(readings, recordings, channels)
    cells = cells.where(_kept(hidden)) if hidden else cells
    block = F.explode(F.sequence(F.lit(0), ((F.col("slots") - 1) / block_slots).cast("int")))
    heads = recs.select("*", block.alias("block")).select(
        "sid", "session", "block", F.lit(None).cast("string").alias("channel"), F.lit(None).cast("bigint").alias("slot"), F.lit(None).cast("double").alias("value"),
        F.least(F.col("slots") - F.col("block").cast("bigint") * block_slots, F.lit(block_slots)).cast("int").alias("n_slots"), "channels", "stream_id",
    )
    none = F.lit(None)
    body = cells.select("sid", "session", (F.col("slot") / block_slots).cast("int").alias("block"), "channel", "slot", "value", none.cast("int").alias("n_slots"), none.cast("string").alias("channels"), none.cast("string").alias("stream_id"))
    out = sorted_groups(heads.unionByName(body), ["sid", "session", "block"], [F.col("slot").asc_nulls_first()], partial(_fill, block_slots=block_slots), "stream_id string, session int, channel string, slot bigint, value double, status byte")
    return out.withColumn("status", F.element_at(F.array(*map(F.lit, STATUS)), F.col("status").cast("int") + 1))


def held_out(readings: DataFrame, recordings: DataFrame, channels: dict[str, list[str]] = CHANNELS, hidden: int = 50) -> DataFrame:
    """How well hidden cells are filled, per channel: (channel, cells hidden, filled = how many of them were filled, error =
    their median absolute error, plain = what it is if the median of the channel's visible cells in the recording is
    put in). Medians are those of a sketch of bounded size."""
    _, cells = _cells(readings, recordings, channels)
    keys, half = ["sid", "session", "channel"], F.lit(0.5)
    away = cells.where(~_kept(hidden)).select(*keys, "slot", F.col("value").alias("truth"))
    usual = cells.where(_kept(hidden)).groupBy(*keys).agg(F.percentile_approx("value", half).alias("usual"))
    g = grid_fill(readings, recordings, channels, hidden=hidden).where(F.col("status") != "observed").select(entity_key("stream_id").alias("sid"), "session", "channel", "slot", "value")
    j = away.join(g, [*keys, "slot"], "left").join(usual, keys, "left")
    off = lambda c: F.percentile_approx(F.when(F.col("value").isNotNull(), F.abs(F.col("truth") - F.col(c))), half)
    return j.groupBy("channel").agg(F.count("*").alias("cells"), F.count("value").alias("filled"), off("value").alias("error"), off("usual").alias("plain"))


def empty_slots(grid: DataFrame) -> DataFrame:
    """The slots of a grid in which no reading fell."""
    return grid.where(F.col("status") != "observed").select("stream_id", "session", "channel", "slot")
