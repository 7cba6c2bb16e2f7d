"""Implausible readings: impossible values, stuck stretches and spikes, per source."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.blocks import numbers, sorted_groups
from pulsegrid.functions.columns import entity_key
from pulsegrid.functions.quantiles import exact_medians
from pulsegrid.session import small_side, written

#: Physically possible values of each channel. Fixed values.
PLAUSIBLE = {
    "GSR": (0.01, 100.0),
    "TEMP": (15.0, 43.0),
    "BVP": (-500.0, 500.0),
    "AF7": (-1000.0, 1000.0),
}
STUCK = 12  # successive equal readings
GROUP = 3  # readings of one spike at most
LIMIT = 10.0  # median steps that a spike exceeds
TAIL = 0.1  # share of a source's readings whose excursions are its peaks, at most
BINS = 16  # bins to a doubling of the excursion, at whose borders peaks may begin
RISK = 0.03  # share of a source's readings that exceed its tail cutoff by the fitted law
MIN_PEAKS = 10
#: Positions of one cycle that are tried as the season of a source.
PERIODS = (8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
CYCLES = 2  # cycles that a source must be long to have a season
BLOCK = 8192  # positions of one source in a block
SOURCE = ["sid", "session", "channel"]


def excursions(x: np.ndarray) -> np.ndarray:
    """For each reading of a series, how far the group of at most GROUP readings around it that stands out most lies
    above or below both its neighbours."""
    n = len(x)
    e = np.zeros(n)
    for g in range(1, GROUP + 1):
        m = n - g - 1
        if m < 1:
            break
        low, high = x[1 : 1 + m].copy(), x[1 : 1 + m].copy()
        for j in range(1, g):
            np.minimum(low, x[1 + j : 1 + j + m], out=low)
            np.maximum(high, x[1 + j : 1 + j + m], out=high)
        before, after = x[:m], x[g + 1 : g + 1 + m]
        out = np.maximum(low - np.maximum(before, after), np.minimum(before, after) - high)
        for j in range(g):
            np.maximum(e[1 + j : 1 + j + m], out, out=e[1 + j : 1 + j + m])
    return e


def run_lengths(x: np.ndarray) -> np.ndarray:
    """For each reading, how many successive equal readings it is one of."""
    if not len(x):
        return np.zeros(0, np.int64)
    run = np.concatenate([[0], np.cumsum(x[1:] != x[:-1])])
    return np.bincount(run)[run]


def _edges(t: pa.Table, starts: np.ndarray) -> pa.Table:
    """First and last readings of each block, for its neighbours."""
    pos, x, bad = numbers(t, "pos"), numbers(t, "value"), numbers(t, "impossible")
    out: dict[str, list] = {k: [] for k in ENDS}
    bounds = np.append(starts, t.num_rows)
    for a, b in zip(bounds[:-1], bounds[1:]):
        v, ok = x[a:b], ~bad[a:b]
        c, p = v[ok], pos[a:b][ok].astype(float)
        for k, e in zip(ENDS, (v[: STUCK - 1], v[1 - STUCK :], c[:GROUP], c[-GROUP:], p[:GROUP], p[-GROUP:])):
            out[k].append(e)
    keys = t.take(pa.array(starts))
    return pa.table({k: keys[k] for k in (*SOURCE, "block")} | {k: pa.array(v, pa.list_(pa.float64())) for k, v in out.items()})


def _judge(t: pa.Table, starts: np.ndarray) -> pa.Table:
    """Judges the readings of each block between the readings of the blocks before and after. The first row of a group
    has the block's surroundings and the season of its source, and no value."""
    pos, x, bad = numbers(t, "pos", -1), numbers(t, "value"), numbers(t, "impossible", False)
    halo = {k: t[k].combine_chunks() for k in AROUND}
    season = {k: numbers(t, k, 0.0) for k in ("period", "c", "s")}
    bounds = np.append(starts, t.num_rows)
    where, stuck, score, rise, step = [], [], [], [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        around = {k: np.array(v[int(a)].as_py() or [], float) for k, v in halo.items()}
        turn = 2 * np.pi / season["period"][a] if season["period"][a] else 0.0
        cos, sin = season["c"][a], season["s"][a]
        own = np.arange(a + 1, b)
        v, ok = x[own], ~bad[own]
        p = len(around["before"])
        runs = run_lengths(np.concatenate([around["before"], v, around["after"]]))[p : p + len(v)]
        c = np.concatenate([around["clean_before"], v[ok], around["clean_after"]])
        at = np.concatenate([around["pos_before"], pos[own][ok], around["pos_after"]]) * turn
        q, m = len(around["clean_before"]), int(ok.sum())
        e, r, d = np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v))
        e[ok] = excursions(c - cos * np.cos(at) - sin * np.sin(at))[q : q + m]
        r[ok] = excursions(c)[q : q + m]
        if len(c):
            d[ok] = np.abs(np.diff(c, prepend=c[:1]))[q : q + m]
        for k, y in zip((where, stuck, score, rise, step), (own, runs >= STUCK, e, r, d)):
            k.append(y)
    each = {k: np.concatenate(y) if y else np.zeros(0) for k, y in (("stuck", stuck), ("score", score), ("rise", rise), ("step", step))}
    own = t.select([*SOURCE, "stream_id", "pos", "value", "impossible"]).take(pa.array(np.concatenate(where) if where else np.zeros(0, np.int64)))
    for k, y in each.items():
        own = own.append_column(k, pa.array(y, pa.bool_() if k == "stuck" else pa.float64()))
    return own


ENDS = ("head", "tail", "clean_head", "clean_tail", "pos_head", "pos_tail")
AROUND = ("before", "after", "clean_before", "clean_after", "pos_before", "pos_after")


def plausible_readings(readings: DataFrame, plausible: dict[str, tuple[float, float]] = PLAUSIBLE, block: int = BLOCK) -> DataFrame:
    """Readings of the channels with bounds, each key once (its smallest value), with their block and whether they are
    impossible; written to the shared folder, as they are read several times."""
    bounds = F.create_map(*[y for c, (a, b) in plausible.items() for y in (F.lit(c), F.array(F.lit(a), F.lit(b)))])[F.col("channel")]
    v = F.col("value")
    keys = [entity_key("stream_id").alias("sid"), "session", "channel", F.floor(F.col("pos") / block).cast("int").alias("block"), "pos"]
    rows = readings.where(F.col("channel").isin(*plausible) & v.isNotNull() & ~F.isnan(v) & F.col("pos").isNotNull()).groupBy(*keys).agg(F.min("value").alias("value"), F.min("stream_id").alias("stream_id"))
    return written(rows.withColumn("impossible", (v < bounds[0]) | (v > bounds[1])), "readings")


def seasons(rows: DataFrame, periods: tuple[int, ...] = PERIODS, cycles: int = CYCLES) -> DataFrame:
    """The season of each source: (source, period, c, s), c cos(2 pi pos / period) + s sin(2 pi pos / period), of the period
    whose wave is strongest among those of which the source has `cycles`; no row where there is none.

    The Fourier sums of all periods come from one aggregation with map-side combine."""
    x = F.col("value")
    wave = lambda f, p: f(F.col("pos") * (2 * math.pi / p))
    sums = [F.sum(y * wave(f, p)).alias(f"{k}{n}{p}") for p in periods for k, f in (("c", F.cos), ("s", F.sin)) for n, y in (("x", x), ("", F.lit(1.0)))]
    g = rows.where(~F.col("impossible")).groupBy(*SOURCE).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), (F.max("pos") - F.min("pos") + 1).alias("span"), *sums)
    part = lambda k, p: (F.col(f"{k}x{p}") - F.col("mean") * F.col(f"{k}{p}")) * 2 / F.col("n")
    fits = [F.when(F.col("span") >= cycles * p, F.struct((part("c", p) * part("c", p) + part("s", p) * part("s", p)).alias("strength"), F.lit(float(p)).alias("period"), part("c", p).alias("c"), part("s", p).alias("s"))) for p in periods]
    return g.select(*SOURCE, F.array_max(F.array_compact(F.array(*fits))).alias("best")).where(F.col("best").isNotNull()).select(*SOURCE, "best.period", "best.c", "best.s")


def judge_readings(readings: DataFrame, plausible: dict[str, tuple[float, float]] = PLAUSIBLE, block: int = BLOCK) -> DataFrame:
    """Every reading with what its neighbours say: impossible, stuck, score (its excursion after the season is taken off),
    rise (its excursion as it stands) and step. The result is written to the shared folder. See flag_readings."""
    rows = plausible_readings(readings, plausible, block)
    edges = sorted_groups(rows, [*SOURCE, "block"], ["pos"], _edges, "sid string, session int, channel string, block int, " + ", ".join(f"{e} array<double>" for e in ENDS))
    edges = written(edges, "edges")
    by = Window.partitionBy(*SOURCE).orderBy("block")

    def nearest(c: Column, k: int, back: bool) -> Column:
        return F.when(F.size(c) > k, F.slice(c, -k, k) if back else F.slice(c, 1, k)).otherwise(c)

    def surroundings(e: DataFrame, k: int, ends: list[tuple[str, str]]) -> DataFrame:
        before = [nearest(F.flatten(F.collect_list(tail).over(by.rowsBetween(-k, -1))), k, True) for _, tail in ends]
        after = [nearest(F.flatten(F.collect_list(head).over(by.rowsBetween(1, k))), k, False) for head, _ in ends]
        names = {"head": ("before", "after"), "clean_head": ("clean_before", "clean_after"), "pos_head": ("pos_before", "pos_after")}
        return e.select(*SOURCE, "block", *[c.alias(names[h][i]) for i, side in enumerate((before, after)) for (h, _), c in zip(ends, side)])

    run = surroundings(edges, STUCK - 1, [("head", "tail")])
    clean = surroundings(edges.where(F.size("clean_head") > 0), GROUP, [("clean_head", "clean_tail"), ("pos_head", "pos_tail")])
    halo = run.join(clean, [*SOURCE, "block"], "left").join(small_side(seasons(rows), "seasons"), SOURCE, "left")
    none = F.array().cast("array<double>")  # not null: a column of null lists is slow to send to Python
    no = lambda t: F.lit(None).cast(t)
    both = rows.select("*", *[none.alias(c) for c in AROUND], *[no("double").alias(c) for c in ("period", "c", "s")]).unionByName(
        halo.select(*SOURCE, "block", *[F.coalesce(c, none).alias(c) for c in AROUND], "period", "c", "s", no("string").alias("stream_id"), F.lit(-1).cast("bigint").alias("pos"), no("double").alias("value"), no("boolean").alias("impossible"))
    )
    judged = sorted_groups(both, [*SOURCE, "block"], [F.col("value").isNotNull(), "pos"], _judge, "sid string, session int, channel string, stream_id string, pos bigint, value double, impossible boolean, stuck boolean, score double, rise double, step double")
    return written(judged, "judged")


def tail_cutoff(u: Column, peaks: Column, rows: Column, log1: Column, log2: Column, risk: float = RISK) -> Column:
    """Value that a share `risk` of `rows` readings exceeds, of which `peaks` exceed `u`: a generalised Pareto tail above u
    whose shape and scale come from the mean (log1) and mean square (log2) of ln(peak / u), the moment estimator, which
    a few huge outliers hardly move. Null where the peaks are all alike; u where no more than the risk exceed it."""
    below = 1 - 0.5 / (1 - log1 * log1 / F.nullif(log2, F.lit(0.0)))
    shape, scale = log1 + below, u * log1 * (1 - below)
    often = peaks / (risk * rows)
    tail = F.when(F.abs(shape) < 1e-6, scale * F.ln(often)).otherwise(scale / shape * (F.pow(often, shape) - 1))
    return F.when(often <= 1, u).when(log2 - log1 * log1 > 1e-9, u + tail)


def tail_model(judged: DataFrame, risk: float = RISK, tail: float = TAIL) -> DataFrame:
    """Per source: median step (unit), readings, the threshold u from which excursions count as peaks, peaks, the moments of
    their logarithms, and the cutoff that a share `risk` of the readings exceeds.

    u is the lowest border of logarithmic bins that no more than the share `tail` exceeds, found from counts per bin. A
    source with fewer than MIN_PEAKS peaks has no tail to fit: each of its peaks is then beyond the cutoff."""
    med = exact_medians(judged.where(~F.col("impossible")), SOURCE, "step", "unit")
    ok = judged.where(~F.col("impossible"))
    score = F.col("score")
    hist = ok.groupBy(*SOURCE, F.when(score > 0, F.floor(F.log2(F.when(score > 0, score)) * BINS)).alias("bin")).agg(F.count("*").alias("n"))
    upto, rows = F.sum("n").over(Window.partitionBy(*SOURCE).orderBy(F.desc_nulls_last("bin"))), F.sum("n").over(Window.partitionBy(*SOURCE))
    edge = F.pow(F.lit(2.0), F.col("bin") / BINS)
    starts = hist.withColumn("upto", upto).withColumn("rows", rows).groupBy(*SOURCE).agg(F.coalesce(F.min(F.when(F.col("upto") <= tail * F.col("rows"), edge)), F.max(edge)).alias("u"))
    u, over = F.col("u"), F.when(score > F.col("u"), F.ln(score / F.col("u")))
    fit = ok.join(small_side(starts, "starts"), SOURCE).groupBy(*SOURCE).agg(F.first("u").alias("u"), F.count("*").alias("rows"), F.count(over).alias("peaks"), F.avg(over).alias("log1"), F.avg(over * over).alias("log2"))
    fitted = tail_cutoff(u, F.col("peaks"), F.col("rows"), F.col("log1"), F.col("log2"), risk)
    return fit.withColumn("cutoff", F.coalesce(F.when(F.col("peaks") >= MIN_PEAKS, fitted), u)).join(med, SOURCE, "left")


def flag_readings(readings: DataFrame, plausible: dict[str, tuple[float, float]] = PLAUSIBLE, risk: float = RISK, block: int = BLOCK) -> DataFrame:
    """Readings that are impossible, stuck or beyond the tail cutoff of their own source.

    readings: stream_id, session, channel, pos, value. A source is (stream_id, session, channel); its readings follow
    one another by pos. Result: (sid = normalised stream id, session, channel, pos, value, impossible, stuck,
    score, rise, cutoff, unit, spike, stream_id as it stands). score is the excursion of a reading, alone or with one or
    two beside it, over both its neighbours after the season of its source was taken off; readings whose score exceeds
    the cutoff that the tail model sets at `risk` are candidates. spike says of a candidate that its excursion as it
    stands exceeds LIMIT median steps, the exact check behind the model.

    Null and NaN values and null positions are no readings; rows of one key count once (the smallest value if they
    differ); sources without two different readings have no spikes; an empty table gives an empty result; channels
    without plausible bounds are left out. Other columns are ignored.

    Scale: rows of one key are combined before they are sent anywhere, and sources are cut into blocks of `block`
    positions. What a block must know of others, the eleven readings and the three possible readings on either side,
    comes from a table of block edges, so no task holds a source.
    """
    judged = judge_readings(readings, plausible, block)
    return candidates(judged, tail_model(judged, risk)).where(F.col("impossible") | F.col("stuck") | F.col("beyond")).drop("beyond")


def candidates(judged: DataFrame, model: DataFrame) -> DataFrame:
    """Judged readings that are impossible, stuck or stand out at all, with the cutoff of their source, `beyond` (their
    score exceeds it) and `spike`."""
    stands_out = judged.where(F.col("impossible") | F.col("stuck") | (F.col("score") > 0) | (F.col("rise") > 0))
    d = stands_out.join(small_side(model.select(*SOURCE, "unit", "cutoff"), "model"), SOURCE, "left")
    over = lambda c: F.coalesce(~F.col("impossible") & c, F.lit(False))
    return d.withColumn("beyond", over(F.col("score") > F.col("cutoff"))).withColumn("spike", over(F.col("rise") > LIMIT * F.col("unit"))).drop("step")


def cutoff_report(readings: DataFrame, plausible: dict[str, tuple[float, float]] = PLAUSIBLE, risk: float = RISK) -> DataFrame:
    """How the cutoffs do, per source with plausible readings: (sid, session, channel, readings, peaks, cutoff in median steps,
    candidates, spikes among them, missed = spikes by the definition that the cutoff passed over)."""
    judged = judge_readings(readings, plausible)
    model = written(tail_model(judged, risk), "tails")
    n = candidates(judged, model).groupBy(*SOURCE).agg(F.count_if("beyond").alias("candidates"), F.count_if(F.col("beyond") & F.col("spike")).alias("spikes"), F.count_if(~F.col("beyond") & F.col("spike")).alias("missed"))
    out = model.select(*SOURCE, F.col("rows").alias("readings"), "peaks", (F.col("cutoff") / F.col("unit")).alias("cutoff")).join(n, SOURCE, "left")
    return out.na.fill(0, ["candidates", "spikes", "missed"])
