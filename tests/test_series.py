"""Order-dependent helpers give the same for any block size, and features equal NumPy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.ordered import with_running_sum
from pulsegrid.functions.quantiles import exact_medians
from pulsegrid.operators import epoch_features as E
from pulsegrid.operators import series as S

ROW = "sid string, session int, channel string, pos bigint, ts timestamp_ntz, value double"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    out = []
    for s in ("a", "b"):
        for c in ("X", "Y"):
            for p in range(120):
                v = None if rng.random() < 0.2 or p < 3 else float(np.round(rng.normal(), 1))
                out.append((s, 1, c, p, T0 + dt.timedelta(milliseconds=31 * p), v))
    return spark.createDataFrame(out, ROW).cache()


def column(df, name, sid="a", channel="X"):
    return [r[name] for r in df.where((F.col("sid") == sid) & (F.col("channel") == channel)).orderBy("pos").collect()]


@pytest.mark.parametrize("fn, name", [(S.fill_held, "filled"), (S.interpolate, "filled"), (S.differences, "step"), (S.moving_average, "smooth"), (S.median_filter, "median")])
def test_blocks_change_nothing(rows, fn, name):
    whole, blocks = column(fn(rows), name), column(fn(rows, block=16), name)
    assert whole == pytest.approx(blocks, nan_ok=True) if None not in whole else whole == blocks


def test_interpolation_is_numpys(rows):
    v = np.array([np.nan if x is None else x for x in column(rows, "value")])
    at = np.flatnonzero(~np.isnan(v))
    want = np.interp(np.arange(len(v)), at, v[at])
    want[: at[0]] = 0
    assert column(S.interpolate(rows, block=10), "filled") == pytest.approx(want)


def test_running_sum_and_medians(spark, rows):
    got = column(with_running_sum(rows, S.KEYS, "pos", F.lit(1).cast("bigint"), "n", 7), "n")
    assert got == list(range(1, 121))
    rng = np.random.default_rng(1)
    data = [(k, float(v)) for k, n in (("a", 501), ("b", 40), ("c", 1)) for v in np.round(rng.exponential(3, n), 2)] + [("a", None), ("d", 0.0)]
    got = {r.k: r["median"] for r in exact_medians(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()}
    assert got == {k: pytest.approx(np.median([v for q, v in data if q == k and v])) for k in "abc"}


def test_spectral_mean_is_parsevals(spark):
    rng = np.random.default_rng(2)
    for n in (7, 8, 25, 64):
        x = rng.normal(size=n)
        df = spark.createDataFrame([("a", 1, "X", 0, i, float(v)) for i, v in enumerate(x)], "sid string, session int, channel string, epoch bigint, index bigint, value double")
        assert E.mean_power(df).first().power == pytest.approx((np.abs(np.fft.rfft(x)) ** 2).mean())


def test_normality_matches_published_values(spark):
    df = spark.createDataFrame([("a", 1, float(v)) for v in range(20)], "sid string, session int, value double")
    r = E.normality(df).first()
    assert r.p == pytest.approx(np.exp(-r.k2 / 2)) and r.k2 == pytest.approx(1.7058104152122062**2, rel=1e-6)


def test_peaks_count_flat_tops_once(spark):
    x = [0, 1, 1, 0, 2, None, 2, 1, 3, 3]
    df = spark.createDataFrame([("a", 1, "X", 0, i, None if v is None else float(v)) for i, v in enumerate(x)], "sid string, session int, channel string, epoch bigint, pos bigint, value double")
    assert {(r.pos, r.value) for r in E.local_peaks(df).collect()} == {(1, 1.0), (4, 2.0)}
    assert {(r.pos, r.value) for r in E.local_peaks(df, block=2).collect()} == {(1, 1.0), (4, 2.0)}


def test_epochs(rows):
    assert S.count_epochs(rows, 50).agg(F.max("epoch")).first()[0] == 1
    shared = S.overlapping_epochs(rows, 50).where("sid = 'a' and channel = 'X' and pos = 50").collect()
    assert {r.epoch for r in shared} == {0, 1}
    t = S.time_epochs(rows, 1.0).where("sid = 'a' and channel = 'X'")
    assert t.agg(F.max("epoch")).first()[0] == 3
    assert S.decimate(rows, 3).where("sid = 'a' and channel = 'X'").count() == 40 and S.decimate(rows, 1) is rows


def test_constant_groups_scale_to_null(spark):
    df = spark.createDataFrame([("a", 1, "X", i, T0, 5.0) for i in range(4)], ROW)
    assert set(column(S.z_score(df), "scaled")) == {None} and set(column(S.min_max(df), "scaled")) == {None}
