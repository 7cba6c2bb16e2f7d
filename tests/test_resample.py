import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import kernels as K
from pulsegrid.operators import series as S
from pulsegrid.plans import spectral_queries as Q
from pulsegrid.plans.series_queries import signal

ROW = "sid string, session int, channel string, pos bigint, value double"


def frame(spark, x, skip=()):
    return spark.createDataFrame([("s", 1, "X", i, float(v)) for i, v in enumerate(x) if i not in skip], ROW)


def values(df):
    return np.array([r.value for r in df.orderBy("pos").collect()])


def test_a_whole_series_is_resampled_with_its_tail(spark):
    wave = lambda t: np.sin(2 * np.pi * 10 * t) + 0.5 * np.cos(2 * np.pi * 40 * t + 1)
    got = values(K.resample_series(frame(spark, wave(np.arange(3000) / 256)), "value", 25, 32))
    assert len(got) == 2344
    assert np.abs(got - wave(np.arange(2344) / 200))[450:-450].max() < 1e-3


def test_chunks_do_not_change_the_result_and_gaps_are_bridged(spark):
    x = np.random.default_rng(2).normal(size=2500)
    whole = values(K.resample_series(frame(spark, x), "value", 25, 32))
    assert values(K.resample_series(frame(spark, x), "value", 25, 32, chunk=600, halo=600)) == pytest.approx(whole, abs=1e-9)
    assert len(values(K.resample_series(frame(spark, x, {700}), "value", 25, 32))) == len(whole)
    assert values(K.resample_series(frame(spark, [5.0] * 50), "value", 25, 32)) == pytest.approx([5.0] * 39)


def test_queries_keep_the_tails_of_series(spark, data):
    n = {(r.sid, r.session, r.channel): r.n for r in signal(spark, data, "EEG").groupBy(*S.KEYS).agg((F.max("pos") + 1).alias("n")).collect()}
    got = {(r.sid, r.session, r.channel): r.n for r in Q.resampled(spark, data).groupBy(*S.KEYS).agg(F.count("*").alias("n")).collect()}
    assert set(got) == set(n)
    last = {(r.sid, r.session, r.channel): r.e for r in Q.band_powers(spark, data).groupBy(*S.KEYS).agg(F.max("epoch").alias("e")).collect()}
    assert last == {k: (v - 1) // Q.EEG_EPOCH for k, v in n.items()}
