import datetime as dt

import numpy as np
import pytest

from pulsegrid.plans import pipelines as P
from pulsegrid.plans.spectral_queries import RATES

T0 = dt.datetime(2024, 1, 1)
BASE = 1704067200.0
ROW = "sid string, session int, channel string, pos bigint, ts timestamp_ntz, value double"


def rows(spark, modality, seconds=12):
    rate, rng = RATES[modality], np.random.default_rng(3)
    t = np.arange(int(seconds * rate)) / rate
    return spark.createDataFrame([("muses-a_" + modality.lower(), 1, c, i, T0 + dt.timedelta(microseconds=int(x * 1e6)), float(np.sin(2 * np.pi * 1.3 * x + k) + 0.1 * rng.normal())) for k, c in enumerate(P.CHANNELS[modality]) for i, x in enumerate(t)], ROW)


@pytest.mark.parametrize("modality", list(P.CHANNELS))
def test_every_modality_has_all_its_features_from_preprocessed_epochs(spark, modality):
    epochs = P.preprocess(rows(spark, modality), modality)
    got = P.modality_features(epochs, modality).collect()
    want = {(c, f) for c in P.CHANNELS[modality] for f in P.BY_CHANNEL[modality]} | set(P.OVERALL.get(modality, []))
    optional = {"filtered_variability", "robust_variability", "skew", "kurt"}
    missing = want - {(r.channel, r.feature) for r in got}
    assert {f for _, f in missing} <= optional and {(r.channel, r.feature) for r in got} <= want
    assert len({(r.epoch, r.channel, r.feature) for r in got}) == len(got)
    means = {(r.epoch, r.channel): r.value for r in got if r.feature == "mean"}
    for e in epochs.groupBy("epoch", "channel").avg("value").collect() if means else ():
        assert means[e.epoch, e.channel] == pytest.approx(e[2])


def test_readings_are_trimmed_to_the_markers(spark):
    temp = rows(spark, "TEMP")
    marks = spark.createDataFrame([(1, "k", 1, BASE + 2, 3.0), (2, "k", 1, BASE + 8, 1.5)], "row_id bigint, log_key string, session int, start_time double, duration_s double")
    rec = spark.createDataFrame([("MUSES-a_TEMP", 1, "k")], "stream_id string, session int, log_key string")
    got = sorted((r.pos, r.ts) for r in P.trimmed(temp, marks, rec).collect())
    assert [p for p, _ in got] == list(range(25)) and got[0][1] == T0 + dt.timedelta(seconds=2) and got[-1][1] == T0 + dt.timedelta(seconds=8)
    assert P.trimmed(temp, marks, rec, to_end=True).count() == 31
    assert P.trimmed(temp, marks.where("row_id > 9"), rec).count() == temp.count()
    wide = P.modality_wide(P.modality_features(P.preprocess(temp, "TEMP"), "TEMP"), "TEMP", rec)
    assert wide.columns == ["sid", "session", "epoch", "temp_min", "temp_mean", "temp_max", "temp_std", "temp_rate", "user_id"] and wide.count() == 3
