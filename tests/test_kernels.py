import numpy as np
import pytest

from pulsegrid.operators import kernels as K

ROW = "sid string, session int, channel string, pos bigint, value double"


def frame(spark, x, name="s"):
    return spark.createDataFrame([(name, 1, "X", i, float(v)) for i, v in enumerate(x)], ROW)


def values(df):
    return np.array([r.value for r in df.orderBy("pos").collect()])


def gain(sos, f, rate):
    z = np.exp(-2j * np.pi * np.asarray(f) / rate)
    h = np.ones_like(z)
    for b0, b1, b2, a1, a2 in sos:
        h = h * (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return np.abs(h)


@pytest.mark.parametrize("order, low, high", [(5, None, 0.5), (4, None, 5.0), (3, 0.5, 4.0), (2, 1.0, None)])
def test_butterworth_gain_is_the_formula(order, low, high):
    rate, f = 32.0, np.array([0.1, 0.4, 0.5, 1.0, 3.0, 4.0, 7.0, 12.0])
    w = np.tan(np.pi * f / rate)
    edge = lambda x: np.tan(np.pi * x / rate)
    r = w / edge(high) if low is None else edge(low) / w if high is None else (w * w - edge(low) * edge(high)) / (w * (edge(high) - edge(low)))
    assert gain(K.butterworth(order, low, high, rate), f, rate) == pytest.approx(1 / np.sqrt(1 + r ** (2 * order)), rel=1e-6)


def test_zero_phase_filter_keeps_a_slow_wave_and_constants():
    t = np.arange(2000) / 32
    slow, sos = np.sin(2 * np.pi * 0.05 * t), K.butterworth(5, None, 0.5, 32.0)
    got, flat = K.forward_backward(sos, [slow + np.sin(2 * np.pi * 6 * t), np.full(40, 3.0)], 18)
    assert np.abs(got - slow)[400:-400].max() < 1e-3
    assert flat == pytest.approx(np.full(40, 3.0))


@pytest.mark.parametrize("order, low, high", [(5, None, 0.5), (3, 0.5, 4.0), (2, 1.0, None), (2, None, 0.0005)])
def test_convolution_equals_recursion(order, low, high):
    x = np.cumsum(np.random.default_rng(5).normal(size=(3, 900)), axis=1) + 40
    sos = K.butterworth(order, low, high, 32.0)
    assert K._run(sos, x) == pytest.approx(K.recurse(sos, x), abs=1e-8)


def test_chunks_equal_the_whole_series(spark):
    x = np.cumsum(np.random.default_rng(0).normal(size=3000))
    df = frame(spark, x)
    whole = K.forward_backward(K.butterworth(5, None, 2.0, 32.0), [x], 18)[0]
    assert values(K.low_pass(df, "value", 2.0, 32.0, chunk=500, halo=400)) == pytest.approx(whole, abs=1e-6)
    kernel = K.fir(1.0, 8.0, 32.0, 101)
    assert values(K.fir_pass(df, "value", 1.0, 8.0, 32.0, taps=101, chunk=300)) == pytest.approx(K.convolve(kernel, [x])[0], abs=1e-9)


def test_impossible_bands_leave_the_series(spark):
    df = frame(spark, [1.0, 2.0, 3.0])
    assert values(K.band_pass(df, "value", 0.5, 4.0, 8.0)).tolist() == [1, 2, 3]
    assert values(K.fir_pass(df, "value", 48.0, 52.0, 64.0, stop=True)).tolist() == [1, 2, 3]


def test_notch_takes_out_its_frequency():
    t = np.arange(4000) / 256
    y = K.convolve(K.fir(48, 52, 256.0, 513, stop=True), [np.sin(2 * np.pi * 50 * t) + np.sin(2 * np.pi * 10 * t)])[0]
    assert np.abs(y - np.sin(2 * np.pi * 10 * t))[600:-600].max() < 0.05


@pytest.mark.parametrize("low, high", [(1.0, None), (1.0, 50.0)])
def test_taps_are_enough_for_the_edges(low, high):
    h = K.fir(low, high, 256.0, K.taps_for(low, high, 256.0))
    m = np.arange(len(h)) - len(h) // 2
    gain = lambda f: abs((h * np.cos(2 * np.pi * f / 256 * m)).sum())
    assert len(h) == 847 and gain(0) < 0.01 and gain(0.4) < 0.05 and gain(1.6) > 0.95 and gain(30) == pytest.approx(1, abs=0.01)


def test_a_filter_too_slow_for_chunks_is_refused(spark):
    from pulsegrid.errors import ValidationError

    assert K.reach(K.butterworth(5, None, 0.5, 32.0)) < K.CHUNK
    with pytest.raises(ValidationError, match="decimate"):
        K.low_pass(frame(spark, [1.0, 2.0]), "value", 0.0005, 32.0)


def test_ratios_are_those_of_the_bands():
    b = K.bands(np.random.default_rng(2).normal(size=1280), 256.0)
    assert b["theta_delta"] == b["theta"] / b["delta"] and b["low_beta_alpha"] == b["low_beta"] / b["alpha"] and b["delta"] > 0
    assert K.bands(np.ones(255), 256.0) == {}


def test_wavelets_longer_than_the_epoch_give_nothing():
    w = K.morlet(np.random.default_rng(2).normal(size=512), 256.0)
    assert w["power_0"] is None and w["power_8"] > 0


def test_spaced_peaks():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 1.0])
    assert K.spaced_peaks(x).tolist() == [1, 4, 7]
    assert K.spaced_peaks(x, 3.5).tolist() == [4]
    assert K.spaced_peaks(x, 1, 2).tolist() == [4, 7]
    assert K.spaced_peaks(np.array([1.0, 2.0])).tolist() == []


def test_pulse_of_a_known_rate():
    t = np.arange(640) / 64
    p = K.pulse(100 + 20 * np.sin(2 * np.pi * 75 / 60 * t), 64.0)
    assert p["rate"] == pytest.approx(75, rel=0.02) and p["bounded_rate"] == pytest.approx(75, rel=0.02)
    assert K.pulse(np.ones(50), 64.0)["rate"] is None


def test_welch_is_parseval_and_finds_the_peak():
    t = np.arange(4096) / 256
    f, p = K.welch(np.sin(2 * np.pi * 10 * t), 256.0)
    assert f[p.argmax()] == 10 and np.trapezoid(p, f) == pytest.approx(0.5, rel=0.02)
    assert K.bands(np.sin(2 * np.pi * 10 * t), 256.0)["alpha"] == pytest.approx(0.5 * 1.375 / 1.5, rel=1e-6)  # bins 8 to 11 of a Hann peak at 10


def test_wavelet_power_peaks_at_the_frequency():
    t = np.arange(2048) / 256
    w = K.morlet(np.sin(2 * np.pi * K.MORLET_HZ[5] * t), 256.0)
    assert max(w, key=w.get) == "power_5"


@pytest.mark.parametrize("n, size", [(64, 100), (100, 64), (64, 32), (63, 40), (64, 64)])
def test_resampling_keeps_a_wave(n, size):
    k = 3
    y = K.resample(np.cos(2 * np.pi * k * np.arange(n) / n), size)
    assert y == pytest.approx(np.cos(2 * np.pi * k * np.arange(size) / size), abs=1e-9)


def test_coherence_of_the_same_and_of_unrelated_series(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=2000), rng.normal(size=2000)
    rows = [("s", 1, c, 0, i, float(v)) for c, x in (("A", a), ("B", 2 * a), ("C", b)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "sid string, session int, channel string, epoch bigint, pos bigint, value double")
    got = {(r.one, r.other): r.coherence for r in K.coherence(df, 256.0, 64).collect()}
    assert got["A", "B"] == pytest.approx(1) and got["A", "C"] < 0.1


def test_epochs_too_short_have_nulls(spark):
    df = spark.createDataFrame([("s", 1, "X", 0, i, 1.0) for i in range(5)], "sid string, session int, channel string, epoch bigint, pos bigint, value double")
    assert K.pulse_measures(df, 64.0).first().rate is None
