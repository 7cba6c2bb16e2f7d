import numpy as np
import pytest

from pulsegrid.operators.spikes import LIMIT, PLAUSIBLE, RISK, cutoff_report, excursions, flag_readings, judge_readings, plausible_readings, run_lengths, seasons, tail_model

READ = "stream_id string, session int, channel string, pos bigint, value double, score string, block string, unit string"


def brute(x, lo, hi):
    """Positions of impossible, stuck and spiking readings, straight from the definition."""
    x = np.array(x, float)
    n, bad = len(x), (np.array(x) < lo) | (np.array(x) > hi)
    out = {i for i in range(n) if bad[i]}
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:
            j += 1
        if j - i >= 12:
            out |= set(range(i, j))
        i = j
    ok = np.flatnonzero(~bad)
    c = x[ok]
    steps = np.abs(np.diff(c))
    steps = steps[steps > 0]
    if len(steps):
        m = 10 * np.median(steps)
        for g in (1, 2, 3):
            for s in range(1, len(c) - g):
                grp, b, a = c[s : s + g], c[s - 1], c[s + g]
                if all(v - b > m and v - a > m for v in grp) or all(b - v > m and a - v > m for v in grp):
                    out |= {int(ok[k]) for k in range(s, s + g)}
    return out


def series(seed, n=400):
    rng = np.random.default_rng(seed)
    x = np.round(np.cumsum(rng.normal(0, 0.05, n)) + 30, 2)
    for p in rng.integers(5, n - 5, 8):
        x[p : p + rng.integers(1, 5)] += rng.choice([-3, 3])
    x[100:118] = x[100]
    x[200:203] = -999
    x[300] = 99
    return x


def rows(x, stream="s_TEMP", channel="TEMP", session=1):
    return [(stream, session, channel, i, float(v), "clash", "clash", "clash") for i, v in enumerate(x)]


def found(df):
    return {(r.sid, r.pos) for r in df.where("impossible or stuck or spike").collect()}


@pytest.mark.parametrize("block", [8192, 64, 7])
def test_equals_the_definition_whatever_the_blocks(spark, block):
    data = {f"s{k}_temp": series(k) for k in range(4)}
    df = spark.createDataFrame([r for s, x in data.items() for r in rows(x, s.upper())], READ)
    want = {(s, i) for s, x in data.items() for i in brute(x, *PLAUSIBLE["TEMP"])}
    assert found(flag_readings(df, block=block)) == want


def test_nulls_repeats_and_other_channels(spark):
    x = series(9)
    extra = [("s_TEMP", 1, "TEMP", 50, float("nan"), "", "", ""), ("s_TEMP", 1, "TEMP", 1000, None, "", "", ""), ("s_TEMP", 1, "TEMP", None, 99.0, "", "", ""), ("s_TEMP", 1, "Z", 3, 1e9, "", "", ""), (" S_temp", 1, "TEMP", 10, float(x[10]), "", "", "")]
    df = spark.createDataFrame(rows(x) + extra + rows(x)[:20], READ)
    assert found(flag_readings(df)) == {("s_temp", i) for i in brute(x, *PLAUSIBLE["TEMP"])}


def test_short_constant_and_empty_sources(spark):
    df = spark.createDataFrame(rows([20.0, 20.0], "a") + rows([99.0], "b") + rows([21.0] * 12, "c"), READ)
    assert found(flag_readings(df)) == {("b", 0)} | {("c", i) for i in range(12)}
    assert flag_readings(spark.createDataFrame([], READ)).count() == 0


def test_candidates_are_beyond_the_cutoff(spark):
    df = spark.createDataFrame(rows(series(3, 3000)), READ)
    out = flag_readings(df).where("spike").collect()
    assert out and all(0 < r.cutoff < r.score and r.rise > LIMIT * r.unit for r in out)


def test_the_tail_fit_keeps_the_risk(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(0, 5, 20_000)
    x[::400] += 600  # a few outliers must not move the cutoff
    judged = judge_readings(spark.createDataFrame([("s", 1, "AF7", i, float(v), "", "", "") for i, v in enumerate(x)], READ))
    m = tail_model(judged).first()
    beyond = judged.where(f"score > {m.cutoff}").count()
    assert 1800 < m.peaks <= 2000 and m.cutoff > m.u and beyond / 20_000 == pytest.approx(RISK, rel=0.25)


def test_a_source_with_many_outliers_sets_a_high_cutoff(spark):
    """The cutoff decides: where outliers are common, those near the ordinary ones are no candidates, spikes by the definition or not."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 6000)
    x[5::9] += rng.choice([14.0, 60.0], len(x[5::9]))
    df = spark.createDataFrame([("s", 1, "AF7", i, float(v), "", "", "") for i, v in enumerate(x)], READ)
    r = cutoff_report(df).first()
    assert r.cutoff > LIMIT and r.missed > 0 and r.spikes > 0 and r.candidates >= r.spikes
    assert flag_readings(df).where("spike").count() == r.spikes


def test_the_season_is_taken_off(spark):
    rng = np.random.default_rng(7)
    wave = 40 * np.sin(2 * np.pi * np.arange(900) / 16 + 1)
    x = wave + rng.normal(0, 0.5, 900)
    df = spark.createDataFrame([("s", 1, "BVP", i, float(v), "", "", "") for i, v in enumerate(x)], READ)
    s = seasons(plausible_readings(df)).first()
    assert s.period == 16 and np.hypot(s.c, s.s) == pytest.approx(40, abs=0.5)
    tops = judge_readings(df).agg({"score": "max", "rise": "max"}).first()
    assert tops["max(score)"] < 4 < tops["max(rise)"]


def test_helpers():
    assert run_lengths(np.array([1, 1, 2, 1.0])).tolist() == [2, 2, 1, 1]
    assert excursions(np.array([0, 5, 4, 0, 0.0])).tolist() == [0, 4, 4, 0, 0]
