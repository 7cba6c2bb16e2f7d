"""Queries that need NumPy on chunks and epochs: filters, pulse, spectra, coherence. Their SQL is a sum of products, or a
recursion, over whole series; tests hold the rest against whole-series brute force."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pulsegrid.functions.columns import stable
from pulsegrid.operators import kernels as K
from pulsegrid.operators import series as S
from pulsegrid.plans.series_queries import _r, _sig, signal

#: Sampling rates in Hz of the recordings. Fixed values.
RATES = {"EEG": 256.0, "PPG": 64.0, "BVP": 64.0, "ACC": 32.0, "GYRO": 32.0, "GSR": 4.0, "TEMP": 4.0}
#: Readings of an epoch of the EEG, five seconds.
EEG_EPOCH = 1280


def _filled(spark, folder, modality):
    return S.interpolate(signal(spark, folder, modality))


def _epochs(spark, folder, modality, size):
    """Epochs by count, the last one of a series as short as it is."""
    rows = _filled(spark, folder, modality).withColumn("value", F.col("filled"))
    return rows.withColumn("epoch", F.floor(F.col("pos") / size))


def _value(df, digits=4):
    return df.withColumn("value", stable(F.col("value"), digits))


def _rounded(df, digits=4):
    return df.withColumns({c: stable(F.col(c), digits) for c, t in df.dtypes if t == "double"})


def low_passed(spark, folder):
    return _value(K.low_pass(_filled(spark, folder, "ACC"), "filled", 0.5, RATES["ACC"]))


def pulse_band(spark, folder):
    return _value(K.band_pass(_filled(spark, folder, "BVP"), "filled", 0.5, 4.0, RATES["BVP"]))


def ppg_band(spark, folder):
    return _value(K.band_pass(_filled(spark, folder, "PPG"), "filled", 0.5, 4.0, RATES["PPG"]))


def skin_low_passed(spark, folder):
    return _value(K.low_pass(_filled(spark, folder, "GSR"), "filled", 1.0, RATES["GSR"]))


def eeg_band(spark, folder):
    return _value(K.fir_pass(_filled(spark, folder, "EEG"), "filled", 1.0, 50.0, RATES["EEG"]))


def eeg_notch(spark, folder):
    return _value(K.fir_pass(_filled(spark, folder, "EEG"), "filled", 48.0, 52.0, RATES["EEG"], stop=True))


def eeg_high_passed(spark, folder):
    return _value(K.fir_pass(_filled(spark, folder, "EEG"), "filled", 1.0, None, RATES["EEG"]))


def pulse_measures(spark, folder):
    """Heart rate and variability of epochs of five seconds."""
    return K.pulse_measures(_epochs(spark, folder, "BVP", 320), RATES["BVP"])


def ppg_pulse_measures(spark, folder):
    return K.pulse_measures(_epochs(spark, folder, "PPG", 320), RATES["PPG"])


def band_powers(spark, folder):
    """Spectra of epochs of five seconds; the last one of a recording is as short as it is, null below one second."""
    return _rounded(K.band_powers(_epochs(spark, folder, "EEG", EEG_EPOCH), RATES["EEG"]))


def eeg_coherence(spark, folder):
    return _rounded(K.coherence(_epochs(spark, folder, "EEG", EEG_EPOCH), RATES["EEG"]))


def _sized_morlet(x, rate):
    return K.morlet(x, rate) | {"n": float(len(x))}


def wavelet_powers(spark, folder):
    """Power by frequency, averaged over the epochs of a recording by the readings of those in which the wavelet fits."""
    w = K.measure_epochs(_epochs(spark, folder, "EEG", EEG_EPOCH), _sized_morlet, [*K.WAVELETS, "n"], RATES["EEG"])
    return _rounded(w.groupBy("sid", "session", "channel").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))).alias(c) for c in K.WAVELETS]))


def resampled(spark, folder):
    """EEG at 200 Hz instead of 256, over whole recordings; the epoch counts 100 new instants, half a second."""
    return K.resample_series(_filled(spark, folder, "EEG"), "filled", 25, 32).select(*S.KEYS, F.floor(F.col("pos") / 100).alias("epoch"), "pos", "value")


QUERIES = {f.__name__: f for f in (low_passed, pulse_band, ppg_band, skin_low_passed, eeg_band, eeg_notch, eeg_high_passed, pulse_measures, ppg_pulse_measures, band_powers, eeg_coherence, wavelet_powers, resampled)}

_KEY = "sid, session, channel"


def _series(modality: str, epoch: int | None = None) -> str:
    """SQL of the interpolated series of a modality, as lists in order of pos: (sid, session, channel[, epoch], l)."""
    over = f"partition by {_KEY} order by pos"
    back, ahead = f"over ({over} rows unbounded preceding)", f"over ({over} rows between current row and unbounded following)"
    keys = _KEY if epoch is None else f"{_KEY}, pos // {epoch} as epoch"
    return f"""{_sig(modality)},
nb as (select *, last_value(value ignore nulls) {back} as v0, last_value(case when value is not null then pos end ignore nulls) {back} as p0, first_value(value ignore nulls) {ahead} as v1, first_value(case when value is not null then pos end ignore nulls) {ahead} as p1 from sig),
fl as (select {_KEY}, pos, case when value is not null then value when p0 is null then 0 when p1 is null then v0 else v0 + (v1 - v0) * ((pos - p0) / (p1 - p0)) end as x from nb),
ls as (select {keys}, list(x order by pos) as l, list(pos order by pos) as ats from fl group by all)"""


def _fir_sql(low: float | None, high: float | None, rate: float, transition: float, stop: bool = False) -> str:
    """SQL of a windowed-sinc filter: a sum of products of 2 k + 1 readings with the taps, the ends held."""
    k = math.ceil(3.3 * rate / transition / 2)
    sinc = lambda f: f"case when m = 0 then {2 * f / rate!r} else sin(pi() * m * {2 * f / rate!r}) / (pi() * m) end"
    taps = f"(({sinc(high) if high else 'case when m = 0 then 1 else 0 end'}) - ({sinc(low)})) * (0.54 + 0.46 * cos(pi() * m / {k}))"
    taps = f"case when m = 0 then 1 else 0 end - {taps}" if stop else taps
    return f"""with {_series('EEG')},
h as (select list(cast({taps} as double) order by m) as h from range(-{k}, {k + 1}) t(m)),
p as (select *, list_concat(list_resize([]::double[], {k}, l[1]), l, list_resize([]::double[], {k}, l[-1])) as padded from ls),
y as (select {_KEY}, unnest(ats) as pos, unnest(list_transform(range(1, len(l) + 1), lambda i: list_inner_product(list_slice(padded, i, i + {2 * k}), h))) as y from p, h)
select {_KEY}, pos, {_r('y', 4)} as value from y"""


def _sections_sql(modality: str, order: int, low: float | None, high: float, rate: float, pad: int) -> str:
    """SQL of a recursive filter run forward and backward, a step of a recursion a reading, the ends extended oddly."""
    sos = K.butterworth(order, low, high, rate).tolist()
    level, steady = 1.0, []
    for b0, b1, b2, a1, a2 in sos:
        y = level * (b0 + b1 + b2) / (1 + a1 + a2)
        steady.append((y - b0 * level, b2 * level - a2 * y))
        level = y
    state = [f"{z}{i}" for i in range(len(sos)) for z in "pq"]
    first = ", ".join(f"{v!r} * e[1] as {n}" for n, v in zip(state, [v for two in steady for v in two]))

    def run(name: str, source: str) -> str:
        steps, x = [], "e[i + 1]"
        for i, (b0, b1, b2, a1, a2) in enumerate(sos):
            steps += [f"{b0!r} * ({x}) + p{i} as y{i}", f"{b1!r} * ({x}) - {a1!r} * y{i} + q{i} as np{i}", f"{b2!r} * ({x}) - {a2!r} * y{i} as nq{i}"]
            x = f"y{i}"
        new = ", ".join(f"n{n} as {n}" for n in state)
        return f"""{name}_run as (select {_KEY}, cast(0 as bigint) as i, 0.0::double as y, {first} from {source}
  union all select {_KEY}, i + 1, {x}, {new} from (select {_KEY}, i, {', '.join(steps)} from {name}_run join {source} using ({_KEY}) where i < len(e))),
{name} as materialized (select {_KEY}, list(y order by i) as o from {name}_run where i > 0 group by all)"""

    return f"""with recursive {_series(modality)},
ext as materialized (select {_KEY}, ats, least({pad}, len(l) - 1) as k, list_concat(list_transform(list_reverse(list_slice(l, 2, k + 1)), lambda v: 2 * l[1] - v), l, list_transform(list_slice(list_reverse(l), 2, k + 1), lambda v: 2 * l[-1] - v)) as e from ls),
{run('ahead', 'ext')},
turned as materialized (select {_KEY}, list_reverse(o) as e from ahead),
{run('back', 'turned')},
y as (select {_KEY}, unnest(ats) as pos, unnest(list_slice(list_reverse(o), k + 1, k + len(ats))) as y from back join ext using ({_KEY}))
select {_KEY}, pos, {_r('y', 4)} as value from y"""


#: Segments of 256 readings, half overlapping, their mean taken off, under a Hann window, and their sums with each frequency.
_SPECTRA = f"""with {_series('EEG', EEG_EPOCH)},
sg as (select sid, session, channel, epoch, s, list_slice(l, s * 128 + 1, s * 128 + 256) as w from (select *, unnest(range(0, (len(l) - 256) // 128 + 1)) as s from ls where len(l) >= 256)),
wn as (select sid, session, channel, epoch, s, list_transform(w, lambda v, i: (v - list_avg(w)) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 256))) as w from sg),
tr as materialized (select k, list(cos(2 * pi() * k * j / 256) order by j) as c, list(sin(2 * pi() * k * j / 256) order by j) as n from range(0, 129) a(k), range(0, 256) b(j) group by k),
ft as materialized (select sid, session, channel, epoch, s, k, list_inner_product(w, c) as re, list_inner_product(w, n) as im from wn, tr)"""
_BAND = lambda a, z: f"sum(case when k >= {a} and k < {z - 1} then (p + after) / 2 end)"


def _wavelets_sql() -> str:
    parts = []
    for i, f in enumerate(K.MORLET_HZ.tolist()):
        sigma = max(3.0, f / 2) / (2 * math.pi * f)
        n = math.ceil((10 * sigma + 1 / 256) * 256 - 1e-9)
        t = f"(j / 256.0 - {5 * sigma!r})"
        parts.append(f"select {i} as i, j, cos(2 * pi() * {f!r} * {t}) * exp(-{t} * {t} / {2 * sigma * sigma!r}) as re, sin(2 * pi() * {f!r} * {t}) * exp(-{t} * {t} / {2 * sigma * sigma!r}) as im from range(0, {n}) r(j)")
    names = ", ".join(f"{_r(f'max(case when i = {i} then power end)', 4)} as power_{i}" for i in range(len(parts)))
    return f"""with {_series('EEG', EEG_EPOCH)}, wv as ({' union all '.join(parts)}),
ww as materialized (select i, count(*) as n, list(re order by j desc) as re, list(im order by j desc) as im, sqrt(0.5 * sum(re * re + im * im)) as norm from wv group by i),
pd as (select sid, session, channel, epoch, len(l) as size, ww.*, list_concat(list_resize([]::double[], n - 1 - (n - 1) // 2, 0.0), l, list_resize([]::double[], (n - 1) // 2, 0.0)) as x from ls, ww where len(l) >= 8 and n <= len(l)),
pw as (select sid, session, channel, i, size, list_avg(list_transform(range(1, size + 1), lambda a: (power(list_inner_product(list_slice(x, a, a + n - 1), re), 2) + power(list_inner_product(list_slice(x, a, a + n - 1), im), 2)) / (norm * norm))) as p from pd),
av as (select sid, session, channel, i, sum(p * size) / sum(size) as power from pw group by all)
select k.sid, k.session, k.channel, {names} from (select distinct sid, session, channel from ls) k left join av using (sid, session, channel) group by all"""


SQL = {
    "low_passed": _sections_sql("ACC", 5, None, 0.5, 32.0, 18),
    "pulse_band": _sections_sql("BVP", 3, 0.5, 4.0, 64.0, 21),
    "ppg_band": _sections_sql("PPG", 3, 0.5, 4.0, 64.0, 21),
    "skin_low_passed": _sections_sql("GSR", 5, None, 1.0, 4.0, 18),
    "eeg_band": _fir_sql(1.0, 50.0, 256.0, 1.0),
    "eeg_notch": _fir_sql(48.0, 52.0, 256.0, 1.0, stop=True),
    "eeg_high_passed": _fir_sql(1.0, None, 256.0, 1.0),
    "band_powers": f"""{_SPECTRA}, sp as (select sid, session, channel, epoch, k, avg((re * re + im * im) / (256 * 96.0) * case when k in (0, 128) then 1 else 2 end) as p from ft group by all),
nx as (select *, lead(p) over w as after, sum(p) over (partition by sid, session, channel, epoch) as total from sp window w as (partition by sid, session, channel, epoch order by k)),
b as (select sid, session, channel, epoch, {_BAND(1, 4)} as delta, {_BAND(4, 8)} as theta, {_BAND(8, 12)} as alpha, {_BAND(12, 15)} as low_beta, {_BAND(15, 30)} as high_beta, -sum(case when p > 0 then p / total * log2(p / total) else 0 end) as spectral_entropy, max(p) as psd_max, avg(p) as psd_mean, median(p) as psd_median from nx group by all)
select ls.sid, ls.session, ls.channel, ls.epoch, {', '.join(f"{_r(n, 4)} as {n}" for n in K.BANDS)}, {', '.join(f"{_r(f'{a} / nullif({z}, 0)', 4)} as {a}_{z}" for a, z in K.RATIOS)}, {', '.join(f"{_r(n, 4)} as {n}" for n in ('spectral_entropy', 'psd_max', 'psd_mean', 'psd_median'))} from ls left join b using (sid, session, channel, epoch)""",
    "eeg_coherence": f"""{_SPECTRA}, cr as (select a.sid, a.session, a.epoch, a.channel as one, b.channel as other, a.k, count(*) as segments, avg(a.re * b.re + a.im * b.im) as re, avg(a.re * b.im - a.im * b.re) as im, avg(a.re * a.re + a.im * a.im) as xx, avg(b.re * b.re + b.im * b.im) as yy from ft a join ft b on a.sid = b.sid and a.session = b.session and a.epoch = b.epoch and a.s = b.s and a.k = b.k and a.channel < b.channel group by all)
select sid, session, epoch, one, other, {_r('avg((re * re + im * im) / (xx * yy)) filter (xx * yy > 0)', 4)} as coherence from cr where segments >= 2 group by all""",
    "wavelet_powers": _wavelets_sql(),
}
