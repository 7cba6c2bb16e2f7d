"""Filters and spectra that have no SQL form: NumPy on bounded groups that Spark partitions and sorts.

Filters work on chunks of a series with a halo on either side, so a series of any length is spread over tasks.
Spectra and pulse measures work on epochs, whose length is bounded by definition.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.errors import ValidationError
from pulsegrid.functions.blocks import numbers, sorted_groups
from pulsegrid.functions.ordered import with_halo
from pulsegrid.operators.series import KEYS

CHUNK, HALO = 4096, 1024
#: Steps that an impulse response may take; a slower filter needs a series of a lower rate.
LONGEST = 16_384
#: Readings of one segment of a spectrum.
SEGMENT = 256
#: Frequency bands of the EEG in Hz. Fixed values.
BANDS = {
    "delta": (1, 4),
    "theta": (4, 8),
    "alpha": (8, 12),
    "low_beta": (12, 15),
    "high_beta": (15, 30),
}
#: Ratios of band powers. Fixed values.
RATIOS = [("theta", "delta"), ("alpha", "delta"), ("low_beta", "delta"), ("alpha", "theta"), ("low_beta", "theta"), ("low_beta", "alpha")]
#: Frequencies of the time-frequency power, evenly spaced in their logarithm from 1 to 35 Hz.
MORLET_HZ = np.logspace(0, np.log10(35), 9)


def butterworth(order: int, low: float | None, high: float | None, rate: float) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a Butterworth low-, high- or band-pass by the bilinear transform."""
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    if low is None:
        w = warp(high)
        p, z, gain = poles * w, np.zeros(0), w**order
    elif high is None:
        w = warp(low)
        p, z, gain = w / poles, np.zeros(order), 1.0
    else:
        w1, w2 = warp(low), warp(high)
        s, w0 = poles * (w2 - w1) / 2, np.sqrt(w1 * w2)
        root = np.sqrt(s * s - w0 * w0 + 0j)
        p, z, gain = np.concatenate([s + root, s - root]), np.zeros(order), (w2 - w1) ** order
    fs2 = 2 * rate
    pd = (fs2 + p) / (fs2 - p)
    zd = np.concatenate([(fs2 + z) / (fs2 - z), -np.ones(len(p) - len(z))])
    gain = gain * np.real(np.prod(fs2 - z) / np.prod(fs2 - p))
    real = np.sort(pd[np.abs(pd.imag) < 1e-12].real)
    upper = pd[pd.imag >= 1e-12]
    pairs = [(q, np.conj(q)) for q in upper[np.argsort(np.abs(upper))]] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    zs = list(np.sort(zd.real))
    sections = []
    for i, q in enumerate(pairs):
        zz = [zs.pop(0 if j % 2 == 0 else -1) for j in range(min(len(q), len(zs)))]
        b, a = np.real(np.poly(zz)), np.real(np.poly(q))
        b, a = np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))
        sections.append(np.concatenate([b * (gain if i == 0 else 1.0), a[1:]]))
    return np.array(sections)


def _steady(sos: np.ndarray) -> np.ndarray:
    """State of each section for a constant input of 1."""
    out, level = np.zeros((len(sos), 2)), 1.0
    for i, (b0, b1, b2, a1, a2) in enumerate(sos):
        y = level * (b0 + b1 + b2) / (1 + a1 + a2)
        out[i] = [y - b0 * level, b2 * level - a2 * y]
        level = y
    return out


def recurse(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filters the rows of x at once, one step in time after the other, from the steady state of each row's first value."""
    state = _steady(sos)[:, :, None] * x[None, None, :, 0]
    y = np.empty_like(x)
    for t in range(x.shape[1]):
        v = x[:, t]
        for s, (b0, b1, b2, a1, a2) in zip(state, sos):
            w = b0 * v + s[0]
            s[0] = b1 * v - a1 * w + s[1]
            s[1] = b2 * v - a2 * w
            v = w
        y[:, t] = v
    return y


@lru_cache(maxsize=16)
def _response(sos: bytes) -> np.ndarray | None:
    """Impulse response of sections down to 1e-13 of its peak, or None if that takes more than LONGEST steps."""
    x = np.zeros((1, LONGEST))
    x[0, 1] = 1.0
    h = recurse(np.frombuffer(sos).reshape(-1, 5), x)[0, 1:]
    last = int(np.flatnonzero(np.abs(h) > 1e-13 * np.abs(h).max())[-1]) + 1
    return h[:last] if last < LONGEST - 2 else None


def _run(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same as `recurse`, as a convolution by FFT with the filter's own response where that dies out."""
    h = _response(np.ascontiguousarray(sos).tobytes())
    if h is None:
        return recurse(sos, x)
    lead = len(h)
    n = lead + x.shape[1] + len(h) - 1
    size = 1 << (n - 1).bit_length()
    past = np.repeat(x[:, :1], lead, axis=1)
    y = np.fft.irfft(np.fft.rfft(np.concatenate([past, x], axis=1), size, axis=1) * np.fft.rfft(h, size), size, axis=1)
    return y[:, lead : lead + x.shape[1]]


def reach(sos: np.ndarray, rest: float = 1e-9) -> int:
    """Steps after which no more than `rest` of a filter's response is left; raises if that takes more than LONGEST."""
    h = _response(np.ascontiguousarray(sos).tobytes())
    if h is None:
        raise ValidationError(f"the response of the filter takes more than {LONGEST} steps: decimate the series first")
    return int(np.flatnonzero(np.abs(h) > rest * np.abs(h).max())[-1]) + 1


def forward_backward(sos: np.ndarray, series: list[np.ndarray], pad: int) -> list[np.ndarray]:
    """Zero-phase filtering of series of any lengths, each extended oddly by up to `pad` values at its ends."""
    out: list[np.ndarray] = [np.zeros(0)] * len(series)
    longest = max(map(len, series), default=0)
    if not longest:
        return out
    n = np.array([len(s) for s in series])
    p = np.minimum(pad, np.maximum(n - 1, 0))
    total = n + 2 * p
    x = np.zeros((len(series), int(total.max())))
    for i, s in enumerate(series):
        if len(s):
            k = p[i]
            x[i, : total[i]] = np.concatenate([2 * s[0] - s[k:0:-1], s, 2 * s[-1] - s[-2 : -k - 2 : -1]])
            x[i, total[i] :] = x[i, total[i] - 1]
    back = np.arange(x.shape[1])[None, :]
    flip = np.clip(total[:, None] - 1 - back, 0, None)
    y = np.take_along_axis(_run(sos, x), flip, 1)
    y = np.take_along_axis(_run(sos, y), flip, 1)
    return [y[i, p[i] : p[i] + n[i]] for i in range(len(series))]


def taps_for(low: float | None, high: float | None, rate: float, stop: bool = False) -> int:
    """Taps of a Hamming-windowed filter as steep as its edges ask for: a pass band is left within a quarter of the edge,
    at least 2 Hz but not beyond 0 or half the rate, a stop band within 1 Hz. Odd; 3.3 times the rate over that width."""
    widths = [1.0] if stop else []
    if low is not None and not stop:
        widths.append(min(max(low / 4, 2.0), low))
    if high is not None and not stop:
        widths.append(min(max(high / 4, 2.0), rate / 2 - high))
    return 2 * int(np.ceil(3.3 * rate / min(widths) / 2)) + 1


def fir(low: float | None, high: float | None, rate: float, taps: int = 257, stop: bool = False) -> np.ndarray:
    """Symmetric windowed-sinc filter (Hamming) that passes low to high Hz, or stops them."""
    m = np.arange(taps) - taps // 2
    sinc = lambda f: 2 * f / rate * np.sinc(2 * f / rate * m)
    h = (sinc(high) if high else (m == 0).astype(float)) - (sinc(low) if low else 0)
    h = h * np.hamming(taps)
    if low is None:
        h = h / h.sum()
    return (m == 0).astype(float) - h if stop else h


def convolve(kernel: np.ndarray, series: list[np.ndarray]) -> list[np.ndarray]:
    """Centred convolution; beyond the ends the first and last value go on."""
    k = len(kernel) // 2
    return [np.convolve(np.pad(s, k, mode="edge"), kernel, "valid") if len(s) else s for s in series]


def _filter_chunks(t: pa.Table, starts: np.ndarray, fn: Callable[[list[np.ndarray]], list[np.ndarray]]) -> pa.Table:
    x = numbers(t, "x", 0.0)
    parts = fn(np.split(x, starts[1:]))
    out = t.select([*KEYS, "pos"]).append_column("value", pa.array(np.concatenate(parts)))
    return out.filter(t["_home"])


def filter_series(rows: DataFrame, value: str, fn: Callable[[list[np.ndarray]], list[np.ndarray]], chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """Applies a filter along each series: (sid, session, channel, pos, value). `value` has no gaps (see interpolate).

    Chunks get `halo` positions of their neighbours: exact for filters no longer than that, and for recursive ones
    exact up to what is left of their response after `halo` steps."""
    x = rows.select(*KEYS, "pos", rows[value].alias("x"))
    h = with_halo(x, KEYS, "pos", before=halo, after=halo, block=chunk)
    return sorted_groups(h, [*KEYS, "_b"], ["pos"], partial(_filter_chunks, fn=fn), "sid string, session int, channel string, pos bigint, value double")


def _recursive(rows: DataFrame, value: str, sos: np.ndarray, pad: int, chunk: int, halo: int | None) -> DataFrame:
    halo = reach(sos) + pad if halo is None else halo
    return filter_series(rows, value, partial(forward_backward, sos, pad=pad), max(chunk, halo), halo)


def low_pass(rows: DataFrame, value: str, cutoff: float, rate: float, order: int = 5, chunk: int = CHUNK, halo: int | None = None) -> DataFrame:
    """Zero-phase Butterworth low-pass. A cutoff that is not between 0 and half the rate leaves the series as it is."""
    if not 0 < cutoff < rate / 2:
        return rows.select(*KEYS, "pos", rows[value].alias("value"))
    return _recursive(rows, value, butterworth(order, None, cutoff, rate), 3 * (order + 1), chunk, halo)


def band_pass(rows: DataFrame, value: str, low: float, high: float, rate: float, order: int = 3, chunk: int = CHUNK, halo: int | None = None) -> DataFrame:
    """Zero-phase Butterworth band-pass; a band that is not within 0 to half the rate leaves the series as it is."""
    if not 0 < low < high < rate / 2:
        return rows.select(*KEYS, "pos", rows[value].alias("value"))
    return _recursive(rows, value, butterworth(order, low, high, rate), 3 * (2 * order + 1), chunk, halo)


def fir_pass(rows: DataFrame, value: str, low: float | None, high: float | None, rate: float, stop: bool = False, taps: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Linear-phase band-pass, high-pass (high None), low-pass (low None) or notch (stop); edges beyond half the rate leave
    the series as it is. The taps follow from the edges, see taps_for."""
    if max(low or 0, high or 0) >= rate / 2:
        return rows.select(*KEYS, "pos", rows[value].alias("value"))
    taps = taps or taps_for(low, high, rate, stop)
    return filter_series(rows, value, partial(convolve, fir(low, high, rate, taps, stop)), max(chunk, taps), taps // 2)


def spaced_peaks(x: np.ndarray, distance: float = 1, height: float | None = None) -> np.ndarray:
    """Positions of local maxima (middle of a flat top) at least `height` high; of two closer than `distance` the higher stays."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    edge = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    v, last = x[edge], np.append(edge[1:], len(x)) - 1
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    p = (edge[top] + last[top]) // 2
    if height is not None:
        p = p[x[p] >= height]
    d = int(np.ceil(distance))
    keep = np.ones(len(p), bool)
    first, after = np.searchsorted(p, p - d, "right"), np.searchsorted(p, p + d)  # the peaks closer than d are a slice
    for i in np.argsort(x[p], kind="stable")[::-1]:
        if keep[i]:
            keep[first[i] : after[i]] = False
            keep[i] = True
    return p[keep]


def pulse(x: np.ndarray, rate: float) -> dict[str, float | None]:
    """Heart rate and variability of an epoch from the distances of its peaks; None where there are too few."""
    out: dict[str, float | None] = dict.fromkeys(("rate", "variability", "bounded_rate", "filtered_variability", "robust_variability"))
    rr = np.diff(spaced_peaks(x, rate / 2)) / rate
    if len(rr):
        out["rate"], out["variability"] = float(60 / rr.mean()), float(rr.std())
    hr = 60 / (np.diff(spaced_peaks(x, max(1, int(rate / 3)))) / rate)
    hr = hr[(hr > 40) & (hr < 180)]
    if len(hr):
        out["bounded_rate"] = float(hr.mean())
    smooth = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, 2), 5), axis=1)
    rr = np.diff(spaced_peaks(smooth, max(1, int(rate / 3)))) / rate
    rr = rr[(60 / rr > 40) & (60 / rr < 180)] if len(rr) else rr
    if len(rr) > 1:
        out["filtered_variability"] = float(rr.std())
    rr = np.diff(spaced_peaks(x, rate / 2, float(x.mean()))) / rate
    if len(rr):
        mid = np.median(rr)
        rr = rr[np.abs(rr - mid) < 2 * np.median(np.abs(rr - mid))]
        if len(rr) > 1:
            out["robust_variability"] = float(rr.std())
    return out


def welch(x: np.ndarray, rate: float, y: np.ndarray | None = None, segment: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power density of x, or cross density with y: Hann segments, half overlapping, mean removed."""
    n = min(segment, len(x))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(n)
    step = n - n // 2

    def spectra(s: np.ndarray) -> np.ndarray:
        parts = np.lib.stride_tricks.sliding_window_view(s, n)[::step]
        return np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * w, axis=1)

    a = spectra(x)
    p = (np.conj(a) * (a if y is None else spectra(y))).mean(axis=0) / (rate * (w * w).sum())
    p[1 : len(p) - (n % 2 == 0)] *= 2
    return np.fft.rfftfreq(n, 1 / rate), p.real if y is None else p


def bands(x: np.ndarray, rate: float, segment: int = SEGMENT) -> dict[str, float | None]:
    """Band powers by the trapezoid rule, their ratios, spectral entropy and summary of the power density; nothing for
    less than one segment, whose bins would be wider than the bands."""
    if len(x) < segment:
        return {}
    f, p = welch(x, rate, segment=segment)
    out: dict[str, float | None] = {}
    for name, (a, z) in BANDS.items():
        k = (f >= a) & (f < z)
        out[name] = float(np.trapezoid(p[k], f[k])) if k.sum() > 1 else None
    for a, z in RATIOS:
        out[f"{a}_{z}"] = out[a] / out[z] if out[a] is not None and out[z] else None
    q = p / p.sum() if p.sum() > 0 else p
    out["spectral_entropy"] = float(-(q[q > 0] * np.log2(q[q > 0])).sum())
    return out | {"psd_max": float(p.max()), "psd_mean": float(p.mean()), "psd_median": float(np.median(p))}


def morlet(x: np.ndarray, rate: float) -> dict[str, float | None]:
    """Mean power of an epoch at each of MORLET_HZ, by complex wavelets of max(3, f / 2) cycles; None where the wavelet is
    longer than the epoch, as the power would be that of its edges."""
    out = {}
    for i, f in enumerate(MORLET_HZ):
        sigma = max(3.0, f / 2) / (2 * np.pi * f)
        t = np.arange(-5 * sigma, 5 * sigma + 1 / rate, 1 / rate)
        w = np.exp(2j * np.pi * f * t - t * t / (2 * sigma * sigma))
        w /= np.sqrt(0.5) * np.linalg.norm(w)
        if len(w) > len(x):
            out[f"power_{i}"] = None
            continue
        n = len(x) + len(w) - 1
        y = np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(w, n))[(len(w) - 1) // 2 :][: len(x)]
        out[f"power_{i}"] = float((np.abs(y) ** 2).mean())
    return out


def resample(x: np.ndarray, size: int) -> np.ndarray:
    """The band-limited series of `size` values over the same time, by its spectrum."""
    f, n = np.fft.rfft(x), len(x)
    keep = min(size, n) // 2 + 1
    g = np.zeros(size // 2 + 1, complex)
    g[:keep] = f[:keep]
    if min(size, n) % 2 == 0 and size != n:  # the middle frequency stands for two where values are dropped, for half where they are added
        g[keep - 1] *= 0.5 if size > n else 2.0
    return np.fft.irfft(g, size) * (size / n)


def _measure(t: pa.Table, starts: np.ndarray, fn: Callable, names: list[str], rate: float) -> pa.Table:
    x = numbers(t, "value")
    rows = [fn(v, rate) if len(v := part[~np.isnan(part)]) >= 8 else {} for part in np.split(x, starts[1:])]
    keys = t.select([*KEYS, "epoch"]).take(pa.array(starts))
    for n in names:
        keys = keys.append_column(n, pa.array([r.get(n) for r in rows], pa.float64()))
    return keys


def measure_epochs(epochs: DataFrame, fn: Callable[[np.ndarray, float], dict], names: list[str], rate: float) -> DataFrame:
    """One row per series and epoch with what `fn` measures of its readings; nulls for epochs of fewer than 8."""
    rows = epochs.select(*KEYS, "epoch", "pos", "value")
    schema = "sid string, session int, channel string, epoch bigint, " + ", ".join(f"{n} double" for n in names)
    return sorted_groups(rows, [*KEYS, "epoch"], ["pos"], partial(_measure, fn=fn, names=names, rate=rate), schema)


PULSE = ["rate", "variability", "bounded_rate", "filtered_variability", "robust_variability"]
SPECTRUM = [*BANDS, *[f"{a}_{z}" for a, z in RATIOS], "spectral_entropy", "psd_max", "psd_mean", "psd_median"]
WAVELETS = [f"power_{i}" for i in range(len(MORLET_HZ))]


def pulse_measures(epochs: DataFrame, rate: float) -> DataFrame:
    return measure_epochs(epochs, pulse, PULSE, rate)


def band_powers(epochs: DataFrame, rate: float) -> DataFrame:
    return measure_epochs(epochs, bands, SPECTRUM, rate)


def wavelet_powers(epochs: DataFrame, rate: float) -> DataFrame:
    return measure_epochs(epochs, morlet, WAVELETS, rate)


def _coherence(t: pa.Table, starts: np.ndarray, rate: float, segment: int) -> pa.Table:
    x, pos, names = numbers(t, "value"), numbers(t, "pos"), np.array(t["channel"].to_pylist(), object)
    out: dict[str, list] = {k: [] for k in ("at", "one", "other", "coherence")}
    for a, b in zip(starts, np.append(starts[1:], t.num_rows)):
        ok = ~np.isnan(x[a:b])
        found = {c: (pos[a:b][k], x[a:b][k]) for c in sorted(set(names[a:b])) if (k := ok & (names[a:b] == c)).sum() >= 8}
        for one, other in combinations(found, 2):
            (p, v), (q, w) = found[one], found[other]
            _, i, j = np.intersect1d(p, q, return_indices=True)
            n = min(segment, len(i))
            if n >= 8 and len(i) >= n + n - n // 2:  # of one segment the coherence is 1 whatever it holds
                pxy, pxx, pyy = welch(v[i], rate, w[j], n)[1], welch(v[i], rate, None, n)[1], welch(w[j], rate, None, n)[1]
                den = pxx * pyy
                c = np.abs(pxy) ** 2 / np.where(den > 0, den, 1)
                for k, y in zip(out, (a, one, other, float(c[den > 0].mean()) if (den > 0).any() else None)):
                    out[k].append(y)
    keys = t.select(["sid", "session", "epoch"]).take(pa.array(out["at"], pa.int64()))
    return keys.append_column("one", pa.array(out["one"], pa.string())).append_column("other", pa.array(out["other"], pa.string())).append_column("coherence", pa.array(out["coherence"], pa.float64()))


def coherence(epochs: DataFrame, rate: float, segment: int = 256) -> DataFrame:
    """Mean magnitude-squared coherence of every two channels of a stream by epoch, over the instants both have; no row
    for an epoch of fewer than two segments."""
    rows = epochs.select("sid", "session", "epoch", "channel", "pos", "value")
    return sorted_groups(rows, ["sid", "session", "epoch"], ["channel", "pos"], partial(_coherence, rate=rate, segment=segment), "sid string, session int, epoch bigint, one string, other string, coherence double")


def _resample(t: pa.Table, starts: np.ndarray, size: int) -> pa.Table:
    parts = [resample(p, size) for p in np.split(numbers(t, "value", 0.0), starts[1:])]
    keys = t.select([*KEYS, "epoch"]).take(pa.array(np.repeat(starts, size)))
    epoch = np.asarray(keys["epoch"])
    return keys.append_column("pos", pa.array(epoch * size + np.tile(np.arange(size), len(starts)))).append_column("value", pa.array(np.concatenate(parts)))


def resample_epochs(epochs: DataFrame, size: int) -> DataFrame:
    """Every epoch as `size` values over the same time; its `value` has no gaps."""
    return sorted_groups(epochs.select(*KEYS, "epoch", "pos", "value"), [*KEYS, "epoch"], ["pos"], partial(_resample, size=size), "sid string, session int, channel string, epoch bigint, pos bigint, value double")


#: Taps on either side of the filter that a series is resampled with.
REACH = 512


@lru_cache(maxsize=4)
def _phases(up: int, down: int) -> np.ndarray:
    """Windowed-sinc filters (Kaiser) for each of the `up` places that a new instant has between two old ones."""
    t = np.arange(-REACH, REACH + 1)[None, :] - (np.arange(up) * down % up / up)[:, None]
    h = np.sinc(min(up / down, 1.0) * t) * np.i0(8 * np.sqrt(np.clip(1 - (t / (REACH + 1)) ** 2, 0, None)))
    return h / h.sum(axis=1, keepdims=True)


def resample_at(x: np.ndarray, first: int, ks: np.ndarray, up: int, down: int) -> np.ndarray:
    """The band-limited series at the positions ks * down / up; x begins at position `first` and goes on oddly beyond its ends."""
    p = min(REACH, len(x) - 1)
    y = np.concatenate([2 * x[0] - x[p:0:-1], x, 2 * x[-1] - x[-2 : -p - 2 : -1]]) if p else x
    y = np.pad(y, REACH + 2 - p, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(y, 2 * REACH + 1)
    at, h, out = ks * down // up - first + 2, _phases(up, down), np.empty(len(ks))
    for r in range(up):
        k = ks % up == r
        out[k] = windows[at[k]] @ h[r]
    return out


def _resample_chunks(t: pa.Table, starts: np.ndarray, up: int, down: int, chunk: int) -> pa.Table:
    x, pos, block, home = numbers(t, "x"), numbers(t, "pos"), numbers(t, "_b"), np.asarray(t["_home"])
    rows, ks, ys = [], [np.zeros(0, np.int64)], [np.zeros(0)]
    for a, b in zip(starts, np.append(starts[1:], t.num_rows)):
        if not home[a:b].any():
            continue
        p, edge = pos[a:b], int(block[a]) * chunk
        first, last = int(p[0]), int(p[-1])
        v = x[a:b] if last - first == b - a - 1 else np.interp(np.arange(first, last + 1), p, x[a:b])
        low = -(-max(edge, first) * up // down)
        high = -(-(edge + chunk) * up // down) if last >= edge + chunk else int(np.floor((last + 1) * up / down + 0.5))
        k = np.arange(low, high)
        rows.append(np.full(len(k), a))
        ks.append(k)
        ys.append(resample_at(v, first, k, up, down))
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return t.select(KEYS).take(pa.array(at)).append_column("pos", pa.array(np.concatenate(ks))).append_column("value", pa.array(np.concatenate(ys)))


def resample_series(rows: DataFrame, value: str, up: int, down: int, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """Whole series at up / down times their rate: (sid, session, channel, pos, value), pos counting the new instants, of
    which n old ones give n * up / down, rounded. No gaps in `value` (see interpolate); absent positions are interpolated.

    Chunks get `halo` positions of their neighbours, which is more than the filter reaches, so borders change nothing."""
    x = rows.select(*KEYS, "pos", rows[value].alias("x"))
    h = with_halo(x, KEYS, "pos", before=halo, after=halo, block=chunk)
    return sorted_groups(h, [*KEYS, "_b"], ["pos"], partial(_resample_chunks, up=up, down=down, chunk=chunk), "sid string, session int, channel string, pos bigint, value double")
