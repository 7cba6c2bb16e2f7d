"""Whole pipelines: recordings to a feature store, features with events, and a stream of epochs."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import entity_key, micros, stable
from pulsegrid.functions.ordered import with_running_sum
from pulsegrid.operators import epoch_features as E
from pulsegrid.operators import events as V
from pulsegrid.operators import kernels as K
from pulsegrid.operators import lookups
from pulsegrid.operators import series as S
from pulsegrid.plans.event_queries import SYNC_APART_US, SYNC_SPIKE
from pulsegrid.plans.spectral_queries import RATES
from pulsegrid.plans.series_queries import SIZE, _r, _sig, signal
from pulsegrid.session import small_side, table, written
from pulsegrid.streaming import epochs as T

FEATURES = ["mean", "std", "min", "max"]
CHANNELS = {"ACC": ["X", "Y", "Z"], "GYRO": ["X", "Y", "Z"], "PPG": ["Ambient", "IR", "Red"], "BVP": ["BVP"], "GSR": ["GSR"], "TEMP": ["TEMP"], "EEG": ["AF7", "AF8", "TP10", "TP9"]}
MOMENTS = [*FEATURES, "skew", "kurt"]
TURNS = ["magnitude", "magnitude_change", *[f"{w}_{c}" for w in ("turn", "rate") for c in "xyz"]]
#: Features of each modality by channel, and those over all its channels. Fixed values.
BY_CHANNEL = {
    "ACC": [*MOMENTS, "power", "entropy"],
    "GYRO": [*MOMENTS, "power", "crossings"],
    "PPG": ["bounded_rate", "filtered_variability", "robust_variability", "amplitude", "flow"],
    "BVP": [*MOMENTS, "power", "rate", "variability"],
    "GSR": ["level", "variance", "responses", "amplitude"],
    "TEMP": ["min", "mean", "max", "std", "rate"],
    "EEG": [*K.SPECTRUM, *K.WAVELETS, "mean", "std", "variance", "skew", "kurt"],
}
OVERALL = {"ACC": [("XYZ", "sma")], "GYRO": [("XYZ", t) for t in TURNS], "EEG": [(f"{a}_{b}", "coherence") for a, b in combinations(CHANNELS["EEG"], 2)]}


def preprocess(rows: DataFrame, modality: str, factor: int = 1) -> DataFrame:
    """Clean rows of one modality as epochs, in the order of steps of that modality.

    ACC, GYRO: low-pass, decimate, z-score, epochs by count. PPG: band-pass, decimate, z-score, epochs by count. BVP:
    band-pass, decimate, epochs by the clock. GSR: decimate, low-pass, scale to 0..1, epochs by the clock. TEMP:
    decimate, smooth, take off the ramp, scale, epochs by the clock. EEG: high-pass and notch, overlapping epochs,
    standardised over the recording. Gaps are interpolated before a filter, and what a filter gives is written to the
    shared folder, as later steps read it more than once.
    """
    rate = RATES[modality] / max(factor, 1)
    times = rows.select(*S.KEYS, "pos", "ts")

    def filtered(df: DataFrame, fn, *args, **kwargs) -> DataFrame:
        return written(fn(S.interpolate(df), "filled", *args, **kwargs).join(times, [*S.KEYS, "pos"]), "filtered")

    def scaled(df: DataFrame) -> DataFrame:
        return df.withColumn("value", F.col("scaled")).drop("scaled")

    if modality in ("ACC", "GYRO"):
        return S.count_epochs(scaled(S.z_score(S.decimate(filtered(rows, K.low_pass, 0.5, RATES[modality]), factor))), int(5 * rate))
    if modality == "PPG":
        return S.count_epochs(scaled(S.z_score(S.decimate(filtered(rows, K.band_pass, 0.5, 4.0, RATES[modality]), factor))), int(5 * rate))
    if modality == "BVP":
        return S.time_epochs(S.decimate(filtered(rows, K.band_pass, 0.5, 4.0, RATES[modality]), factor), 5.0)
    if modality == "EEG":
        smooth = filtered(filtered(rows, K.fir_pass, 1.0, None, RATES[modality]), K.fir_pass, 48.0, 52.0, RATES[modality], stop=True)
        return S.overlapping_epochs(scaled(S.z_score(smooth, S.STREAM, population=True)), int(5 * rate))
    times = S.decimate(times, factor)
    slow = S.decimate(rows, factor)
    if modality == "GSR":
        return S.time_epochs(scaled(S.min_max(filtered(slow, K.low_pass, 1.0, rate))), 5.0)
    level = S.remove_ramp(S.moving_average(slow).withColumn("value", F.col("smooth")).drop("smooth"))
    return S.time_epochs(scaled(S.min_max(level.withColumn("value", F.col("level")).drop("level"))), 5.0)


def preprocessed(spark, folder) -> DataFrame:
    """Epochs of every modality after its own steps."""
    parts = [preprocess(signal(spark, folder, m), m).select(*S.KEYS, "epoch", "pos", "value") for m in ("ACC", "PPG", "BVP", "GSR", "TEMP", "EEG")]
    return reduce(DataFrame.unionByName, parts)


def feature_store(spark, folder) -> DataFrame:
    """Features of every epoch of every modality in long form: (sid, session, epoch, channel, feature, value)."""
    m = E.moments(S.count_epochs(signal(spark, folder), SIZE))
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), stable(F.col(f)).alias("value")) for f in FEATURES]))
    return m.select("sid", "session", "epoch", "channel", each).where(F.col("value").isNotNull())


def trimmed(rows: DataFrame, markers: DataFrame, recordings: DataFrame, to_end: bool = False) -> DataFrame:
    """Readings from the first marker of their log to the start of its last one (`to_end`: to its end), instants counted
    anew from 0. Recordings of a log without markers stay whole."""
    last = F.max_by(F.struct("start_time", "duration_s"), F.struct("start_time", "row_id"))
    m = markers.groupBy("log_key", "session").agg(F.min("start_time").alias("_opens"), last.alias("_l"))
    closes = F.col("_l.start_time") + (F.greatest(F.coalesce("_l.duration_s", F.lit(0.0)), F.lit(0.0)) if to_end else F.lit(0.0))
    owners = recordings.groupBy(entity_key("stream_id").alias("sid"), "session").agg(F.min("log_key").alias("log_key"))
    spans = small_side(owners.join(m, ["log_key", "session"]).select(*S.STREAM, "_opens", closes.alias("_closes")), "spans")
    within = (micros("ts") / 1e6).between(F.col("_opens"), F.col("_closes"))
    kept = written(rows.join(spans, S.STREAM, "left").where(F.col("_opens").isNull() | within).drop("_opens", "_closes"), "trimmed")
    number = with_running_sum(kept.select(*S.STREAM, "pos").distinct(), S.STREAM, "pos", F.lit(1).cast("bigint"), "_n")
    return kept.join(number, [*S.STREAM, "pos"]).withColumn("pos", F.col("_n") - 1).drop("_n")


def _long(df: DataFrame, names: list[str], channel: Column | None = None) -> DataFrame:
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names]))
    channel = F.col("channel") if channel is None else channel
    return df.select("sid", "session", "epoch", channel.alias("channel"), each).where(F.col("value").isNotNull())


def modality_features(epochs: DataFrame, modality: str, rate: float | None = None) -> DataFrame:
    """All features of the preprocessed epochs of one modality in long form: (sid, session, epoch, channel, feature, value).

    Features over all axes have the channel XYZ, coherence the names of its two channels. Blood flow is of streams worn
    on the head only. Features that an epoch does not have, as a pulse without peaks, have no row."""
    rate, e = rate or RATES[modality], epochs.withColumn("index", F.col("pos"))  # the power needs no more than which of two neighbours comes first
    if modality in ("ACC", "GYRO"):
        wide = e.groupBy(*S.STREAM, "epoch", "pos").agg(*[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c.lower()) for c in CHANNELS[modality]])
        last = (E.entropy(e), ["entropy"]) if modality == "ACC" else (E.crossings(e, E.EPOCH), ["crossings"])
        parts = [_long(E.moments(e), MOMENTS), _long(E.mean_power(e), ["power"]), _long(*last), _long(E.motion(wide), [f for _, f in OVERALL[modality]], F.lit("XYZ"))]
    elif modality == "BVP":
        parts = [_long(E.sample_moments(e), MOMENTS), _long(E.mean_power(e), ["power"]), _long(K.pulse_measures(e, rate), ["rate", "variability"])]
    elif modality == "PPG":
        flow = E.blood_flow(e.where(F.col("sid").contains("muse")))
        parts = [_long(K.pulse_measures(e, rate), BY_CHANNEL["PPG"][:3]), _long(E.pulse_amplitude(e), ["amplitude"]), _long(flow, ["flow"])]
    elif modality == "GSR":
        parts = [_long(E.skin_response(e), BY_CHANNEL["GSR"])]
    elif modality == "TEMP":
        parts = [_long(E.change_rates(e), BY_CHANNEL["TEMP"])]
    else:
        m = E.moments(e).withColumn("variance", F.col("std") * F.col("std"))
        pairs = F.concat_ws("_", "one", "other")
        parts = [_long(K.band_powers(e, rate), K.SPECTRUM), _long(K.wavelet_powers(e, rate), K.WAVELETS), _long(K.coherence(e, rate), ["coherence"], pairs), _long(m, ["mean", "std", "variance", "skew", "kurt"])]
    return reduce(DataFrame.unionByName, parts)


def modality_wide(features: DataFrame, modality: str, recordings: DataFrame) -> DataFrame:
    """Long features of one modality as one row per stream, session and epoch with the user, a column per channel and feature."""
    places = [(c, f) for c in CHANNELS[modality] for f in BY_CHANNEL[modality]] + OVERALL.get(modality, [])
    cols = [F.max(F.when((F.col("channel") == c) & (F.col("feature") == f), F.col("value"))).alias(f"{c}_{f}".lower()) for c, f in places]
    owners = small_side(lookups.stream_owners(recordings).select("sid", "session", "user_id"), "owners")
    return features.groupBy("sid", "session", "epoch").agg(*cols).join(owners, ["sid", "session"], "left")


def _markers(spark, folder) -> DataFrame:
    log, recordings = table(spark, folder, "log_events"), table(spark, folder, "recordings")
    wide = S.widen(signal(spark, folder, "ACC"), ["X", "Y", "Z"])
    return written(V.shift_markers(log, V.window_shifts(wide, log, recordings, SYNC_SPIKE, SYNC_APART_US)), "markers")


def _driven(spark, folder, modality: str, markers: DataFrame) -> DataFrame:
    rows = trimmed(signal(spark, folder, modality), markers, table(spark, folder, "recordings"), to_end=modality == "EEG")
    epochs = written(preprocess(rows, modality).select(*S.KEYS, "epoch", "pos", "value"), "epochs")
    return modality_features(epochs, modality).withColumn("value", stable(F.col("value")))


def feature_drivers(spark, folder) -> DataFrame:
    """Recordings to features: markers moved by the shift of their log, readings trimmed to them, every modality
    preprocessed, and all its features in long form."""
    markers = _markers(spark, folder)
    return reduce(DataFrame.unionByName, [_driven(spark, folder, m, markers).withColumn("modality", F.lit(m)) for m in CHANNELS])


def _wide_query(modality: str):
    def query(spark, folder) -> DataFrame:
        return modality_wide(_driven(spark, folder, modality, _markers(spark, folder)), modality, table(spark, folder, "recordings"))

    return query


def stream_epochs(spark, folder) -> DataFrame:
    """Five-second windows of the temperature, computed as a stream of files."""
    s = T.tumbling(T.signal_stream(spark, f"{folder}/signal_long.parquet", "TEMP"))
    return T.drain(s, ["sid", "session", "channel", "start"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_spikes(spark, folder) -> DataFrame:
    """Pulse readings over 60, at least a quarter of a second apart, with the last one kept as streaming state."""
    s = T.spaced(T.signal_stream(spark, f"{folder}/signal_long.parquet", "BVP"), 60.0, 250_000)
    return T.drain(s, [], "append")


QUERIES = {f.__name__: f for f in (preprocessed, feature_store, feature_drivers, stream_epochs, stream_spikes)} | {f"{m.lower()}_features": _wide_query(m) for m in CHANNELS}
SQL = {
    "feature_store": f"with {_sig()}, ep as (select *, pos // {SIZE} as epoch from sig qualify count(*) over (partition by sid, session, channel, pos // {SIZE}) = {SIZE}), m as (select sid, session, epoch, channel, avg(value) as mean, stddev_pop(value) as std, min(value) as min, max(value) as max from ep group by 1, 2, 3, 4) "
    + " union all ".join(f"select sid, session, epoch, channel, '{f}' as feature, {_r(f)} as value from m where {f} is not null" for f in FEATURES),
    "stream_epochs": "select lower(trim(stream_id)) as sid, session, channel, time_bucket(interval 5 seconds, ts, timestamp '1970-01-01') as start, count(case when isnan(value) or isinf(value) then null else value end) as n, min(case when isnan(value) or isinf(value) then null else value end) as min, max(case when isnan(value) or isinf(value) then null else value end) as max from signal_long where modality = 'TEMP' group by 1, 2, 3, 4",
    "stream_spikes": """with l as (select lower(trim(stream_id)) as sid, session, channel, list_sort(list(epoch_us(ts))) as l from signal_long where modality = 'BVP' and value > 60 and not isnan(value) and not isinf(value) and ts is not null group by 1, 2, 3)
select sid, session, channel, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: if(x[1] - acc[-1] > 250000, list_concat(acc, x), acc))) as t from l""",
}
