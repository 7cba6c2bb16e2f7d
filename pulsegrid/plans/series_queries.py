"""Queries on recordings as series: rates, resampling, filling, scaling, epochs and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.columns import entity_key, stable
from pulsegrid.operators import epoch_features as E
from pulsegrid.operators import series as S
from pulsegrid.session import table

SIZE = 40  # positions of an epoch
ROW = ["sid", "session", "channel", "pos"]


def signal(spark: SparkSession, folder: str, modality: str | None = None) -> DataFrame:
    return S.clean(table(spark, folder, "signal_long"), modality)


def _epochs(spark: SparkSession, folder: str, modality: str, scaled: bool = False) -> DataFrame:
    rows = signal(spark, folder, modality)
    if scaled:
        rows = S.z_score(rows).withColumn("value", F.col("scaled")).drop("scaled")
    return S.count_epochs(rows, SIZE).withColumn("index", F.pmod("pos", F.lit(SIZE)))


def _cropped(spark: SparkSession, folder: str, modality: str) -> DataFrame:
    spans = table(spark, folder, "recordings").select(entity_key("stream_id").alias("sid"), "session", "rec_start", "rec_end")
    return S.crop(signal(spark, folder, modality), spans, ["sid", "session"], "rec_start", "rec_end")


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: stable(F.col(c), digits) for c in cols})


MOMENTS = ["mean", "std", "skew", "kurt"]


def sampling_rates(spark, folder):
    return _rounded(S.sampling_rates(signal(spark, folder)), "sfreq", "min_sfreq").select("sid", "session", "sfreq", "sfreq_int", "min_sfreq")


def decimated(spark, folder):
    return S.decimate(signal(spark, folder, "TEMP"), 4).select(*ROW, "ts", "value")


def held(spark, folder):
    return S.fill_held(signal(spark, folder, "BVP")).select(*ROW, "value", "filled")


def interpolated(spark, folder):
    return _rounded(S.interpolate(signal(spark, folder, "ACC")), "filled").select(*ROW, "value", "filled")


def stepped(spark, folder):
    return _rounded(S.differences(signal(spark, folder, "GSR")), "step").select(*ROW, "step")


def smoothed(spark, folder):
    return _rounded(S.moving_average(signal(spark, folder, "TEMP")), "smooth").select(*ROW, "smooth")


def median_filtered(spark, folder):
    return S.median_filter(signal(spark, folder, "PPG")).select(*ROW, "median")


def z_scores(spark, folder):
    return _rounded(S.z_score(signal(spark, folder, "ACC")), "scaled").select(*ROW, "scaled")


def min_max(spark, folder):
    return _rounded(S.min_max(signal(spark, folder, "GSR")), "scaled").select(*ROW, "scaled")


def standardised(spark, folder):
    return _rounded(S.z_score(signal(spark, folder, "EEG"), S.STREAM, population=True), "scaled").select(*ROW, "scaled")


def levelled(spark, folder):
    return _rounded(S.remove_ramp(signal(spark, folder, "TEMP")), "level").select(*ROW, "level")


def rereferenced(spark, folder):
    return _rounded(S.rereference(signal(spark, folder, "EEG"), "TP10"), "value").select(*ROW, "value")


def cropped(spark, folder):
    return _cropped(spark, folder, "EEG").select(*ROW, "ts", "value")


def sliced(spark, folder):
    return S.slice_positions(signal(spark, folder, "PPG"), 20, 60).select(*ROW, "value")


def epoch_moments(spark, folder):
    return _rounded(E.moments(_epochs(spark, folder, "ACC")), *MOMENTS)


def eeg_epoch_moments(spark, folder):
    return _rounded(E.moments(S.overlapping_epochs(signal(spark, folder, "EEG"), SIZE)), *MOMENTS)


def bvp_moments(spark, folder):
    return _rounded(E.sample_moments(S.time_epochs(_cropped(spark, folder, "BVP"), 2.0)), *MOMENTS)


def mean_power(spark, folder):
    return _rounded(E.mean_power(_epochs(spark, folder, "ACC")), "power", digits=3)


def entropy(spark, folder):
    return _rounded(E.entropy(_epochs(spark, folder, "ACC", scaled=True)), "entropy", digits=4)


def motion(spark, folder):
    wide = S.widen(signal(spark, folder, "ACC"), ["X", "Y", "Z"]).withColumn("epoch", F.floor(F.col("pos") / SIZE))
    m = E.motion(wide)
    return _rounded(m, *[c for c, t in m.dtypes if t == "double"])


def crossings(spark, folder):
    return E.crossings(_epochs(spark, folder, "ACC", scaled=True))


def epoch_starts(spark, folder):
    return S.epoch_starts(S.time_epochs(_cropped(spark, folder, "TEMP"), 10.0))


def orientation(spark, folder):
    return _rounded(S.running_orientation(signal(spark, folder, "ACC")), "turned", digits=4).select(*ROW, "turned")


def scaled_by_normality(spark, folder):
    rows = signal(spark, folder, "EEG")
    return _rounded(S.scale_by_normality(rows, E.normality(rows)), "scaled").select(*ROW, "scaled")


def temperature(spark, folder):
    return _rounded(E.change_rates(S.time_epochs(_cropped(spark, folder, "TEMP"), 10.0)), "mean", "std", "rate")


def skin_response(spark, folder):
    return _rounded(E.skin_response(S.time_epochs(_cropped(spark, folder, "GSR"), 10.0)), "level", "variance", "amplitude")


def pulse_amplitude(spark, folder):
    return _rounded(E.pulse_amplitude(_epochs(spark, folder, "PPG")), "amplitude")


def blood_flow(spark, folder):
    return _rounded(E.blood_flow(_epochs(spark, folder, "PPG")), "flow")


def rejected(spark, folder):
    return _rounded(E.peak_to_peak_rejection(S.overlapping_epochs(signal(spark, folder, "EEG"), SIZE), 150.0), "span")


def normality(spark, folder):
    return _rounded(E.normality(signal(spark, folder, "EEG")), "k2", digits=3).withColumn("p", stable(F.col("p")))


def wide_features(spark, folder):
    """Epoch features pivoted to one row per stream and epoch, a column per channel and feature."""
    m = E.moments(_epochs(spark, folder, "ACC"))
    cols = [F.max(F.when(F.col("channel") == c, stable(F.col(f)))).alias(f"acc_{c.lower()}_{f}") for c in ("X", "Y", "Z") for f in ("mean", "std", "min", "max")]
    return m.groupBy("sid", "session", "epoch").agg(*cols)


def baselined(spark, folder):
    return _rounded(S.baseline_by_channel(_epochs(spark, folder, "EEG"), "TP9"), "value").select(*ROW, "epoch", "value")


def histograms(spark, folder):
    return _rounded(S.histogram(signal(spark, folder), ["channel"]), "from", digits=4)


QUERIES = {f.__name__: f for f in (sampling_rates, decimated, held, interpolated, stepped, smoothed, median_filtered, z_scores, min_max, standardised, levelled, rereferenced, cropped, sliced, epoch_moments, eeg_epoch_moments, bvp_moments, mean_power, entropy, motion, crossings, epoch_starts, orientation, scaled_by_normality, temperature, skin_response, pulse_amplitude, blood_flow, rejected, normality, wide_features, baselined, histograms)}


def _sig(modality: str | None = None) -> str:
    where = f"modality = '{modality}' and " if modality else ""
    return f"""sig as (select lower(trim(stream_id)) as sid, session, channel, pos, min(ts) as ts, min(case when isnan(value) or isinf(value) then null else value end) as value
from signal_long where {where}pos is not null group by 1, 2, 3, 4)"""


def _r(x: str, digits: int = 6) -> str:
    return f"round({x} + {10.0 ** -(digits + 3)!r}, {digits}) + 0.0"


_W = "partition by sid, session, channel order by pos"
_EP = f"ep as (select *, pos // {SIZE} as epoch, pos % {SIZE} as i from SRC qualify count(*) over (partition by sid, session, channel, pos // {SIZE}) = {SIZE})"
_EEG_EP = f"""e0 as (select *, unnest(case when pos % {SIZE} = 0 and pos > 0 then [pos // {SIZE}, pos // {SIZE} - 1] else [pos // {SIZE}] end) as epoch from sig),
ep as (select * from e0 qualify count(*) over (partition by sid, session, channel, epoch) = {SIZE + 1})"""
_REC = "rec as (select lower(trim(stream_id)) as sid, session, rec_start, rec_end from recordings), cr as (select sig.* from sig join rec using (sid, session) where ts between rec_start and rec_end)"
_Z = "z as (select * exclude (value), (value - m) / nullif(s, 0) as value from (select *, avg(value) over g as m, stddev_samp(value) over g as s from sig window g as (partition by sid, session, channel)))"


def _time_ep(us: int) -> str:
    return f"""t0 as (select *, epoch_us(ts) as t, min(epoch_us(ts)) over g as a, max(epoch_us(ts)) over g as zz, count(*) over g as n from cr window g as (partition by sid, session, channel)),
t1 as (select *, (t - a) // {us} as w from t0 where (t - a) // {us} < greatest(ceil(n * (zz - a) / nullif((n - 1) * {us}.0, 0)), 1)),
ep as (select *, dense_rank() over (partition by sid, session, channel order by w) - 1 as epoch from t1)"""


_MOM = f"""select sid, session, channel, epoch, count(value) as n, {_r('avg(value)')} as mean, {_r('stddev_pop(value)')} as std, min(value) as min, max(value) as max,
 case when max(value) > min(value) then {_r('sum(d*d*d) / count(value) / pow(sum(d*d) / count(value), 1.5)')} end as skew, case when max(value) > min(value) then {_r('sum(d*d*d*d) / count(value) / pow(sum(d*d) / count(value), 2) - 3')} end as kurt
 from (select *, value - avg(value) over (partition by sid, session, channel, epoch) as d from ep) group by 1, 2, 3, 4"""
_PEAKS = """pv as (select *, SIGN * value as v from ep where value is not null),
ch as (select * from pv qualify v is distinct from lag(v) over (partition by sid, session, channel, epoch order by pos)),
pk as (select * from ch window k as (partition by sid, session, channel, epoch order by pos) qualify lag(v) over k < v and lead(v) over k < v)"""
_NORMAL = """with m as (select sid, session, count(value) as n, avg(value) as mu, sum(d2) / count(value) as m2, sum(d3) / count(value) as m3, sum(d4) / count(value) as m4 from (select *, d*d as d2, d*d*d as d3, d*d*d*d as d4 from (select *, value - avg(value) over (partition by sid, session) as d from sig)) group by 1, 2 having count(value) >= 20),
g as (select sid, session, n, m3 / pow(m2, 1.5) as g1, m4 / (m2 * m2) - 3 as g2 from m where m2 > 0),
a as (select *, g1 * sqrt((n+1.0)*(n+3)/(6.0*(n-2))) as y, 3.0*(n*n+27.0*n-70)*(n+1)*(n+3)/((n-2.0)*(n+5)*(n+7)*(n+9)) as b2, 3.0*(n-1)/(n+1) as e, 24.0*n*(n-2)*(n-3)/((n+1.0)*(n+1)*(n+3)*(n+5)) as v,
 6.0*(n*n-5.0*n+2)/((n+7.0)*(n+9)) * sqrt(6.0*(n+3)*(n+5)/(n*(n-2.0)*(n-3))) as s from g),
b as (select *, sqrt(2*(b2-1))-1 as w2, (g2 + 3 - e)/sqrt(v) as x, 6 + 8/s*(2/s + sqrt(1 + 4/(s*s))) as aa from a),
c as (select *, asinh(y / sqrt(2/(w2-1))) / sqrt(0.5*ln(w2)) as z1, ((1 - 2/(9*aa)) - cbrt((1-2/aa)/(1 + x*sqrt(2/(aa-4))))) / sqrt(2/(9*aa)) as z2 from b)
"""
SQL = {
    "sampling_rates": f"with {_sig()}, t as (select sid, session, pos, min(epoch_us(ts)) as t from sig where ts is not null group by 1, 2, 3), r as (select sid, session, (count(*) - 1) / nullif((max(t) - min(t)) / 1e6, 0) as f from t group by 1, 2) select sid, session, {_r('f')} as sfreq, cast(floor(f) as bigint) as sfreq_int, {_r("min(f) over (partition by split_part(sid, '_', -1))")} as min_sfreq from r",
    "decimated": f"with {_sig('TEMP')} select sid, session, channel, pos // 4 as pos, ts, value from sig where pos % 4 = 0",
    "held": f"with {_sig('BVP')} select sid, session, channel, pos, value, coalesce(last_value(value ignore nulls) over ({_W} rows unbounded preceding), first_value(value ignore nulls) over ({_W} rows between current row and unbounded following)) as filled from sig",
    "interpolated": f"""with {_sig('ACC')}, n as (select *, last_value(value ignore nulls) over ({_W} rows unbounded preceding) as v0, last_value(case when value is not null then pos end ignore nulls) over ({_W} rows unbounded preceding) as p0,
 first_value(value ignore nulls) over ({_W} rows between current row and unbounded following) as v1, first_value(case when value is not null then pos end ignore nulls) over ({_W} rows between current row and unbounded following) as p1 from sig)
select sid, session, channel, pos, value, {_r('case when value is not null then value when p0 is null then 0 when p1 is null then v0 else v0 + (v1 - v0) * ((pos - p0) / (p1 - p0)) end')} as filled from n""",
    "stepped": f"with {_sig('GSR')} select sid, session, channel, pos, {_r(f'value - last_value(value ignore nulls) over ({_W} rows between unbounded preceding and 1 preceding)')} as step from sig",
    "smoothed": f"with {_sig('TEMP')} select sid, session, channel, pos, {_r('case when count(*) over w = 5 then avg(value) over w else 0 end')} as smooth from sig window w as ({_W} range between current row and 4 following)",
    "median_filtered": f"with {_sig('PPG')}, l as (select *, list(coalesce(value, 0)) over ({_W} range between 2 preceding and 2 following) as l from sig) select sid, session, channel, pos, list_sort(list_resize(l, 5, 0.0::double))[3] as median from l",
    "z_scores": f"with {_sig('ACC')}, {_Z} select sid, session, channel, pos, {_r('value')} as scaled from z",
    "min_max": f"with {_sig('GSR')} select sid, session, channel, pos, {_r('(value - min(value) over g) / nullif(max(value) over g - min(value) over g, 0)')} as scaled from sig window g as (partition by sid, session, channel)",
    "standardised": f"with {_sig('EEG')} select sid, session, channel, pos, {_r('(value - avg(value) over g) / nullif(stddev_pop(value) over g, 0)')} as scaled from sig window g as (partition by sid, session)",
    "levelled": f"with {_sig('TEMP')} select sid, session, channel, pos, {_r('value - avg(value) over g * coalesce((pos - min(pos) over g) / nullif(max(pos) over g - min(pos) over g, 0), 0)')} as level from sig window g as (partition by sid, session, channel)",
    "rereferenced": f"with {_sig('EEG')} select a.sid, a.session, a.channel, a.pos, {_r('a.value - b.value')} as value from sig a left join (select * from sig where channel = 'TP10') b using (sid, session, pos) where a.channel <> 'TP10'",
    "cropped": f"with {_sig('EEG')}, {_REC} select sid, session, channel, pos, ts, value from cr",
    "sliced": f"with {_sig('PPG')} select sid, session, channel, pos, value from sig where pos >= 20 and pos < 60",
    "epoch_moments": f"with {_sig('ACC')}, {_EP.replace('SRC', 'sig')} {_MOM}",
    "eeg_epoch_moments": f"with {_sig('EEG')}, {_EEG_EP} {_MOM}",
    "bvp_moments": f"with {_sig('BVP')}, {_REC}, {_time_ep(2000000)} select sid, session, channel, epoch, count(value) as n, {_r('avg(value)')} as mean, {_r('stddev_pop(value)')} as std, min(value) as min, max(value) as max, case when max(value) > min(value) then {_r('skewness(value)')} end as skew, case when max(value) > min(value) then {_r('kurtosis(value)')} end as kurt from ep group by 1, 2, 3, 4",
    "mean_power": f"with {_sig('ACC')}, {_EP.replace('SRC', 'sig')} select sid, session, channel, epoch, {_r('(count(value) * sum(value*value) + sum(value)*sum(value) + case when count(value) % 2 = 0 then pow(sum(case when i % 2 = 0 then value else -value end), 2) else 0 end) / 2 / (count(value) // 2 + 1)', 3)} as power from ep where value is not null group by 1, 2, 3, 4",
    "entropy": f"with {_sig('ACC')}, {_Z}, {_EP.replace('SRC', 'z')} select sid, session, channel, epoch, {_r('coalesce(-sum((value + 1e-10) * log2(value + 1e-10)) filter (value + 1e-10 > 0), 0)', 4)} as entropy from ep group by 1, 2, 3, 4",
    "motion": f"""with {_sig('ACC')}, w as (select sid, session, pos, pos // {SIZE} as epoch, max(case when channel = 'X' then value end) as x, max(case when channel = 'Y' then value end) as y, max(case when channel = 'Z' then value end) as z from sig group by 1, 2, 3),
m as (select *, sqrt(x*x + y*y + z*z) as mag from w where x is not null and y is not null and z is not null)
select sid, session, epoch, {_r('sum(abs(x) + abs(y) + abs(z))')} as sma, {_r('avg(mag)')} as magnitude, {_r('(arg_max(mag, pos) - arg_min(mag, pos)) / nullif(count(*) - 1, 0)')} as magnitude_change,
 {', '.join(_r(f'sum({c})') + f' as turn_{c}' for c in 'xyz')}, {', '.join(_r(f'(sum(abs({c})) - arg_min(abs({c}), pos)) / nullif(count(*) - 1, 0)') + f' as rate_{c}' for c in 'xyz')} from m group by 1, 2, 3""",
    "crossings": f"with {_sig('ACC')}, {_Z}, {_EP.replace('SRC', 'z')}, n as (select *, last_value(value ignore nulls) over (partition by sid, session, channel, epoch order by pos rows between unbounded preceding and 1 preceding) as p from ep) select sid, session, channel, epoch, count(*) filter (value * p < 0) as crossings from n group by 1, 2, 3, 4",
    "epoch_starts": f"with {_sig('TEMP')}, {_REC}, {_time_ep(10000000)} select sid, session, channel, epoch, min(ts) as first_ts from ep group by 1, 2, 3, 4",
    "orientation": f"with {_sig('ACC')} select sid, session, channel, pos, {_r(f'sum(coalesce(value, 0)) over ({_W} rows unbounded preceding)', 4)} as turned from sig",
    "scaled_by_normality": _NORMAL.replace("with m", f"with {_sig('EEG')}, m", 1) + f", ok as (select min(exp(-(z1*z1 + z2*z2)/2)) >= 0.05 / count(*) as normal from c) select sid, session, channel, pos, case when (select normal from ok) then {_r('(value - min(value) over g) / nullif(max(value) over g - min(value) over g, 0)')} else {_r('(value - avg(value) over g) / nullif(stddev_samp(value) over g, 0)')} end as scaled from sig window g as (partition by sid, session, channel)",
    "temperature": f"with {_sig('TEMP')}, {_REC}, {_time_ep(10000000)}, n as (select *, last_value(value ignore nulls) over (partition by sid, session, channel, epoch order by pos rows between unbounded preceding and 1 preceding) as p from ep) select sid, session, channel, epoch, min(value) as min, {_r('avg(value)')} as mean, max(value) as max, {_r('stddev_pop(value)')} as std, {_r('coalesce(avg(abs(value - p)), 0)')} as rate from n group by 1, 2, 3, 4",
    "skin_response": f"with {_sig('GSR')}, {_REC}, {_time_ep(10000000)}, {_PEAKS.replace('SIGN', '1')}, q as (select sid, session, channel, epoch, count(*) as responses, avg(value) as amplitude from pk where value >= 0.05 group by 1, 2, 3, 4) select sid, session, channel, epoch, {_r('avg(value)')} as level, {_r('var_pop(value)')} as variance, coalesce(any_value(responses), 0) as responses, {_r('coalesce(any_value(amplitude), 0)')} as amplitude from ep left join q using (sid, session, channel, epoch) group by 1, 2, 3, 4",
    "pulse_amplitude": f"with {_sig('PPG')}, {_EP.replace('SRC', 'sig')} select sid, session, channel, epoch, {_r('max(value) - min(value)')} as amplitude from ep group by 1, 2, 3, 4",
    "blood_flow": f"with {_sig('PPG')}, {_EP.replace('SRC', 'sig')}, {_PEAKS.replace('SIGN', '1')}, {_PEAKS.replace('SIGN', '-1').replace('pv', 'dv').replace('ch as', 'dh as').replace('from ch', 'from dh').replace('pk as', 'dk as')}, u as (select sid, session, channel, epoch, avg(value) as up from pk group by 1, 2, 3, 4), d as (select sid, session, channel, epoch, avg(value) as down from dk group by 1, 2, 3, 4) select sid, session, channel, epoch, {_r('any_value(up) - any_value(down)')} as flow from ep left join u using (sid, session, channel, epoch) left join d using (sid, session, channel, epoch) group by 1, 2, 3, 4",
    "rejected": f"with {_sig('EEG')}, {_EEG_EP}, s as (select sid, session, channel, epoch, max(value) - min(value) as span from ep group by 1, 2, 3, 4) select sid, session, epoch, {_r('max(span)')} as span from s group by 1, 2, 3 having max(span) > 150",
    "normality": _NORMAL.replace("with m", f"with {_sig('EEG')}, m", 1) + f"select sid, session, n, {_r('z1*z1 + z2*z2', 3)} as k2, {_r('exp(-(z1*z1 + z2*z2)/2)')} as p from c",
    "baselined": f"with {_sig('EEG')}, {_EP.replace('SRC', 'sig')}, b as (select sid, session, epoch, avg(value) as b from ep where channel = 'TP9' group by 1, 2, 3) select sid, session, channel, pos, epoch, {_r('value - b')} as value from ep left join b using (sid, session, epoch)",
    "histograms": f"with {_sig()}, g as (select channel, value, min(value) over c as a, max(value) over c as z from sig where value is not null window c as (partition by channel)), h as (select *, cast(coalesce(least(floor((value - a) / nullif((z - a) / 50, 0)), 49), 0) as bigint) as bin from g) select channel, bin, {_r('any_value(a) + bin * any_value((z - a) / 50)', 4)} as \"from\", count(*) as readings from h group by channel, bin",
    "wide_features": f"with {_sig('ACC')}, {_EP.replace('SRC', 'sig')}, m as (select sid, session, channel, epoch, avg(value) as mean, stddev_pop(value) as std, min(value) as min, max(value) as max from ep group by 1, 2, 3, 4) select sid, session, epoch, "
    + ", ".join(f"max(case when channel = '{c}' then {_r(f)} end) as acc_{c.lower()}_{f}" for c in "XYZ" for f in ("mean", "std", "min", "max"))
    + " from m group by 1, 2, 3",
}
