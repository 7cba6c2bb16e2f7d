"""Queries on events, logs and features: merges, enrichment, spikes, log parsing, averages and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.columns import entity_key, finite, stable
from pulsegrid.operators import correlate as C
from pulsegrid.operators import events as V
from pulsegrid.operators import logs as L
from pulsegrid.operators import lookups as K
from pulsegrid.operators import series as S
from pulsegrid.operators import validate
from pulsegrid.session import table

CATEGORIES = ["Trial Sets", "Rest Events", "Sync Events"]
SPIKE, APART_US, AROUND_S = 9.9, 250_000, 600.0
#: Magnitude of a sync spike in m/s2, above that at rest (9.93 at the median of the test data), and the microseconds between two.
SYNC_SPIKE, SYNC_APART_US = 12.0, 1_000_000


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name)


def _wide(spark: SparkSession, folder: str) -> DataFrame:
    return S.widen(S.clean(_t(spark, folder, "signal_long"), "ACC"), ["X", "Y", "Z"])


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    f = _t(spark, folder, "feature_rows")
    f = f.withColumns({m: finite(m) for m in C.MEASURES})
    return V.merge_covering(f, _t(spark, folder, "stream_events"))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "feature_rows").withColumn("sid", entity_key("stream_id")).withColumn("mean_value", finite("mean_value"))


def equal_merge(spark, folder):
    return V.merge_equal(_t(spark, folder, "feature_rows"), _t(spark, folder, "stream_events")).select("feature_id", "event_row_id", "event_name")


def covering_merge(spark, folder):
    return _merged(spark, folder).select("feature_id", *V.EVENT)


def enriched_events(spark, folder):
    return V.enrich_events(_t(spark, folder, "stream_events"), _t(spark, folder, "log_events"))


def spike_bounds(spark, folder):
    return V.first_and_last(_wide(spark, folder), SPIKE)


def spaced_spikes(spark, folder):
    return V.spaced_spikes(_wide(spark, folder), SPIKE, APART_US)


def sync_markers(spark, folder):
    return V.sync_markers(_t(spark, folder, "log_events"))


def sync_shifts(spark, folder):
    s = V.sync_shifts(V.spaced_spikes(_wide(spark, folder), SPIKE, APART_US), _t(spark, folder, "log_events"), _t(spark, folder, "recordings"), AROUND_S)
    return s.withColumn("shift", stable(F.col("shift"), 3))


def window_shifts(spark, folder):
    s = V.window_shifts(_wide(spark, folder), _t(spark, folder, "log_events"), _t(spark, folder, "recordings"), SYNC_SPIKE, SYNC_APART_US)
    return s.withColumn("shift", stable(F.col("shift"), 3))


def shifted_markers(spark, folder):
    m = V.shift_markers(_t(spark, folder, "log_events"), window_shifts(spark, folder))
    return m.withColumn("start_time", stable(F.col("start_time"), 3)).withColumn("duration_s", stable(F.col("duration_s"), 3))


def annotations(spark, folder):
    a = V.annotations(_t(spark, folder, "recordings"), _t(spark, folder, "log_events"))
    return a.withColumn("onset_s", stable(F.col("onset_s"), 5)).withColumn("duration_s", stable(F.col("duration_s"), 5))


def log_bounds(spark, folder):
    return V.log_bounds(_t(spark, folder, "log_events"))


def _parsed(spark, folder):
    return L.parse_lines(L.to_lines(_t(spark, folder, "log_events")))


def parsed_lines(spark, folder):
    return L.attempts(_parsed(spark, folder)).select("log_key", "session", "line_no", "ts", "kind", "name", "phase", "attempt")


def paired_lines(spark, folder):
    return L.pair_lines(_parsed(spark, folder)).withColumn("duration", stable(F.col("duration"), 4))


def previous_lines(spark, folder):
    return L.previous_lines(L.to_lines(_t(spark, folder, "log_events"))).select("log_key", "session", "line_no", "previous")


def without_repeats(spark, folder):
    return L.without_repeats(_t(spark, folder, "log_events"))


def marker_classes(spark, folder):
    return L.classes(_t(spark, folder, "log_events"))


def event_classes(spark, folder):
    return L.event_classes(_t(spark, folder, "log_events"))


def metadata_entries(spark, folder):
    return L.metadata_entries(_t(spark, folder, "log_events"))


def metadata_values(spark, folder):
    return L.metadata_values(_t(spark, folder, "log_events"))


def ordered_log(spark, folder):
    return L.in_order(L.structured(_t(spark, folder, "log_events"))).withColumn("ts", stable(F.col("ts"), 4))


def accuracies(spark, folder):
    return L.accuracies(L.with_value_lines(_t(spark, folder, "log_events")))


def sync_event_shifts(spark, folder):
    """By how much each sync event is moved: its shifted start less its own."""
    log = _t(spark, folder, "log_events").where(F.col("category") == "Sync Events").select("row_id", F.col("start_time").alias("own"))
    return shifted_markers(spark, folder).join(log, "row_id").select("row_id", "marker", stable(F.col("start_time") - F.col("own"), 2).alias("moved"))


def averages_with_events(spark, folder):
    return C.with_representatives(average_over_users(spark, folder), representative_events(spark, folder))


def user_means(spark, folder):
    return C.user_means(_features(spark, folder)).withColumn("mean", stable(F.col("mean")))


def participant_pairs(spark, folder):
    p = C.participant_pairs(C.user_means(_features(spark, folder)))
    return p.withColumns({c: stable(F.col(c)) for c in ("first", "second")})


def trial_spans(spark, folder):
    return L.trial_spans(_t(spark, folder, "log_events"), 3)


def follow_on(spark, folder):
    return L.follow_on(_t(spark, folder, "log_events"), "Rest Events")


def set_spans(spark, folder):
    return L.set_spans(_t(spark, folder, "log_events"))


def yoga_schedule(spark, folder):
    return L.follow_on(_t(spark, folder, "log_events"), "Yoga Poses")


def average_over_users(spark, folder):
    a = C.average_over_users(_merged(spark, folder))
    return a.withColumns({m: stable(F.col(m)) for m in C.MEASURES})


def representative_events(spark, folder):
    m = _merged(spark, folder).withColumn("phase", C.phase()).where(F.col("session").isNotNull())
    return C.most_frequent(m, ["session", "phase"], "event_name", "feature_id")


def padded_average(spark, folder):
    return C.padded_average(_features(spark, folder)).withColumn("mean", stable(F.col("mean"))).withColumn("std", stable(F.col("std"), 4))


def one_hot_categories(spark, folder):
    hot = C.one_hot(_t(spark, folder, "log_events"), "category", CATEGORIES)
    return hot.select("row_id", *[f"category_{c}" for c in CATEGORIES])


def category_indicators(spark, folder):
    """An indicator for every category that the log has."""
    hot = C.one_hot(_t(spark, folder, "log_events"), "category")
    return hot.select("row_id", *[f"`{c}`" for c in hot.columns if c.startswith("category_")])


def type_codes(spark, folder):
    return C.codes(_t(spark, folder, "stream_events"), "event_type", "event_row_id").select("event_row_id", "code")


def indicator_correlations(spark, folder):
    return C.indicator_correlations(_merged(spark, folder)).withColumn("r", stable(F.col("r")))


def cross_stream_correlations(spark, folder):
    return C.cross_stream_correlations(_features(spark, folder)).withColumn("r", stable(F.col("r"), 5))


def series_report(spark, folder):
    s = _t(spark, folder, "signal_long").groupBy(entity_key("stream_id").alias("sid"), "session", "channel", "pos").agg(F.min("ts").alias("ts"), F.min("value").alias("value"))
    return validate.series_report(s)


def structured_log(spark, folder):
    return L.structured(_t(spark, folder, "log_events")).withColumn("ts", stable(F.col("ts"), 4))


def form_answers(spark, folder):
    return L.form_answers(_t(spark, folder, "log_events"))


def event_durations(spark, folder):
    return L.durations(_t(spark, folder, "log_events")).withColumn("duration", stable(F.col("duration"), 4))


def stream_owners(spark, folder):
    return K.stream_owners(_t(spark, folder, "recordings"))


def streams_per_user(spark, folder):
    return K.streams_per_user(_t(spark, folder, "recordings"))


QUERIES = {f.__name__: f for f in (equal_merge, covering_merge, enriched_events, spike_bounds, spaced_spikes, sync_markers, sync_shifts, window_shifts, shifted_markers, annotations, log_bounds, parsed_lines, paired_lines, previous_lines, without_repeats, marker_classes, event_classes, metadata_entries, trial_spans, set_spans, metadata_values, ordered_log, accuracies, sync_event_shifts, averages_with_events, user_means, participant_pairs, follow_on, yoga_schedule, average_over_users, representative_events, padded_average, one_hot_categories, category_indicators, type_codes, indicator_correlations, cross_stream_correlations, series_report, structured_log, form_answers, event_durations, stream_owners, streams_per_user)}


def _r(x: str, digits: int = 6) -> str:
    return f"round({x} + {10.0 ** -(digits + 3)!r}, {digits}) + 0.0"


_MERGED = """f as (select *, lower(trim(stream_id)) as sid from feature_rows),
cover as (select lower(trim(stream_id)) as sid, event_id, event_row_id, event_name, event_type, event_duration, metadata, unnest(range(event_id, event_id + greatest(coalesce(cast(floor(event_duration / 5) as bigint), 0), 0) + 1)) as epoch from stream_events where event_id is not null),
win as (select sid, epoch, arg_max(struct_pack(n := event_name, t := event_type, d := event_duration, m := metadata), (event_id, event_row_id)) as e from cover group by 1, 2),
merged as (select f.*, e.n as event_name, e.t as event_type, e.d as event_duration, e.m as metadata from f left join win using (sid, epoch))"""
_WIDE = """sig as (select lower(trim(stream_id)) as sid, session, channel, pos, min(ts) as ts, min(case when isnan(value) or isinf(value) then null else value end) as value from signal_long where modality = 'ACC' and pos is not null group by 1, 2, 3, 4),
w as (select sid, session, pos, min(ts) as ts, max(case when channel = 'X' then value end) as x, max(case when channel = 'Y' then value end) as y, max(case when channel = 'Z' then value end) as z from sig group by 1, 2, 3),
mag as (select *, sqrt(x*x + y*y + z*z) as mag from w)"""
_SPIKES = f"""{_WIDE}, l as (select sid, session, list_sort(list(distinct epoch_us(ts))) as l from mag where mag > {SPIKE} and ts is not null group by 1, 2),
sp as (select sid, session, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: if(x[1] - acc[-1] > {APART_US}, list_concat(acc, x), acc))) as t from l)"""
_SYNC = "sm as (select * from (select log_key, session, row_number() over (partition by log_key, session order by start_time, row_id) as n, start_time from log_events where log_key is not null and start_time is not null and lower(marker) like '%sync%' and lower(marker) not like '%instr%') where n <= 2)"
_SHIFTS = f"""{_WIDE}, sy as (select log_key, session, row_number() over (partition by log_key, session order by start_time, row_id) as n, start_time, case when end_time > start_time then (end_time - start_time) / 2 end as half from log_events where log_key is not null and start_time is not null and lower(marker) like '%sync%' and lower(marker) not like '%instr%'),
st as (select distinct sid, session, log_key, start_time, half from (select lower(trim(stream_id)) as sid, session, log_key from recordings) join sy using (log_key, session) join (select distinct sid, session from w) using (sid, session) where n = 2),
l as (select sid, session, list_sort(list(distinct epoch_us(ts))) as l from mag join st using (sid, session) where mag > 12 and epoch_us(ts) / 1e6 between start_time - half and start_time + half group by 1, 2),
sp as (select sid, session, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: if(x[1] - acc[-1] > 1000000, list_concat(acc, x), acc))) as t from l),
sh as (select st.sid, st.session, st.log_key, {_r("coalesce(avg(t / 1e6 - start_time), 0)", 3)} as shift from st left join sp using (sid, session) group by 1, 2, 3)"""
_LINES = r"""lines as (select log_key, session, row_id * 2 + n as line_no, case when n = 0 then start_time else end_time end as ts,
 case category when 'Trial Sets' then 'block_trial' when 'Zero Score Trials' then 'block_trial' when 'Sync Events' then 'block_sync' when 'Rest Events' then 'block_rest' when 'Accuracy Events' then 'block_acc' when 'Instruction Events' then 'block_instr' else 'block_info' end as kind,
 marker, case when n = 0 then 'started' else 'ended' end as phase from log_events, (values (0), (1)) v(n) where log_key is not null and marker is not null and case when n = 0 then start_time else end_time end is not null),
parsed as (select *, case when regexp_extract(marker, '_(\d+)$', 1) <> '' then concat(regexp_replace(marker, '\d+$', ''), cast(regexp_extract(marker, '_(\d+)$', 1) as bigint) + 1) else marker end as name from lines),
tried as (select *, count(*) filter (phase = 'started') over (partition by log_key, session, name order by line_no rows unbounded preceding) as attempt from parsed)"""
_DURATION = _r("min(ts) filter (phase = 'ended') - min(ts) filter (phase = 'started')", 4)
_NORM = r"regexp_replace(lower(trim(marker)), '[\s-]', '_', 'g')"
_ENTRIES = "select row_id, j.key, j.value->>'$' as value from (select row_id, replace(metadata, '''', '\"') as m from log_events where json_valid(replace(metadata, '''', '\"')) and trim(metadata) like '{%') t, json_each(t.m) j"
_OWNERS = r"""with g as (select lower(trim(stream_id)) as sid, session, min(log_key) as log_key from recordings group by 1, 2),
o as (select sid, session, case when upper(sid) like '%EEG%' then 'EEG' when upper(sid) like '%PPG%' then 'PPG' when upper(sid) like '%ACC%' then 'ACC' when upper(sid) like '%GYRO%' then 'GYRO' when upper(sid) like '%BVP%' then 'BVP' when upper(sid) like '%TEMP%' then 'TEMP' when upper(sid) like '%GSR%' then 'GSR' end as modality,
 case when sid like '%muse%' then 'head' when regexp_matches(sid, '[0-9]') then 'wrist' else 'unknown' end as location, log_key, try_cast(nullif(regexp_extract(split_part(log_key, '_', 1), '(\d+)$', 1), '') as bigint) as user_id from g)
"""
_MEAN5 = ", ".join(_r(f"avg({m})") + f" as {m}" for m in C.MEASURES)
SQL = {
    "equal_merge": "select feature_id, event_row_id, event_name from feature_rows f join stream_events e on lower(trim(f.stream_id)) = lower(trim(e.stream_id)) and f.epoch = e.event_id",
    "covering_merge": f"with {_MERGED} select feature_id, event_name, event_type, event_duration, metadata from merged",
    "enriched_events": """with d as (select *, unnest(list_distinct(list_filter([split_part(lower(log_key), '_', 2), split_part(lower(log_key), '_', 3)], lambda x: x <> ''))) as device from log_events where log_key is not null and marker is not null),
l as (select device, marker, min(row_id) as log_row_id from d group by 1, 2),
e as (select event_row_id, event_name, case when lower(trim(stream_id)) like 'muses-%' then concat('m', substr(split_part(lower(trim(stream_id)), '_', 1), 7)) else concat('e', split_part(lower(trim(stream_id)), '_', 1)) end as device from stream_events)
select event_row_id, event_name, log_row_id, category, metadata as log_metadata from e left join l on e.device = l.device and event_name = l.marker left join log_events g on g.row_id = log_row_id""",
    "spike_bounds": f"with {_WIDE} select sid, session, min(pos) as first_pos, max(pos) as last_pos from mag where mag > {SPIKE} group by 1, 2",
    "spaced_spikes": f"with {_SPIKES} select sid, session, t from sp",
    "sync_markers": f"with {_SYNC} select * from sm",
    "sync_shifts": f"""with {_SPIKES}, {_SYNC}, st as (select distinct lower(trim(stream_id)) as sid, session, start_time from recordings join sm using (log_key, session) where n = 2)
select st.sid, st.session, {_r(f"coalesce(avg(case when abs(t / 1e6 - start_time) <= {AROUND_S} then t / 1e6 - start_time end), 0)", 3)} as shift from st left join sp using (sid, session) group by 1, 2""",
    "window_shifts": f"with {_SHIFTS} select * from sh",
    "shifted_markers": f"""with {_SHIFTS}, one as (select log_key, session, arg_max(shift, sid) as shift from sh group by 1, 2)
select row_id, log_key, session, marker, category, {_r("start_time - case when category = 'Yoga Poses' then 120 else 0 end + coalesce(shift, 0)", 3)} as start_time, {_r("end_time - start_time", 3)} as duration_s from log_events left join one using (log_key, session) where log_key is not null and start_time is not null""",
    "annotations": f"select lower(trim(stream_id)) as sid, session, row_id, marker, {_r('start_time - epoch_us(rec_start) / 1e6', 5)} as onset_s, {_r('end_time - start_time', 5)} as duration_s from log_events join recordings using (log_key, session) where start_time between epoch_us(rec_start) / 1e6 and epoch_us(rec_end) / 1e6",
    "log_bounds": "select log_key, session, min(start_time) as first_start, max(end_time) as last_end from log_events where log_key is not null group by 1, 2",
    "parsed_lines": f"with {_LINES} select log_key, session, line_no, ts, kind, name, phase, attempt from tried",
    "paired_lines": f"with {_LINES} select log_key, session, name, attempt, min(ts) filter (phase = 'started') as start_time, min(ts) filter (phase = 'ended') as end_time, {_DURATION} as duration from tried group by 1, 2, 3, 4",
    "previous_lines": f"with {_LINES} select log_key, session, line_no, lag(concat(kind, ': ', marker, ' ', phase)) over (partition by log_key, session order by line_no) as previous from lines",
    "without_repeats": "select log_key, session, marker, start_time, end_time, arg_min(row_id, (coalesce(contains(metadata, 'duration'), false), row_id)) as row_id from log_events group by 1, 2, 3, 4, 5",
    "marker_classes": " union all ".join(f"select row_id, '{c}' as class from log_events where regexp_matches({_NORM}, '{p}')" for c, p in L.CLASSES.items()),
    "event_classes": r"""with k as (select row_id, regexp_replace(lower(trim(coalesce(marker, ''))), '[\s-]', '_', 'g') as m, try_cast(nullif(regexp_extract(metadata, '[''"]score[''"]\s*:\s*[''"]?(-?[0-9.]+)', 1), '') as double) as score from log_events),
c as (select row_id, unnest([case when regexp_matches(m, 'trial_[0-9]+_set') then 'Trial Sets' end, case when contains(m, 'acc') then 'Accuracy Events' end, case when contains(m, 'instr') then 'Instruction Events' end, case when score = 0 then 'Zero Score Trials' end,
 case when contains(m, 'sync') and not contains(m, 'instr') then 'Sync Events' end, case when contains(m, 'rest') and not contains(m, 'instr') then 'Rest Events' end,
 case when contains(m, 'instr') then null when contains(m, 'brums') then 'BRUMS' when contains(m, 'sss') then 'SSS' when contains(m, 'vasf') then 'VASF' when contains(m, 'likert') then 'LIKERT' end]) as class from k)
select * from c where class is not null""",
    "metadata_entries": _ENTRIES,
    "metadata_values": _ENTRIES + r""" union all select row_id, 'raw_metadata', metadata from log_events where trim(metadata) <> '' and not (trim(metadata) like '{%' and json_valid(replace(metadata, '''', '"')))""",
    "ordered_log": f"select log_key, session, row_id, marker, phase, {_r('ts', 4)} as ts from (select log_key, session, row_id, marker, 'started' as phase, start_time as ts from log_events union all select log_key, session, row_id, marker, 'ended', end_time - 0.1 from log_events) where log_key is not null and ts is not null",
    "accuracies": r"""with k as (select *, case category when 'Trial Sets' then 'block_trial' when 'Zero Score Trials' then 'block_trial' when 'Sync Events' then 'block_sync' when 'Rest Events' then 'block_rest' when 'Accuracy Events' then 'block_acc' when 'Instruction Events' then 'block_instr' else 'block_info' end as kind,
 nullif(regexp_extract(metadata, '["'']accuracy["'']\s*:\s*["'']?([^"'',}]+)', 1), '') as said from log_events where log_key is not null and marker is not null),
l as (select log_key, session, row_id * 3 as line_no, kind || ': ' || marker || ' started' as content, null as name from k where start_time is not null union all select log_key, session, row_id * 3 + 1, said || '%', null from k where end_time is not null and said is not null
 union all select log_key, session, row_id * 3 + 2, kind || ': ' || marker || ' ended', case when regexp_extract(marker, '_(\d+)$', 1) <> '' then concat(regexp_replace(marker, '\d+$', ''), cast(regexp_extract(marker, '_(\d+)$', 1) as bigint) + 1) else marker end from k where end_time is not null),
p as (select *, lag(content) over (partition by log_key, session order by line_no) as before from l)
select log_key, session, line_no, name, try_cast(regexp_replace(trim(before), '\s*%$', '') as double) as accuracy from p where content like '% ended'""",
    "sync_event_shifts": f"""with {_SHIFTS}, one as (select log_key, session, arg_max(shift, sid) as shift from sh group by 1, 2) select row_id, marker, {_r("round(start_time + coalesce(shift, 0) + 1e-6, 3) - start_time", 2)} as moved from log_events left join one using (log_key, session) where log_key is not null and start_time is not null and category = 'Sync Events'""",
    "averages_with_events": f"""with {_MERGED}, ph as (select *, case when event_type = 'Yoga Poses' then 'Yoga Phase' else 'Cognitive Load Phase' end as phase from merged where session is not null),
av as (select epoch, session, phase, {_MEAN5} from ph where epoch is not null group by 1, 2, 3), n as (select session, phase, event_name, count(event_name) as n, min(feature_id) as first from ph group by 1, 2, 3),
rp as (select session, phase, case when max(n) > 0 then arg_max(coalesce(event_name, ''), (n, -first)) else 'No Event' end as event_name from n group by 1, 2) select * from av join rp using (session, phase)""",
    "user_means": f"select user_id, session, epoch, {_r('avg(v)')} as mean, count(v) as n from (select *, case when isnan(mean_value) or isinf(mean_value) then null else mean_value end as v from feature_rows) where user_id >= 1 and session >= 1 and epoch >= 0 group by 1, 2, 3",
    "participant_pairs": f"with m as (select user_id, session, epoch, avg(case when isnan(mean_value) or isinf(mean_value) then null else mean_value end) as mean from feature_rows where user_id >= 1 and session >= 1 and epoch >= 0 group by 1, 2, 3) select (user_id + 1) // 2 as pair, session, epoch, {_r('max(mean) filter (user_id % 2 = 1)')} as first, {_r('max(mean) filter (user_id % 2 = 0)')} as second from m group by 1, 2, 3",
    "trial_spans": rf"""with t as (select log_key, session, row_id, start_time, end_time, regexp_extract({_NORM}, '^(\w+?)_trial_(\d+)_set_(\d+)$', ['task', 'trial', 'set']) as p from log_events where log_key is not null and start_time is not null),
u as (select *, p.task as task, p.trial as trial, p.set as set from t where p.trial <> ''),
n as (select *, max(case when trial = '1' then row_id end) over (partition by log_key, session, task, set order by row_id rows between unbounded preceding and 1 preceding) as open_row from u)
select n.log_key, n.session, n.task, n.set, n.open_row, n.row_id as close_row, o.start_time, n.end_time from n join log_events o on o.row_id = n.open_row where trial = '3'""",
    "follow_on": """with k as (select * from log_events where log_key is not null), b as (select log_key, session, max(cast(round(end_time * 1000) as bigint)) as last from k group by 1, 2),
e as (select log_key, session, row_id, marker, greatest(coalesce(cast(round(end_time * 1000) as bigint) - cast(round(start_time * 1000) as bigint), 0), 0) as ms from k where category = 'Rest Events'),
r as (select *, cast(sum(ms) over (partition by log_key, session order by row_id) as bigint) as upto, row_number() over (partition by log_key, session, marker order by row_id) as occurrence from e)
select log_key, session, row_id, marker, occurrence, last + 300000 + upto - ms as start_ms, last + 300000 + upto as end_ms from r join b using (log_key, session)""",
    "average_over_users": f"with {_MERGED} select epoch, session, case when event_type = 'Yoga Poses' then 'Yoga Phase' else 'Cognitive Load Phase' end as phase, {_MEAN5} from merged where epoch is not null and session is not null group by 1, 2, 3",
    "representative_events": f"""with {_MERGED}, n as (select session, case when event_type = 'Yoga Poses' then 'Yoga Phase' else 'Cognitive Load Phase' end as phase, event_name, count(event_name) as n, min(feature_id) as first from merged where session is not null group by 1, 2, 3)
select session, phase, case when max(n) > 0 then arg_max(coalesce(event_name, ''), (n, -first)) else 'No Event' end as event_name from n group by 1, 2""",
    "padded_average": f"""with v as (select session, lower(trim(stream_id)) as sid, epoch, avg(case when isnan(mean_value) or isinf(mean_value) then null else mean_value end) as v from feature_rows where session >= 1 and epoch >= 0 group by 1, 2, 3),
h as (select session, count(distinct sid) as streams, max(epoch) + 1 - 20 as horizon from v group by 1), s as (select session, epoch, coalesce(sum(v), 0) as s, coalesce(sum(v * v), 0) as q from v group by 1, 2)
select session, epoch, {_r('s / streams')} as mean, {_r('sqrt(greatest(q / streams - (s / streams) * (s / streams), 0))', 4)} as std from s join h using (session) where epoch < horizon""",
    "one_hot_categories": "select row_id, " + ", ".join(f"coalesce(cast(category = '{c}' as int), 0) as \"category_{c}\"" for c in CATEGORIES) + " from log_events",
    "type_codes": "with f as (select event_type, dense_rank() over (order by min(event_row_id)) - 1 as code from stream_events where event_type is not null group by 1) select event_row_id, coalesce(code, -1) as code from stream_events left join f using (event_type)",
    "indicator_correlations": f"""with {_MERGED}, x as ({' union all '.join(f"select event_type as indicator, '{m}' as feature, {m} as x from merged where {m} is not null and not isnan({m})" for m in C.MEASURES)}),
p as (select feature, indicator, cast(count(*) as double) as k, sum(x) as s, sum(x * x) as q from x group by 1, 2), a as (select feature, sum(k) as n, sum(s) as sx, sum(q) as qx from p group by 1)
select feature, indicator, {_r('(n * s - sx * k) / nullif(sqrt((n * qx - sx * sx) * (n * k - k * k)), 0)')} as r from p join a using (feature) where indicator is not null and nullif(sqrt((n * qx - sx * sx) * (n * k - k * k)), 0) is not null""",
    "cross_stream_correlations": f"""with v as (select lower(trim(stream_id)) as sid, session, epoch, avg(case when isnan(mean_value) or isinf(mean_value) then null else mean_value end) as v from feature_rows where session >= 1 and epoch >= 0 group by 1, 2, 3)
select a.sid, b.sid as other, count(*) as epochs, {_r('covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0)', 5)} as r from v a join v b on split_part(a.sid, '_', 1) = split_part(b.sid, '_', 1) and a.session = b.session and a.epoch = b.epoch and a.sid <> b.sid where a.v is not null and b.v is not null group by 1, 2""",
    "structured_log": f"select log_key, session, row_id, marker, phase, {_r('ts', 4)} as ts from (select log_key, session, row_id, marker, 'started' as phase, start_time as ts from log_events union all select log_key, session, row_id, marker, 'ended', end_time - 0.1 from log_events) where log_key is not null and ts is not null",
    "form_answers": f"with e as ({_ENTRIES}) select row_id, upper(trim(category)) as form, key as question, value as answer from e join log_events using (row_id) where key like '%?%' and upper(trim(category)) in ('BRUMS', 'SSS', 'VASF', 'LIKERT')",
    "event_durations": f"with e as (select row_id, min(try_cast(value as double)) as said from ({_ENTRIES}) where key = 'duration' group by 1) select row_id, {_r('coalesce(said, end_time - start_time)', 4)} as duration from log_events left join e using (row_id)",
    "stream_owners": _OWNERS + "select * from o",
    "streams_per_user": _OWNERS + "select user_id, modality, count(distinct sid) as streams, count(distinct session) as sessions, count(*) as recordings from o group by 1, 2",
    "series_report": """with s as (select lower(trim(stream_id)) as sid, session, channel, pos, min(ts) as ts, min(value) as value from signal_long group by 1, 2, 3, 4),
n as (select *, last_value(ts ignore nulls) over (partition by sid, session, channel order by pos rows between unbounded preceding and 1 preceding) as p from s)
select sid, session, channel, count(*) as rows, count(*) filter (value is null or isnan(value)) as missing, count(*) filter (isinf(value)) as infinite, count(*) filter (ts is null) as no_time, count(*) filter (ts <= p) as not_after from n group by 1, 2, 3""",
}
SQL["yoga_schedule"] = SQL["follow_on"].replace("'Rest Events'", "'Yoga Poses'")
SQL["set_spans"] = rf"""with t as (select log_key, session, row_id, start_time, end_time, regexp_extract({_NORM}, '^(\w+?)_trial_(\d+)_set_(\d+)$', ['task', 'trial', 'set']) as p from log_events where log_key is not null and start_time is not null),
u as (select *, p.task as task, p.trial as trial, p.set as set from t where p.trial = '1' or p.trial = case p.task when 'final_test' then '60' else '20' end),
n as (select *, lag(trial) over w as before, lag(row_id) over w as open_row, lag(start_time) over w as opened from u window w as (partition by log_key, session, task, set order by row_id))
select log_key, session, task, set, open_row, row_id as close_row, opened as start_time, end_time from n where trial <> '1' and before = '1'"""
