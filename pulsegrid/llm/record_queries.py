"""Queries: events matched with feature rows by time, and survivors of duplicate log records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.columns import entity_key, micros, stable
from pulsegrid.llm.nearest_time import nearest_in_time
from pulsegrid.llm.survivor import claims, copies, precedence_records, surviving_records, survivors, truth_model
from pulsegrid.session import table, written

TOLERANCE_US = 2_000_000


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    events, feats = table(spark, folder, "stream_events"), table(spark, folder, "feature_rows")
    left = events.select(F.col("event_row_id").alias("lid"), entity_key("stream_id").alias("sid"), micros("ts").alias("t"))
    right = feats.select(F.col("feature_id").alias("rid"), entity_key("stream_id").alias("sid"), micros("ts").alias("t"))
    return nearest_in_time(left, right, TOLERANCE_US)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The feature row nearest in time to each event, at most two seconds away."""
    return _pairs(spark, folder).select(F.col("lid").alias("event_row_id"), F.col("rid").alias("feature_id"))


def p6_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with its name and duration, and the epoch it was paired with, if any."""
    pairs = _pairs(spark, folder).select(F.col("lid").alias("event_row_id"), F.col("rid").alias("feature_id"), F.col("d").alias("away_us"))
    events = table(spark, folder, "stream_events").select("event_row_id", "event_name", "event_duration")
    feats = table(spark, folder, "feature_rows").select("feature_id", "epoch")
    return events.join(pairs.join(feats, "feature_id"), "event_row_id", "left").select("event_row_id", "event_name", "event_duration", "feature_id", "epoch", "away_us")


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    return written(copies(table(spark, folder, "log_events"), table(spark, folder, "log_origins")), "copies")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The copy whose value survives, per group of duplicate log records and field."""
    return survivors(_copies(spark, folder)).select("group_id", "field", "row_id")


def p7_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per group, built from what the truth model holds for true."""
    return surviving_records(_copies(spark, folder))


def p7_precedence(spark: SparkSession, folder: str) -> DataFrame:
    """One record per group, each field whole from the copy that survives by precedence."""
    return precedence_records(_copies(spark, folder))


def p7_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Every fact of a group that the truth model holds for true."""
    facts, _ = truth_model(claims(_copies(spark, folder)))
    return facts.where(F.col("p_true") >= 0.5).withColumn("p_true", stable(F.col("p_true"), 3))


def p7_origins(spark: SparkSession, folder: str) -> DataFrame:
    """How far the truth model trusts each origin: its sensitivity and specificity."""
    _, quality = truth_model(claims(_copies(spark, folder)))
    rows = [(o, round(se + 1e-6, 3), round(sp + 1e-6, 3)) for o, (se, sp) in sorted(quality.items())]
    return spark.createDataFrame(rows, "origin string, sensitivity double, specificity double")


QUERIES = {"p6_found": p6_found, "p6_events": p6_events, "p7_found": p7_found, "p7_records": p7_records, "p7_precedence": p7_precedence, "p7_truth": p7_truth, "p7_origins": p7_origins}

_NEAR = """
with e as (select event_row_id, lower(trim(stream_id)) as sid, epoch_us(ts) as t from stream_events where ts is not null),
f as (select feature_id, lower(trim(stream_id)) as sid, epoch_us(ts) as t, epoch from feature_rows where ts is not null),
n as (select event_row_id, arg_min(feature_id, (abs(e.t - f.t), feature_id)) as feature_id, min(abs(e.t - f.t)) as away_us
  from e join f on e.sid = f.sid and f.t between e.t - 2000000 and e.t + 2000000 group by all)
"""
_COPIES = """
with x as (select *, regexp_replace(lower(trim(marker)), '[\\s-]', '_', 'g') as norm, cast(round(start_time * 1000) as bigint) as ms from log_events
  where log_key is not null and session is not null and marker is not null and start_time is not null),
y as (select *, case when ms - lag(ms) over w <= 500 then 0 else 1 end as cut from x window w as (partition by log_key, session, norm order by ms, row_id)),
z as (select *, sum(cut) over (partition by log_key, session, norm order by ms, row_id) as grp from y),
g as (select z.* exclude (end_time, category, metadata), case when end_time >= start_time then end_time end as end_time,
  case when regexp_replace(lower(category), '\\s', '', 'g') not in ('', 'n/a', '{}') then category end as category, case when regexp_replace(lower(metadata), '\\s', '', 'g') not in ('', 'n/a', '{}') then metadata end as metadata,
  coalesce(trust, 2147483647) as trust, min(row_id) over k as group_id, count(*) over k as copies from z left join log_origins using (origin) window k as (partition by log_key, session, norm, grp)),
c as (select *, (trust, -coalesce(epoch_us(recorded_at), -4611686018427387904), row_id) as rank from g where copies > 1)
"""
# the rounds of the model as a recursion over the qualities of the origins; votes are counted by pattern first
_TRUTH = (
    _COPIES.replace("with x as", "with recursive x as", 1).rstrip()
    + r""",
o as (select c.* exclude (origin), case when trust = 2147483647 then '(unlisted)' else origin end as origin from c),
e as (select group_id, row_id, origin, rank, 'end_time' as field, replace(format('{:,.1f}', end_time), ' ', '') as fact, cast(end_time as varchar) as said from o where end_time is not null
  union all select group_id, row_id, origin, rank, 'category', lower(trim(category)), trim(category) from o where category is not null
  union all select group_id, row_id, origin, rank, 'metadata', lower(regexp_replace(x, '["''\s]', '', 'g')), trim(x) from (select *, unnest(case when len(m) > 0 then m else [trim(metadata)] end) as x from (select *, regexp_extract_all(metadata, '["'']([^"'']+)["'']\s*:\s*(["''][^"'']*["'']|[^,}]*)', 0) as m from o where metadata is not null))),
cl as materialized (select group_id, field, fact, origin, row_id, rank, min(said) as said from e group by all),
vt as (select group_id, field, list_sort(list(distinct origin)) as voters from cl group by all),
fc as materialized (select group_id, field, fact, list_transform(voters, lambda v: struct_pack(origin := v, said := list_contains(yes, v))) as votes from (select group_id, field, fact, list(distinct origin) as yes from cl group by all) join vt using (group_id, field)),
pt as materialized (select row_number() over (order by votes) as id, votes, count(*) as n from fc group by votes),
pv as materialized (select id, n, unnest(votes, recursive := true) from pt),
em as (select 0 as round, origin, 0.8::double as se, 0.9::double as sp from (select distinct origin from pv)
  union all select round, origin, least(greatest((a + 0.8) / (b + 1), 1e-4), 1 - 1e-4), least(greatest((cc + 0.3 * (b + d) * 0.9) / (d + 0.3 * (b + d)), 1e-4), 1 - 1e-4)
  from (select round, origin, sum(case when said then n * p else 0 end) as a, sum(n * p) as b, sum(case when said then 0 else n * (1 - p) end) as cc, sum(n * (1 - p)) as d
    from (select em.round + 1 as round, pv.*, 1 / (1 + exp(-(ln(0.6 / 0.4) + sum(case when said then ln(se / (1 - sp)) else ln((1 - se) / sp) end) over (partition by id)))) as p from em join pv using (origin) where em.round < 200) group by round, origin)),
q as materialized (select * from em where round = 200),
pp as (select pt.votes, 1 / (1 + exp(-(ln(0.6 / 0.4) + sum(case when said then ln(se / (1 - sp)) else ln((1 - se) / sp) end)))) as p_true from pv join q using (origin) join pt using (id) group by pt.votes),
fact as (select group_id, field, fact, p_true from fc join pp using (votes))
"""
)
SQL = {
    "p7_truth": _TRUTH + "select group_id, field, fact, round(p_true + 1e-6, 3) + 0.0 as p_true from fact where p_true >= 0.5",
    "p7_origins": _TRUTH + "select origin, round(se + 1e-6, 3) + 0.0 as sensitivity, round(sp + 1e-6, 3) + 0.0 as specificity from q",
    "p7_records": _TRUTH
    + """, sp as (select group_id, field, fact, min(rank) as first, arg_min(said, rank) as said from cl group by all),
jd as (select group_id, field, arg_min(said, (-round(p_true, 6), first, fact)) as top, list(said order by fact) filter (round(p_true, 6) >= 0.5) as true_ones from fact join sp using (group_id, field, fact) group by all),
bt as (select group_id, cast(max(top) filter (field = 'end_time') as double) as end_time, max(top) filter (field = 'category') as category, max('{' || coalesce(array_to_string(true_ones, ', '), top) || '}') filter (field = 'metadata') as metadata from jd group by all),
bs as (select group_id, arg_min(log_key, rank) as log_key, arg_min(session, rank) as session, arg_min(marker, rank) as marker, arg_min(start_time, rank) as start_time, max(copies) as copies from c group by group_id)
select bs.group_id, log_key, session, marker, start_time, end_time, category, metadata, copies from bs left join bt using (group_id)""",
    "p6_found": _NEAR + "select event_row_id, feature_id from n",
    "p6_events": _NEAR + "select s.event_row_id, event_name, event_duration, n.feature_id, f.epoch, away_us from stream_events s left join n using (event_row_id) left join f on n.feature_id = f.feature_id",
    "p7_found": _COPIES
    + """select group_id, 'end_time' as field, arg_min(row_id, rank) as row_id from c where end_time is not null group by all
union all select group_id, 'category', arg_min(row_id, rank) from c where category is not null group by all
union all select group_id, 'metadata', arg_min(row_id, rank) from c where metadata is not null group by all""",
    "p7_precedence": _COPIES
    + """select group_id, arg_min(log_key, rank) as log_key, arg_min(session, rank) as session, arg_min(marker, rank) as marker, arg_min(start_time, rank) as start_time,
  arg_min(end_time, rank) filter (end_time is not null) as end_time, arg_min(category, rank) filter (category is not null) as category, arg_min(metadata, rank) filter (metadata is not null) as metadata, max(copies) as copies from c group by group_id""",
}
