"""Queries on feature rows, stream events and logs: fills, orphans, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.columns import entity_key, micros
from pulsegrid.operators.hot_deck import fills, hot_deck_fill
from pulsegrid.operators.intervals import periods_and_gaps
from pulsegrid.operators.orphans import by_period, orphans, references
from pulsegrid.session import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values filled from other rows of the same stream."""
    return fills(hot_deck_fill(table(spark, folder, "feature_rows"))).drop("donor")


def p3_donors(spark: SparkSession, folder: str) -> DataFrame:
    """The filled values of session and user_id with the row that gave each."""
    return fills(hot_deck_fill(table(spark, folder, "feature_rows"))).where(F.col("field") != "epoch")


def p3_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every feature row with its fields as far as known, fills marked."""
    return hot_deck_fill(table(spark, folder, "feature_rows")).drop("session_donor", "epoch_donor", "user_donor")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    feats, events = table(spark, folder, "feature_rows"), table(spark, folder, "stream_events")
    streams, users = table(spark, folder, "streams"), table(spark, folder, "user_mapping")
    stream = F.concat(F.lit("s:"), entity_key("stream_id"))
    user = F.when(F.col("user_id") >= 1, F.concat(F.lit("u:"), F.col("user_id")))
    refs = references(feats, "feature_rows", "feature_id", "stream_id", stream).unionAll(references(events, "stream_events", "event_row_id", "stream_id", stream)).unionAll(references(feats, "feature_rows", "feature_id", "user_id", user))
    parents = streams.select(stream.alias("key"), micros("registered_at").alias("start"), micros("retired_at").alias("end")).unionAll(users.select(F.concat(F.lit("u:"), F.col("user_id")).alias("key"), micros("enrolled_at"), micros("withdrawn_at")))
    return orphans(refs, parents)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """References to streams and users that were not there at the time."""
    return _orphans(spark, folder).select("tbl", "row_id", "field", "reason")


def p4_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, field, reason and month."""
    return by_period(_orphans(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous periods of each log and the gaps between them."""
    log = table(spark, folder, "log_events")
    s, e = F.col("start_time"), F.col("end_time")
    ms = log.where(~F.isnan(s) & ~F.isnan(e) & (e >= s)).select("log_key", "session", F.round(s * 1000).cast("bigint").alias("start_ms"), F.round(e * 1000).cast("bigint").alias("end_ms"))
    out = periods_and_gaps(ms, ["log_key", "session"], "start_ms", "end_ms", 1000)
    return out.withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


QUERIES = {"p3_found": p3_found, "p3_rows": p3_rows, "p3_donors": p3_donors, "p4_found": p4_found, "p4_by_month": p4_by_month, "p5_found": p5_found}

_FILL = """
with r as (select feature_id, lower(trim(stream_id)) as sid, case when session >= 1 then session end as s0, case when epoch >= 0 then epoch end as e0,
  case when user_id >= 1 then user_id end as u0, epoch_us(ts) as t from feature_rows),
near as (select a.feature_id, arg_min(b.s0, (abs(a.t - b.t), b.t, b.s0)) as s1 from r a join r b on a.sid = b.sid and b.s0 is not null and b.t between a.t - 60000000 and a.t + 60000000
  where a.s0 is null group by all),
s as (select r.*, coalesce(s0, s1) as s from r left join near using (feature_id)),
votes as (select sid, s, u0, count(*) as n from s where s is not null and u0 is not null group by all),
users as (select sid, s, arg_max(u0, n) as u1 from votes group by all having max(n) * 2 > sum(n)),
org as (select sid, s, min(t - 5000000 * e0) as o from s where s is not null and e0 is not null and t is not null group by all),
f as (select feature_id, s, s0, s0 is null and s is not null as sf, e0, case when e0 is null and t is not null and round((t - o) / 5000000.0) >= 0 then cast(round((t - o) / 5000000.0) as bigint) end as e1,
  u0, case when u0 is null then u1 end as u1 from s left join users using (sid, s) left join org using (sid, s))
"""
_ORPHANS = """
with refs as (select 'feature_rows' as tbl, feature_id as row_id, 'stream_id' as field, lower(trim(stream_id)) as k, ts from feature_rows where stream_id is not null
  union all select 'stream_events', event_row_id, 'stream_id', lower(trim(stream_id)), ts from stream_events where stream_id is not null
  union all select 'feature_rows', feature_id, 'user_id', cast(user_id as varchar), ts from feature_rows where user_id >= 1),
par as (select 'stream_id' as field, lower(trim(stream_id)) as k, registered_at as a, retired_at as z from streams union all select 'user_id', cast(user_id as varchar), enrolled_at, withdrawn_at from user_mapping),
j as (select tbl, row_id, refs.field, ts, case when par.k is null then 'missing' when a > ts then 'later' when z <= ts then 'deleted' end as reason from refs left join par on refs.field = par.field and refs.k = par.k)
"""
SQL = {
    "p3_found": _FILL
    + """select feature_id, 'session' as field, cast(s as varchar) as filled from f where sf
union all select feature_id, 'epoch', cast(e1 as varchar) from f where e1 is not null union all select feature_id, 'user_id', cast(u1 as varchar) from f where u1 is not null""",
    "p3_donors": _FILL.rstrip()
    + """,
giver as (select a.feature_id, arg_min(b.feature_id, (abs(a.t - b.t), b.t, b.s0, b.feature_id)) as g from r a join r b on a.sid = b.sid and b.s0 is not null and b.t between a.t - 60000000 and a.t + 60000000 where a.s0 is null group by all),
voter as (select sid, s, u0, min(feature_id) as g from s where s is not null and u0 is not null group by all)
select feature_id, 'session' as field, cast(s as varchar) as filled, g as donor from f join giver using (feature_id) where sf
union all select f.feature_id, 'user_id', cast(f.u1 as varchar), g from f join s using (feature_id) join voter on voter.sid = s.sid and voter.s = s.s and voter.u0 = f.u1 where f.u1 is not null""",
    "p3_rows": _FILL + "select feature_id, s as session, coalesce(e0, e1) as epoch, coalesce(u0, u1) as user_id, sf as session_filled, e1 is not null as epoch_filled, u1 is not null as user_filled from f",
    "p4_found": _ORPHANS + "select tbl, row_id, field, reason from j where reason is not null",
    "p4_by_month": _ORPHANS + "select tbl, field, reason, strftime(ts, '%Y-%m') as month, count(*) as refs from j where reason is not null group by all",
    "p5_found": """
with i as (select log_key, session, cast(round(start_time * 1000) as bigint) as a, cast(round(end_time * 1000) as bigint) as z from log_events where log_key is not null and end_time >= start_time and not isnan(start_time) and not isnan(end_time)),
m as (select *, max(z) over (partition by log_key, session order by a, z rows between unbounded preceding and 1 preceding) as reach from i),
g as (select *, sum(case when a <= reach + 1000 then 0 else 1 end) over (partition by log_key, session order by a, z rows unbounded preceding) as grp from m),
p as (select log_key, session, min(a) as start_ms, max(z) as end_ms from g group by log_key, session, grp)
select log_key, session, 'period' as kind, start_ms, end_ms from p
union all select * from (select log_key, session, 'gap', end_ms, lead(start_ms) over (partition by log_key, session order by start_ms) as n from p) where n is not null""",
}
