"""Queries on recordings: regular grids and implausible readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.columns import stable
from pulsegrid.operators.grid_fill import empty_slots, grid_fill, held_out
from pulsegrid.operators.spikes import PERIODS, cutoff_report, flag_readings
from pulsegrid.session import table


def grid(spark: SparkSession, folder: str) -> DataFrame:
    return grid_fill(table(spark, folder, "signal_long"), table(spark, folder, "recordings"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Empty slots of the grid of every EEG, ACC and PPG channel."""
    return empty_slots(grid(spark, folder))


def p1_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The whole regular series, filled and marked."""
    return grid(spark, folder)


def p1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Slots per channel and recording by status."""
    g = grid(spark, folder)
    return g.groupBy("stream_id", "session", "channel").agg(F.count("*").alias("slots"), F.count_if(F.col("status") == "observed").alias("observed"), F.count_if(F.col("status") != "observed").alias("empty"))


def p1_error(spark: SparkSession, folder: str) -> DataFrame:
    """How well the factorisation fills cells that were read but hidden from it, per channel."""
    return held_out(table(spark, folder, "signal_long"), table(spark, folder, "recordings"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Impossible readings, stuck stretches and spikes of GSR, TEMP, BVP and AF7."""
    f = flag_readings(table(spark, folder, "signal_long"))
    return f.where(F.col("impossible") | F.col("stuck") | F.col("spike")).select("stream_id", "session", "channel", "pos")


def p2_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate with its reasons, excursion and tail cutoff."""
    f = flag_readings(table(spark, folder, "signal_long"))
    return f.select("stream_id", "session", "channel", "pos", "value", "impossible", "stuck", "spike", stable(F.col("score"), 4).alias("score"), stable(F.col("cutoff"), 4).alias("cutoff"))


def p2_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """The tail cutoff of each source in median steps, its candidates, and the spikes that it passed over."""
    r = cutoff_report(table(spark, folder, "signal_long"))
    return r.withColumn("cutoff", stable(F.col("cutoff"), 4))


QUERIES = {"p1_found": p1_found, "p1_grid": p1_grid, "p1_coverage": p1_coverage, "p1_error": p1_error, "p2_found": p2_found, "p2_flags": p2_flags, "p2_cutoffs": p2_cutoffs}

_GRID = """
with recs as (
  select distinct on (lower(trim(stream_id)), session) stream_id, session, epoch_us(rec_start) as s, step_us as w,
         (epoch_us(rec_end) - epoch_us(rec_start)) // step_us as n, upper(split_part(trim(stream_id), '_', -1)) as modality
  from recordings),
ch(modality, channel) as (values ('EEG','AF7'),('EEG','AF8'),('EEG','TP9'),('EEG','TP10'),('ACC','X'),('ACC','Y'),('ACC','Z'),('PPG','Ambient'),('PPG','IR'),('PPG','Red')),
cells as (select r.stream_id, r.session, ch.channel, unnest(range(0, n)) as slot from recs r join ch using (modality)),
seen as (
  select distinct r.stream_id, r.session, l.channel, (epoch_us(l.ts) - r.s) // r.w as slot
  from signal_long l join recs r on lower(trim(l.stream_id)) = lower(trim(r.stream_id)) and l.session = r.session
  where l.modality in ('EEG','ACC','PPG') and l.value is not null and not isnan(l.value) and epoch_us(l.ts) >= r.s)
"""


def _excursion(x: str) -> str:
    """How far a reading, alone or with one or two beside it, lies above or below both neighbours; {x}m3 to {x}n3 are those around {x}."""
    at = [f"{x}m{k}" for k in (3, 2, 1)] + [x] + [f"{x}n{k}" for k in (1, 2, 3)]
    cases = []
    for size in (1, 2, 3):
        for first in range(4 - size, 4):
            group, before, after = ", ".join(at[first : first + size]), at[first - 1], at[first + size]
            cases.append(f"case when {before} is not null and {after} is not null then greatest(least({group}) - greatest({before}, {after}), least({before}, {after}) - greatest({group})) end")
    return f"greatest(0, {', '.join(cases)})"


_AROUND = ", ".join(f"{f}({x}, {k}) over w as {x}{n}{k}" for x in ("v", "y") for f, n in (("lag", "m"), ("lead", "n")) for k in (1, 2, 3))
_TAILS = f"""
with lim(channel, lo, hi) as (values ('GSR', 0.01, 100.0), ('TEMP', 15.0, 43.0), ('BVP', -500.0, 500.0), ('AF7', -1000.0, 1000.0)),
r as (select min(stream_id) as stream_id, lower(trim(stream_id)) as sid, session, channel, pos, min(value) as v from signal_long where value is not null and not isnan(value) and pos is not null group by all),
a as (select r.*, v < lo or v > hi as bad from r join lim using (channel)),
brk as (select *, case when v = lag(v) over (partition by sid, session, channel order by pos) then 0 else 1 end as b from a),
runs as (select *, sum(b) over (partition by sid, session, channel order by pos) as run from brk),
st as (select *, count(*) over (partition by sid, session, channel, run) >= 12 as stuck from runs),
per as (select unnest({list(PERIODS)}) as period),
m as (select sid, session, channel, count(*) as n, avg(v) as mean, max(pos) - min(pos) + 1 as span from a where not bad group by all),
waves as (select a.sid, a.session, a.channel, period, (sum(v * cos(pos * (2 * pi() / period))) - any_value(mean) * sum(cos(pos * (2 * pi() / period)))) * 2 / any_value(n) as c, (sum(v * sin(pos * (2 * pi() / period))) - any_value(mean) * sum(sin(pos * (2 * pi() / period)))) * 2 / any_value(n) as s
  from a join m using (sid, session, channel) cross join per where not bad and span >= 2 * period group by all),
best as (select sid, session, channel, arg_max(struct_pack(period, c, s), c * c + s * s) as f from waves group by all),
y as (select a.*, v - coalesce(f.c * cos(pos * (2 * pi() / f.period)) + f.s * sin(pos * (2 * pi() / f.period)), 0) as y from a left join best using (sid, session, channel) where not bad),
c as (select *, abs(v - lag(v) over w) as step, {_AROUND} from y window w as (partition by sid, session, channel order by pos)),
u as (select sid, session, channel, median(step) as unit from c where step > 0 group by all),
e as (select c.*, unit, {_excursion('y')} as score, {_excursion('v')} as rise from c left join u using (sid, session, channel)),
hist as (select sid, session, channel, case when score > 0 then floor(log2(score) * 16) end as bin, count(*) as n from e group by all),
cum as (select *, sum(n) over (partition by sid, session, channel order by bin desc nulls last) as upto, sum(n) over (partition by sid, session, channel) as total from hist),
beg as (select sid, session, channel, coalesce(min(case when upto <= 0.1 * total then pow(2, bin / 16) end), max(pow(2, bin / 16))) as b from cum group by all),
t as (select sid, session, channel, any_value(unit) as unit, any_value(b) as b, cast(count(*) as double) as n, cast(count(*) filter (score > b) as double) as k, avg(ln(score / b)) filter (score > b) as l1, avg(ln(score / b) * ln(score / b)) filter (score > b) as l2 from e join beg using (sid, session, channel) group by all),
sh as (select *, l1 + 1 - 0.5 / (1 - l1 * l1 / nullif(l2, 0)) as shape, b * l1 * 0.5 / (1 - l1 * l1 / nullif(l2, 0)) as scale, k / (0.03 * n) as often from t),
cut as (select sid, session, channel, unit, n, k, case when k < 10 or often <= 1 or not l2 - l1 * l1 > 1e-9 then b when abs(shape) < 1e-6 then b + scale * ln(often) else b + scale / shape * (pow(often, shape) - 1) end as cutoff from sh),
j as (select st.stream_id, st.sid, st.session, st.channel, st.pos, st.v as value, st.bad as impossible, st.stuck, coalesce(e.score, 0) as score, cutoff, coalesce(e.score > cutoff, false) as beyond, coalesce(e.rise > 10 * cut.unit, false) as spike
  from st left join e on st.sid = e.sid and st.session = e.session and st.channel = e.channel and st.pos = e.pos left join cut on st.sid = cut.sid and st.session = cut.session and st.channel = cut.channel)
"""
SQL = {
    "p2_flags": _TAILS + "select stream_id, session, channel, pos, value, impossible, stuck, spike, round(score + 1e-7, 4) + 0.0 as score, round(cutoff + 1e-7, 4) + 0.0 as cutoff from j where impossible or stuck or beyond",
    "p2_cutoffs": _TAILS
    + """select cut.sid, cut.session, cut.channel, cast(any_value(n) as bigint) as readings, cast(any_value(k) as bigint) as peaks, round(any_value(cut.cutoff / unit) + 1e-7, 4) + 0.0 as cutoff, count(*) filter (beyond) as candidates,
  count(*) filter (beyond and spike) as spikes, count(*) filter (spike and not beyond) as missed from cut join j on cut.sid = j.sid and cut.session = j.session and cut.channel = j.channel group by all""",
    "p1_found": _GRID + "select c.stream_id, c.session, c.channel, c.slot from cells c anti join seen s using (stream_id, session, channel, slot)",
    "p1_coverage": _GRID
    + """select c.stream_id, c.session, c.channel, count(*) as slots, count(s.slot) as observed, count(*) - count(s.slot) as empty
from cells c left join seen s on c.stream_id = s.stream_id and c.session = s.session and c.channel = s.channel and c.slot = s.slot group by all""",
    "p2_found": """
with lim(channel, lo, hi) as (values ('GSR', 0.01, 100.0), ('TEMP', 15.0, 43.0), ('BVP', -500.0, 500.0), ('AF7', -1000.0, 1000.0)),
r as (select stream_id, lower(trim(stream_id)) as sid, session, channel, pos, min(value) as v from signal_long where value is not null and not isnan(value) and pos is not null group by all),
a as (select r.*, v < lo or v > hi as bad from r join lim using (channel)),
brk as (select *, case when v = lag(v) over (partition by sid, session, channel order by pos) then 0 else 1 end as b from a),
runs as (select *, sum(b) over (partition by sid, session, channel order by pos) as run from brk),
stuck as (select stream_id, session, channel, pos, count(*) over (partition by sid, session, channel, run) >= 12 as stuck, bad from runs),
c as (select *, abs(v - lag(v) over w) as step, lag(v,1) over w as m1, lag(v,2) over w as m2, lag(v,3) over w as m3, lead(v,1) over w as n1, lead(v,2) over w as n2, lead(v,3) over w as n3
      from a where not bad window w as (partition by sid, session, channel order by pos)),
u as (select sid, session, channel, median(step) as unit from c where step > 0 group by all),
e as (select c.stream_id, c.session, c.channel, c.pos, 10 * unit as lim,
        greatest(
          greatest(v - greatest(m1, n1), least(m1, n1) - v),
          greatest(least(v, n1) - greatest(m1, n2), least(m1, n2) - greatest(v, n1)),
          greatest(least(m1, v) - greatest(m2, n1), least(m2, n1) - greatest(m1, v)),
          greatest(least(v, n1, n2) - greatest(m1, n3), least(m1, n3) - greatest(v, n1, n2)),
          greatest(least(m1, v, n1) - greatest(m2, n2), least(m2, n2) - greatest(m1, v, n1)),
          greatest(least(m2, m1, v) - greatest(m3, n1), least(m3, n1) - greatest(m2, m1, v))) as x,
        (m1 is not null and n1 is not null and (v - greatest(m1, n1) > 10 * unit or least(m1, n1) - v > 10 * unit))
        or (m1 is not null and n2 is not null and (least(v, n1) - greatest(m1, n2) > 10 * unit or least(m1, n2) - greatest(v, n1) > 10 * unit))
        or (m2 is not null and n1 is not null and (least(m1, v) - greatest(m2, n1) > 10 * unit or least(m2, n1) - greatest(m1, v) > 10 * unit))
        or (m1 is not null and n3 is not null and (least(v, n1, n2) - greatest(m1, n3) > 10 * unit or least(m1, n3) - greatest(v, n1, n2) > 10 * unit))
        or (m2 is not null and n2 is not null and (least(m1, v, n1) - greatest(m2, n2) > 10 * unit or least(m2, n2) - greatest(m1, v, n1) > 10 * unit))
        or (m3 is not null and n1 is not null and (least(m2, m1, v) - greatest(m3, n1) > 10 * unit or least(m3, n1) - greatest(m2, m1, v) > 10 * unit)) as spike
      from c join u on c.sid = u.sid and c.session = u.session and c.channel = u.channel)
select stream_id, session, channel, pos from stuck where stuck or bad
union
select stream_id, session, channel, pos from e where spike""",
}
