"""Queries on raw log lines with their bodies: results of trials, answers in forms, lines before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.operators import log_bodies as B
from pulsegrid.plans.event_queries import SQL as EVENT_SQL
from pulsegrid.session import table


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return B.written_lines(table(spark, folder, "log_events"))


def written_lines(spark, folder):
    return _lines(spark, folder)


def lines_back(spark, folder):
    return B.look_back(_lines(spark, folder), [1, 3, 4]).select("log_key", "session", "line_no", "back_1", "back_3", "back_4")


def trial_results(spark, folder):
    return B.trial_results(_lines(spark, folder))


def form_bodies(spark, folder):
    return B.asked_items(B.form_bodies(_lines(spark, folder))).select("log_key", "session", "name", "attempt", "question", "answer", "form", "number", "item")


def kept_rows(spark, folder):
    return B.kept_rows(table(spark, folder, "log_events"))


QUERIES = {f.__name__: f for f in (written_lines, lines_back, trial_results, form_bodies, kept_rows)}

_LINES = rf"""with m as ({EVENT_SQL["metadata_values"]}),
e as (select *, case when category in ('Trial Sets', 'Zero Score Trials') then 'block_trial' when category = 'Sync Events' then 'block_sync' when category = 'Rest Events' then 'block_rest' when category = 'Accuracy Events' then 'block_acc' when category = 'Instruction Events' then 'block_instr'
  when category in ('BRUMS', 'SSS', 'VASF', 'LIKERT') then 'block_form' else 'block_info' end as kind,
  case when regexp_extract(marker, '_(\d+)$', 1) <> '' then concat(regexp_replace(marker, '\d+$', ''), cast(regexp_extract(marker, '_(\d+)$', 1) as bigint) + 1) else marker end as name from log_events where log_key is not null and session is not null and marker is not null),
r as (select log_key, session, row_id, kind, name, 0 as part, '' as key, '' as value, start_time as ts, kind || ': ' || marker || ' started' as content from e
  union all select log_key, session, row_id, null, null, 1, key, value, coalesce(start_time, end_time), case key when 'response' then 'block_resp: ' || value when 'score' then 'block_score: ' || value || '%' when 'accuracy' then 'accuracy: ' || value || '%' else key || ': ' || value end from e join m using (row_id)
  union all select log_key, session, row_id, kind, name, 2, '', '', end_time, kind || ': ' || marker || ' ended' from e),
lines as (select *, row_number() over (partition by log_key, session order by row_id, part, key, value) - 1 as line_no from r where ts is not null and content is not null)
"""


def _blocks(kind: str) -> str:
    """Lines of a block with their attempts, and for every line the lines of that block before and after it."""
    return f"""{_LINES}, t as (select *, count(*) filter (part = 0) over (partition by log_key, session, name order by line_no) as attempt from lines where kind = '{kind}'),
n as (select *, max(case when kind = '{kind}' then line_no end) over (partition by log_key, session order by line_no rows between unbounded preceding and 1 preceding) as p,
  min(case when kind = '{kind}' then line_no end) over (partition by log_key, session order by line_no rows between 1 following and unbounded following) as f from lines)
"""


_ITEMS = ", ".join(f"('{form}', {n}, '{item}')" for form, items in B.QUESTIONS.items() for n, item in enumerate(items, 1))
SQL = {
    "written_lines": _LINES + "select log_key, session, line_no, ts, content from lines",
    "lines_back": _LINES + "select log_key, session, line_no, lag(content) over w as back_1, lag(content, 3) over w as back_3, lag(content, 4) over w as back_4 from lines window w as (partition by log_key, session order by line_no)",
    "trial_results": _blocks("block_trial")
    + """, g as (select t.log_key, t.session, t.name, t.attempt, arg_max(n.value, n.line_no) filter (n.key = 'response') as response, arg_max(try_cast(n.value as double), n.line_no) filter (n.key = 'score') as score
  from n join t on t.log_key = n.log_key and t.session = n.session and t.line_no = n.p where n.part = 1 and n.key in ('response', 'score') and t.part = 0 group by all),
b as (select log_key, session, name, attempt, min(ts) filter (part = 0) as start_time, min(ts) filter (part = 2) as end_time from t group by all)
select * from b left join g using (log_key, session, name, attempt)""",
    "form_bodies": _blocks("block_form")
    + f""", q as (select t.log_key, t.session, t.name, t.attempt, trim(string_split(n.content, ': ')[1]) as question, arg_max(trim(string_split(n.content, ': ')[2]), n.line_no) as answer
  from n join t on t.log_key = n.log_key and t.session = n.session and t.line_no = n.p join t u on u.log_key = n.log_key and u.session = n.session and u.line_no = n.f
  where n.part = 1 and n.key not in ('response', 'score') and t.part = 0 and u.part = 2 and t.name = u.name group by all),
f as (select *, case when contains(upper(name), 'BRUMS') then 'BRUMS' when contains(upper(name), 'SSS') then 'SSS' when contains(upper(name), 'VASF') then 'VASF' when contains(upper(name), 'LIKERT') then 'LIKERT' end as form from q)
select f.*, number, item from f left join (values {_ITEMS}) i(form, number, item) on f.form = i.form and lower(trim(question)) in (lower(item), 'q' || number)""",
    "kept_rows": "select log_key, session, marker, start_time, end_time, arg_min(row_id, (metadata is null, coalesce(contains(metadata, 'duration'), false), row_id)) as row_id from log_events group by 1, 2, 3, 4, 5",
}
