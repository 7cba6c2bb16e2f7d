"""Experiment logs: lines to typed rows, attempts, pairing, de-duplication, classes and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.ordered import with_neighbours, with_running_sum

#: Line kind of each category. Fixed values.
KINDS = {
    "Trial Sets": "block_trial",
    "Zero Score Trials": "block_trial",
    "Sync Events": "block_sync",
    "Rest Events": "block_rest",
    "Accuracy Events": "block_acc",
    "Instruction Events": "block_instr",
}
#: What a marker's text says of its class. Fixed values.
CLASSES = {
    "Trial Sets": "trial_[0-9]+_set",
    "Accuracy Events": "acc",
    "Sync Events": "sync",
    "Rest Events": "rest",
    "Instruction Events": "instr",
    "BRUMS": "brums",
    "SSS": "sss",
    "VASF": "vasf",
    "LIKERT": "likert",
}
LINE = r"^(block_\w+): (.*?)(?: (started|ended))?$"


def to_lines(log: DataFrame) -> DataFrame:
    """Log events as raw lines (log_key, session, line_no, ts, content), two to an event: started and ended."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("category")), F.lit("block_info"))
    ok = log.where(F.col("log_key").isNotNull() & F.col("marker").isNotNull())
    ends = F.array(F.struct(F.lit(0).alias("n"), F.col("start_time").alias("ts"), F.lit("started").alias("p")), F.struct(F.lit(1).alias("n"), F.col("end_time").alias("ts"), F.lit("ended").alias("p")))
    each = ok.select("log_key", "session", "row_id", "marker", kind.alias("kind"), F.inline(ends)).where(F.col("ts").isNotNull())
    return each.select("log_key", "session", (F.col("row_id") * 2 + F.col("n")).alias("line_no"), "ts", F.concat("kind", F.lit(": "), "marker", F.lit(" "), "p").alias("content"))


def one_based(name: Column) -> Column:
    """A name that ends in a number, with the number counted from one instead of zero."""
    n = F.regexp_extract(name, r"_(\d+)$", 1)
    return F.when(n != "", F.concat(F.regexp_replace(name, r"\d+$", ""), (n.try_cast("bigint") + 1).cast("string"))).otherwise(name)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines as (log_key, session, line_no, ts, kind, name, phase); lines of another form have a null kind."""
    c = F.col("content")
    kind = F.nullif(F.regexp_extract(c, LINE, 1), F.lit(""))
    return lines.select("log_key", "session", "line_no", "ts", kind.alias("kind"), F.when(kind.isNotNull(), one_based(F.regexp_extract(c, LINE, 2))).alias("name"), F.nullif(F.regexp_extract(c, LINE, 3), F.lit("")).alias("phase"))


def attempts(parsed: DataFrame) -> DataFrame:
    """Adds attempt: how often the name was started in its log up to this line."""
    return with_running_sum(parsed.where(F.col("name").isNotNull()), ["log_key", "session", "name"], "line_no", (F.col("phase") == "started").cast("bigint"), "attempt")


def pair_lines(parsed: DataFrame) -> DataFrame:
    """Start, end and duration of each attempt; null where a line is missing."""
    at = lambda p: F.min(F.when(F.col("phase") == p, F.col("ts")))
    g = attempts(parsed).groupBy("log_key", "session", "name", "attempt").agg(at("started").alias("start_time"), at("ended").alias("end_time"))
    return g.withColumn("duration", F.col("end_time") - F.col("start_time"))


def previous_lines(lines: DataFrame) -> DataFrame:
    """Adds the content of the line before in the same log."""
    n = with_neighbours(lines, ["log_key", "session"], "line_no", F.struct("content"), "_p", "_n")
    return n.withColumn("previous", F.col("_p.content")).drop("_p", "_n")


def without_repeats(log: DataFrame) -> DataFrame:
    """One row_id per (log, session, marker, start, end), one whose metadata has no duration if there is, then the smallest."""
    has = F.coalesce(F.col("metadata").contains("duration"), F.lit(False))
    return log.groupBy("log_key", "session", "marker", "start_time", "end_time").agg(F.min(F.struct(has.alias("h"), "row_id")).alias("k")).select("log_key", "session", "marker", "start_time", "end_time", "k.row_id")


def classes(log: DataFrame) -> DataFrame:
    """A row per class that a marker belongs to; a marker may belong to several, or to none."""
    m = F.regexp_replace(F.lower(F.trim("marker")), r"[\s-]", "_")
    said = F.array_compact(F.array(*[F.when(m.rlike(p), F.lit(c)) for c, p in CLASSES.items()]))
    return log.where(F.col("marker").isNotNull()).select("row_id", F.explode(said).alias("class"))


def event_classes(log: DataFrame) -> DataFrame:
    """A row per class of an event, by its marker and the score in its metadata: an instruction is no sync, rest or form
    event, a form is of the first kind named, and a score of 0 is a class of its own."""
    m = F.coalesce(F.regexp_replace(F.lower(F.trim("marker")), r"[\s-]", "_"), F.lit(""))
    said = F.from_json("metadata", "map<string,string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    zero = F.try_element_at(said, F.lit("score")).try_cast("double") == 0
    forms = [c for c in CLASSES if c in FORMS]
    form = F.coalesce(*[F.when(m.rlike(CLASSES[c]), F.lit(c)) for c in forms])
    other = [F.when(m.rlike(p) if c not in ("Sync Events", "Rest Events") else m.rlike(p) & ~m.contains("instr"), F.lit(c)) for c, p in CLASSES.items() if c not in forms]
    return log.select("row_id", F.explode(F.array_compact(F.array(*other, F.when(~m.contains("instr"), form), F.when(zero, F.lit("Zero Score Trials"))))).alias("class"))


def metadata_entries(log: DataFrame) -> DataFrame:
    """The entries of metadata written as a dictionary in either notation: (row_id, key, value); other texts have none."""
    m = F.from_json(F.regexp_replace("metadata", "'", '"'), "map<string,string>")
    return log.where(F.col("metadata").isNotNull()).select("row_id", F.explode(m).alias("key", "value"))


def metadata_values(log: DataFrame) -> DataFrame:
    """The entries of metadata as far as it is a dictionary in either notation, values with apostrophes included, and other
    texts whole under the key raw_metadata: (row_id, key, value). A null or blank text and an empty dictionary have none."""
    m = F.from_json("metadata", "map<string,string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    raw = F.when(F.trim("metadata") != "", F.create_map(F.lit("raw_metadata"), F.col("metadata")))
    whole = F.when(F.trim("metadata").startswith("{"), F.coalesce(m, raw)).otherwise(raw)
    return log.where(F.col("metadata").isNotNull()).select("row_id", F.explode(whole).alias("key", "value"))


def in_order(rows: DataFrame) -> DataFrame:
    """Structured log rows in order of time, a start before an end of the same instant."""
    return rows.orderBy("log_key", "session", "ts", F.when(F.col("phase") == "started", 0).otherwise(1), "row_id")


def with_value_lines(log: DataFrame) -> DataFrame:
    """Log events as raw lines, three to an event: started, the accuracy of its metadata in percent if it has one, ended."""
    said = metadata_values(log).where(F.col("key") == "accuracy").groupBy("row_id").agg(F.min("value").alias("said"))
    ok = log.where(F.col("log_key").isNotNull() & F.col("marker").isNotNull()).join(said, "row_id", "left")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("category")), F.lit("block_info"))
    line = lambda n, ts, content: F.struct(F.lit(n).alias("n"), ts.alias("ts"), content.alias("content"))
    start, end = F.col("start_time"), F.col("end_time")
    lines = F.array(line(0, start, F.concat(kind, F.lit(": "), "marker", F.lit(" started"))), line(1, end, F.concat("said", F.lit("%"))), line(2, end, F.concat(kind, F.lit(": "), "marker", F.lit(" ended"))))
    each = ok.select("log_key", "session", "row_id", F.inline(lines)).where(F.col("ts").isNotNull() & F.col("content").isNotNull())
    return each.select("log_key", "session", (F.col("row_id") * 3 + F.col("n")).alias("line_no"), "ts", "content")


def accuracies(lines: DataFrame) -> DataFrame:
    """The accuracy of each block that ended: (log_key, session, line_no, name, accuracy), the number on the line before its
    end, bare or behind `label: `, without its percent sign; null where that line holds no number."""
    n = previous_lines(lines).where(F.col("content").rlike(r"^block_\w+: .* ended$"))
    parts = F.split("previous", ": ")
    value = F.regexp_replace(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))), r"\s*%$", "").try_cast("double")
    return n.select("log_key", "session", "line_no", one_based(F.regexp_extract("content", LINE, 2)).alias("name"), value.alias("accuracy"))


def completed_sets(lines: DataFrame) -> DataFrame:
    """Lines that tell of completed trials: (log_key, session, line_no, task, minutes), minutes null where none are given."""
    c = F.col("content")
    task = F.regexp_extract(c, r"^block_info: completed (\w+) trials", 1)
    return lines.where(task != "").select("log_key", "session", "line_no", task.alias("task"), F.regexp_extract(c, r"in ([\d.]+) minutes", 1).try_cast("double").alias("minutes"))


def trial_spans(log: DataFrame, last: int) -> DataFrame:
    """Spans of trial sets: from the trial numbered 1 to each trial numbered `last` that comes after it in the log."""
    m = F.regexp_replace(F.lower(F.trim("marker")), r"[\s-]", "_")
    pattern = r"^(\w+?)_trial_(\d+)_set_(\d+)$"
    t = log.where(F.col("log_key").isNotNull() & F.col("start_time").isNotNull()).select("log_key", "session", "row_id", "start_time", "end_time", F.regexp_extract(m, pattern, 1).alias("task"), F.regexp_extract(m, pattern, 3).alias("set"), F.regexp_extract(m, pattern, 2).alias("trial")).where(F.col("trial") != "")
    opened = F.when(F.col("trial") == "1", F.struct("row_id", "start_time"))
    n = with_neighbours(t, ["log_key", "session", "task", "set"], "row_id", opened, "_p", "_n")
    return n.where((F.col("trial") == str(last)) & F.col("_p").isNotNull()).select("log_key", "session", "task", "set", F.col("_p.row_id").alias("open_row"), F.col("row_id").alias("close_row"), F.col("_p.start_time").alias("start_time"), "end_time")


def set_spans(log: DataFrame) -> DataFrame:
    """Spans of whole trial sets: from the trial numbered 1 to the first one after it numbered 20, of final tests 60."""
    m = F.regexp_replace(F.lower(F.trim("marker")), r"[\s-]", "_")
    pattern = r"^(\w+?)_trial_(\d+)_set_(\d+)$"
    t = log.where(F.col("log_key").isNotNull() & F.col("start_time").isNotNull()).select("log_key", "session", "row_id", "start_time", "end_time", F.regexp_extract(m, pattern, 1).alias("task"), F.regexp_extract(m, pattern, 3).alias("set"), F.regexp_extract(m, pattern, 2).alias("trial"))
    opens, closes = F.col("trial") == "1", F.col("trial") == F.when(F.col("task") == "final_test", "60").otherwise("20")
    n = with_neighbours(t.where(opens | closes), ["log_key", "session", "task", "set"], "row_id", F.struct("row_id", "start_time", "trial"), "_p", "_n")
    return n.where(closes & (F.col("_p.trial") == "1")).select("log_key", "session", "task", "set", F.col("_p.row_id").alias("open_row"), F.col("row_id").alias("close_row"), F.col("_p.start_time").alias("start_time"), "end_time")


def follow_on(log: DataFrame, category: str, pause_ms: int = 300_000) -> DataFrame:
    """The events of a category laid out one after the other, in row order, from `pause_ms` after the log's last end:
    (row_id, marker, occurrence, start_ms, end_ms). Events without a duration take none."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    keyed = log.where(F.col("log_key").isNotNull())
    last = keyed.groupBy("log_key", "session").agg(F.max(ms("end_time")).alias("last"))
    e = keyed.where(F.col("category") == category).select("log_key", "session", "row_id", "marker", F.greatest(F.coalesce(ms("end_time") - ms("start_time"), F.lit(0)), F.lit(0)).alias("ms"))
    e = with_running_sum(e, ["log_key", "session"], "row_id", F.col("ms"), "upto")
    e = with_running_sum(e, ["log_key", "session", "marker"], "row_id", F.lit(1).cast("bigint"), "occurrence")
    end = F.col("last") + pause_ms + F.col("upto")
    return e.join(last, ["log_key", "session"]).select("log_key", "session", "row_id", "marker", "occurrence", (end - F.col("ms")).alias("start_ms"), end.alias("end_ms"))


FORMS = ["BRUMS", "SSS", "VASF", "LIKERT"]


def structured(log: DataFrame, early_s: float = 0.1) -> DataFrame:
    """A started and an ended row per event, the latter `early_s` before the end: (log_key, session, row_id, phase, ts,
    marker). Rows of one instant are all kept."""
    ends = F.array(F.struct(F.lit("started").alias("phase"), F.col("start_time").alias("ts")), F.struct(F.lit("ended").alias("phase"), (F.col("end_time") - early_s).alias("ts")))
    return log.where(F.col("log_key").isNotNull()).select("log_key", "session", "row_id", "marker", F.inline(ends)).where(F.col("ts").isNotNull())


def form_answers(log: DataFrame) -> DataFrame:
    """Questions and answers in the metadata of forms: (row_id, form, question, answer)."""
    forms = log.where(F.upper(F.trim("category")).isin(FORMS)).select("row_id", F.upper(F.trim("category")).alias("form"))
    return metadata_entries(log).where(F.col("key").contains("?")).join(forms, "row_id").select("row_id", "form", F.col("key").alias("question"), F.col("value").alias("answer"))


def durations(log: DataFrame) -> DataFrame:
    """Seconds that each event took: what its metadata say, else its end minus its start; null where neither is known."""
    said = metadata_entries(log).where(F.col("key") == "duration").groupBy("row_id").agg(F.min(F.col("value").try_cast("double")).alias("said"))
    return log.join(said, "row_id", "left").select("row_id", F.coalesce("said", F.col("end_time") - F.col("start_time")).alias("duration"))
