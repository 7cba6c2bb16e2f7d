"""What stands between the lines of a log's blocks: results of trials, answers in forms, values some lines back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions.ordered import with_halo, with_neighbours, with_running_sum
from pulsegrid.operators.logs import FORMS, KINDS, attempts, metadata_values, one_based, parse_lines

LOG = ["log_key", "session"]
#: Accuracy in percent from which an individualisation has found its times. Fixed value.
ENOUGH = 85.0
#: The items of the questionnaires, in the order of their numbers from 1 on. Fixed values.
QUESTIONS = {
    "BRUMS": ["Panicky", "Lively", "Confused", "Worn Out", "Depressed", "Downhearted", "Annoyed", "Exhausted", "Mixed-Up", "Sleepy", "Bitter", "Unhappy", "Anxious", "Worried", "Energetic", "Miserable", "Muddled", "Nervous", "Angry", "Active", "Tired", "Bad Tempered", "Alert", "Uncertain"],
    "SSS": ["How sleepy do you feel right now?"],
    "VASF": ["Feeling tired", "Feeling sleepy", "Feeling drowsy", "Feeling fatigued", "Feeling worn out", "Feeling energetic", "Feeling active", "Feeling vigorous", "Feeling efficient", "Feeling lively", "Feeling bushed", "Feeling exhausted", "Difficulty in keeping my eyes open", "Difficulty in moving my body", "Difficulty in concentrating", "Difficulty in carrying on a conversation", "Desire to close my eyes", "Desire to lie down"],
    "LIKERT": ["How sleepy do you feel?", "How stressed do you feel?", "How high is your mental workload?", "How fatigued do you feel?"],
}


def written_lines(log: DataFrame) -> DataFrame:
    """Log events as raw lines with their bodies: (log_key, session, line_no, ts, content), numbered from 0 in each log.

    An event gives a started line, a line for every entry of its metadata in order of the keys, and an ended line. A
    response and a score stand on lines block_resp and block_score, a score and an accuracy in percent, other entries
    as `key: value`. A line without time is left out, that of an entry only where start and end are both unknown; so
    are events without log_key, session or marker.
    """
    said = metadata_values(log).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("said"))
    e = log.where(F.col("log_key").isNotNull() & F.col("session").isNotNull() & F.col("marker").isNotNull()).select(*LOG, "row_id", "marker", "category", "start_time", "end_time").join(said, "row_id", "left")
    kinds = {**KINDS, **dict.fromkeys(FORMS, "block_form")}
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("category")), F.lit("block_info"))

    def entry(x: Column) -> Column:
        k, v = x["key"], x["value"]
        return F.when(k == "response", F.concat(F.lit("block_resp: "), v)).when(k == "score", F.concat(F.lit("block_score: "), v, F.lit("%"))).when(k == "accuracy", F.concat(F.lit("accuracy: "), v, F.lit("%"))).otherwise(F.concat(k, F.lit(": "), v))

    line = lambda ts, content: F.struct(ts.alias("ts"), content.alias("content"))
    start, end = F.col("start_time"), F.col("end_time")
    body = F.transform(F.coalesce("said", F.array().cast("array<struct<key:string,value:string>>")), lambda x: line(F.coalesce(start, end), entry(x)))
    each = F.concat(F.array(line(start, F.concat(kind, F.lit(": "), "marker", F.lit(" started")))), body, F.array(line(end, F.concat(kind, F.lit(": "), "marker", F.lit(" ended")))))
    e = e.select(*LOG, "row_id", F.filter(each, lambda x: x["ts"].isNotNull() & x["content"].isNotNull()).alias("each"))
    e = with_running_sum(e, LOG, "row_id", F.size("each").cast("bigint"), "upto")
    return e.select(*LOG, (F.col("upto") - F.size("each")).alias("before"), F.posexplode("each").alias("n", "l")).select(*LOG, (F.col("before") + F.col("n")).alias("line_no"), "l.ts", "l.content")


def look_back(lines: DataFrame, steps: list[int]) -> DataFrame:
    """Adds back_<k>, the content of the line k lines before in the same log, for every k of `steps` (1 and more); null where
    the log has not so many. Line numbers may have holes. Lines without log_key or session are in no log and left out."""
    n = with_running_sum(lines, LOG, "line_no", F.lit(1).cast("bigint"), "_n")
    w = Window.partitionBy(*LOG, "_b").orderBy("_n")
    h = with_halo(n, LOG, "_n", before=max(steps)).withColumns({f"back_{k}": F.lag("content", k).over(w) for k in steps})
    return h.where("_home").drop("_n", "_b", "_home")


def _after(c: str, mark: str) -> Column:
    """The second part of a text that is split at `mark`, null where there is none."""
    return F.trim(F.get(F.split(c, mark), F.lit(1)))


def trial_results(lines: DataFrame) -> DataFrame:
    """One row per attempt at a trial: (log_key, session, name, attempt, start_time, end_time, response, score).

    A response or score belongs to the trial that was started last and has not ended; outside of trials it belongs to
    none. Of several in one trial the last counts. Times, response and score are null where no line tells them; a score
    is a number without its percent sign. A trial that ended without a start has attempt 0.
    """
    c = F.col("content")
    p = parse_lines(lines).where((F.col("kind") == "block_trial") & F.col("phase").isNotNull())
    tried = attempts(p).select(*LOG, "line_no", "ts", "name", "attempt", "phase")
    resp = F.when(c.startswith("block_resp:"), _after("content", ":"))
    score = F.when(c.startswith("block_score:"), F.trim(F.regexp_replace(_after("content", ":"), "%", "")).try_cast("double"))
    told = lines.select(*LOG, "line_no", resp.alias("response"), score.alias("score")).where(F.col("response").isNotNull() | F.col("score").isNotNull())
    both = tried.unionByName(told, allowMissingColumns=True)
    at = with_neighbours(both, LOG, "line_no", F.when(F.col("phase").isNotNull(), F.struct("name", "attempt", "phase")), "_p", "_x").where(F.col("phase").isNull() & (F.col("_p.phase") == "started"))
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col("line_no"))).alias(x)
    found = at.groupBy(*LOG, F.col("_p.name").alias("name"), F.col("_p.attempt").alias("attempt")).agg(last("response"), last("score"))
    time = lambda phase, name: F.min(F.when(F.col("phase") == phase, F.col("ts"))).alias(name)
    return tried.groupBy(*LOG, "name", "attempt").agg(time("started", "start_time"), time("ended", "end_time")).join(found, [*LOG, "name", "attempt"], "left")


def form_bodies(lines: DataFrame) -> DataFrame:
    """Answers on the lines `question: answer` between the start and the end of a form: (log_key, session, name, attempt,
    question, answer). Of several answers to one question in one form the last counts; lines of other blocks and
    lines without a colon and a blank are no answers, nor are those of a form whose next form line is not its end."""
    p = parse_lines(lines).where((F.col("kind") == "block_form") & F.col("phase").isNotNull())
    forms = attempts(p).select(*LOG, "line_no", "name", "attempt", "phase")
    answers = lines.where(~F.col("content").startswith("block_") & F.col("content").contains(": ")).select(*LOG, "line_no", F.trim(F.get(F.split("content", ": "), F.lit(0))).alias("question"), _after("content", ": ").alias("answer"))
    both = forms.unionByName(answers, allowMissingColumns=True)
    at = with_neighbours(both, LOG, "line_no", F.when(F.col("phase").isNotNull(), F.struct("name", "attempt", "phase")), "_p", "_n")
    inside = F.col("phase").isNull() & (F.col("_p.phase") == "started") & (F.col("_n.phase") == "ended") & (F.col("_p.name") == F.col("_n.name"))
    return at.where(inside).groupBy(*LOG, F.col("_p.name").alias("name"), F.col("_p.attempt").alias("attempt"), "question").agg(F.max_by("answer", "line_no").alias("answer"))


def found_times(lines: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """Individualisation blocks that ended with an accuracy of at least `enough` percent: (log_key, session, line_no, name,
    accuracy, stimulus_s, response_s), the times from the lines `... = <seconds> s` four and three lines before."""
    back = look_back(lines, [1, 3, 4]).where(F.col("content").rlike(r"^block_acc: .*individualization.* ended$"))
    seconds = lambda c: F.trim(F.regexp_replace(_after(c, "= "), " s", "")).try_cast("double")
    name = one_based(F.regexp_extract("content", r"^block_acc: (\w+)", 1))
    accuracy = F.regexp_replace(_after("back_1", ": "), "%", "").try_cast("double")
    return back.select(*LOG, "line_no", name.alias("name"), accuracy.alias("accuracy"), seconds("back_4").alias("stimulus_s"), seconds("back_3").alias("response_s")).where(F.col("accuracy") >= enough)


def milestone_durations(lines: DataFrame) -> DataFrame:
    """What milestone instructions say that the part before took: (log_key, session, line_no, name, said), the fifth word of
    the line before the instruction's end; null where that line is shorter."""
    back = look_back(lines, [1]).where(F.col("content").rlike(r"^block_instr: .*milestone.* ended$"))
    return back.select(*LOG, "line_no", F.regexp_extract("content", r"^block_instr: (\w+)", 1).alias("name"), F.get(F.split("back_1", " "), F.lit(4)).alias("said"))


def questionnaires(spark: SparkSession) -> DataFrame:
    """The items of the questionnaires: (form, number, item)."""
    return spark.createDataFrame([(form, n, item) for form, items in QUESTIONS.items() for n, item in enumerate(items, 1)], "form string, number int, item string")


def asked_items(answers: DataFrame) -> DataFrame:
    """Answers with the form and the number of the item asked: adds form, number and item to (name, question, answer).

    The form is the first of FORMS in the name, whatever its case. A question is an item by its words, whatever their
    case, or as Q and its number; number and item are null where it is none, form where the name has none. The table of
    items is fixed and small.
    """
    form = F.coalesce(*[F.when(F.upper("name").contains(f), F.lit(f)) for f in FORMS])
    items = questionnaires(answers.sparkSession)
    asked = items.select("form", "number", "item", F.explode(F.array(F.lower("item"), F.concat(F.lit("q"), "number"))).alias("_asked"))
    return answers.withColumn("form", form).withColumn("_asked", F.lower(F.trim("question"))).join(F.broadcast(asked), ["form", "_asked"], "left").drop("_asked")


def kept_rows(log: DataFrame) -> DataFrame:
    """One row_id per (log, session, marker, start, end): one with metadata goes before one without, of those one whose
    metadata has no duration, then the smallest row_id."""
    key = [*LOG, "marker", "start_time", "end_time"]
    timed = F.coalesce(F.col("metadata").contains("duration"), F.lit(False))
    return log.groupBy(*key).agg(F.min(F.struct(F.col("metadata").isNull().alias("none"), timed.alias("timed"), "row_id")).alias("k")).select(*key, "k.row_id")
