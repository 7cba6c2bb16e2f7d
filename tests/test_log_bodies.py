from pulsegrid.operators import log_bodies as B
from pulsegrid.operators import logs as L

LINES = "log_key string, session int, line_no bigint, ts double, content string"


def lines(spark, *contents, step=3):
    return spark.createDataFrame([("k", 1, step * i, float(i), c) for i, c in enumerate(contents)], LINES)


def test_results_belong_to_the_open_trial(spark):
    t = lines(spark, "block_resp: early", "block_trial: nback_trial_0 started", "block_resp: left", "block_resp: right", "block_score: 80%", "block_trial: nback_trial_0 ended", "block_score: 1%", "block_trial: nback_trial_0 started", "block_score: 5 %", "block_trial: parity_trial_1 ended")
    got = {(r.name, r.attempt): (r.start_time, r.end_time, r.response, r.score) for r in B.trial_results(t).collect()}
    assert got == {("nback_trial_1", 1): (1.0, 5.0, "right", 80.0), ("nback_trial_1", 2): (7.0, None, None, 5.0), ("parity_trial_2", 0): (None, 9.0, None, None)}
    assert B.trial_results(t.where("false")).count() == 0


def test_answers_between_the_lines_of_a_form(spark):
    t = lines(spark, "Panicky: 9", "block_form: BRUMS_0 started", "panicky: 1", "Q2: 3", "block_sync: x started", "no answer", "How odd?: 2", "panicky: 4", "block_form: BRUMS_0 ended", "Lively: 7", "block_form: SSS_0 started", "Q1: 5", "block_form: VASF_0 ended")
    got = {(r.name, r.attempt, r.question): (r.answer, r.form, r.number, r.item) for r in B.asked_items(B.form_bodies(t)).collect()}
    assert got == {("BRUMS_1", 1, "panicky"): ("4", "BRUMS", 1, "Panicky"), ("BRUMS_1", 1, "Q2"): ("3", "BRUMS", 2, "Lively"), ("BRUMS_1", 1, "How odd?"): ("2", "BRUMS", None, None)}


def test_lines_before_across_blocks_and_holes(spark):
    n = 20_000
    t = spark.range(n).selectExpr("'k' as log_key", "1 as session", "id * id as line_no", "0D as ts", "string(id) as content").unionByName(spark.createDataFrame([(None, 1, 5, 0.0, "x"), ("j", 1, 5, 0.0, "y"), ("j", 1, 6, 0.0, None)], LINES))
    got = B.look_back(t, [1, 4])
    assert got.count() == n + 2
    assert got.where("log_key = 'k' and not (back_1 <=> if(content >= 1, string(int(content) - 1), null) and back_4 <=> if(content >= 4, string(int(content) - 4), null))").count() == 0
    assert [r.back_1 for r in got.where("log_key = 'j'").orderBy("line_no").collect()] == [None, "y"]


def test_times_found_and_milestones(spark):
    block = ["stimulus = 0.5 s", "response = 1.25 s", "level: 2", "block_info: 85.0%", "block_acc: individualization_acc_0 ended"]
    low = [*block[:3], "block_info: 84.9%", block[4]]
    assert [(r.name, r.accuracy, r.stimulus_s, r.response_s) for r in B.found_times(lines(spark, *block, *low)).collect()] == [("individualization_acc_1", 85.0, 0.5, 1.25)]
    said = B.milestone_durations(lines(spark, "it took you some 12 minutes", "block_instr: milestone_1 ended", "short", "block_instr: milestone_2 ended")).collect()
    assert sorted((r.name, r.said) for r in said) == [("milestone_1", "12"), ("milestone_2", None)]


def test_rows_with_metadata_are_kept(spark):
    log = "row_id bigint, log_key string, session int, marker string, start_time double, end_time double, metadata string"
    rows = [(1, "a", None), (2, "a", "{'duration': 1}"), (3, "b", "{'duration': 1}"), (4, "b", "{'score': 1}"), (5, "c", None), (6, "c", None)]
    df = spark.createDataFrame([(i, "k", 1, m, 0.0, 1.0, d) for i, m, d in rows], log)
    assert {r.marker: r.row_id for r in B.kept_rows(df).collect()} == {"a": 2, "b": 4, "c": 5}


def test_questionnaires(spark):
    assert {r.form: r["count"] for r in B.questionnaires(spark).groupBy("form").count().collect()} == {"BRUMS": 24, "SSS": 1, "VASF": 18, "LIKERT": 4}


def test_accuracies_bare_and_labelled(spark):
    t = lines(spark, "87.5%", "block_acc: a_0 ended", "block_info: 60 %", "block_acc: b_0 ended", "block_info: none", "block_acc: c_0 ended")
    assert {r.name: r.accuracy for r in L.accuracies(t).collect()} == {"a_1": 87.5, "b_1": 60.0, "c_1": None}
