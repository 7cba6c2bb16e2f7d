from pathlib import Path

import pytest

from pulsegrid.operators import logs as L


def test_scores_and_instructions_decide_classes(spark):
    log = spark.createDataFrame([(1, "nback_trial_2_set_1", "{'score': 0}"), (2, "rest_instr_1", None), (3, "SYNC_instr", '{"score": 0.0, "say": "it\'s"}'), (4, "rest_1", "{'score': 3}"), (5, None, "n/a"), (6, "sss_form_instr", "")], "row_id bigint, marker string, metadata string")
    got = {(r.row_id, r["class"]) for r in L.event_classes(log).collect()}
    assert got == {(1, "Trial Sets"), (1, "Zero Score Trials"), (2, "Instruction Events"), (3, "Instruction Events"), (3, "Zero Score Trials"), (4, "Rest Events"), (6, "Instruction Events")}


def test_event_classes_equal_their_sql(spark, data="/root/testdata/sf0.1"):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    got = sorted(tuple(r) for r in e.queries()["event_classes"](spark, data).select("row_id", "class").collect())
    assert got == sorted(c.execute(f"select row_id, class from ({e.oracle_sql()['event_classes']})").fetchall())
    assert sum(k == "Zero Score Trials" for _, k in got) == 21
