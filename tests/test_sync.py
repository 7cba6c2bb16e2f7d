import datetime as dt
from pathlib import Path

import pytest

from pulsegrid.operators import events as V

T0 = dt.datetime(2024, 1, 1)
BASE = 1704067200.0
LOG = "row_id bigint, log_key string, session int, marker string, category string, start_time double, end_time double"


def test_only_spikes_in_the_markers_own_window_shift_a_log(spark):
    at = [(0, 9.9), (97, 20.0), (101, 20.0), (101.5, 20.0), (103, 20.0), (106, 20.0), (300, 20.0)]  # the window is 95 to 105
    rows = [(s, 1, i, T0 + dt.timedelta(seconds=t), v if s == "a_acc" or t > 200 else 9.95, 0.0, 0.0) for s in ("a_acc", "b_acc") for i, (t, v) in enumerate(at)]
    wide = spark.createDataFrame(rows, "sid string, session int, pos bigint, ts timestamp_ntz, x double, y double, z double")
    log = spark.createDataFrame([(i, k, 1, m, c, BASE + a, BASE + z) for k in ("a", "b") for i, (m, c, a, z) in enumerate([("SYNC_1", "Sync Events", 10, 20), ("SYNC_instr", None, 30, 40), ("SYNC_2", "Sync Events", 100, 110), ("pose", "Yoga Poses", 200, 260)])], LOG)
    rec = spark.createDataFrame([("A_ACC ", 1, "a"), ("b_acc", 1, "b"), ("a_eeg", 1, "a")], "stream_id string, session int, log_key string")
    shifts = V.window_shifts(wide, log, rec, 12.0)
    want = (97 + 101 + 103) / 3 - 100
    assert {r.sid: round(r["shift"], 5) for r in shifts.collect()} == {"a_acc": round(want, 5), "b_acc": 0.0}
    moved = {(r.log_key, r.row_id): (round(r.start_time - BASE, 5), r.duration_s) for r in V.shift_markers(log, shifts).collect()}
    assert moved["a", 2] == (round(100 + want, 5), 10.0) and moved["a", 3] == (round(80 + want, 5), 60.0) and moved["b", 3] == (80.0, 60.0)


@pytest.mark.parametrize("name", ["window_shifts", "shifted_markers"])
def test_sync_queries_equal_their_sql(spark, name, data="/root/testdata/sf0.01"):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    df = e.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[k] for k in cols) for r in df.collect())))
    want = sorted(map(repr, c.execute(f"select {', '.join(cols)} from ({e.oracle_sql()[name]})").fetchall()))
    assert got == want and got
