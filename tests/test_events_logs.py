import datetime as dt

import numpy as np
import pytest

from pulsegrid.operators import correlate as C
from pulsegrid.operators import events as V
from pulsegrid.operators import logs as L
from pulsegrid.operators import validate as Q
from pulsegrid.errors import ValidationError

T0 = dt.datetime(2024, 1, 1)
EV = "event_row_id bigint, stream_id string, event_id bigint, event_name string, event_type string, event_duration double, metadata string"
LOG = "row_id bigint, log_key string, session int, marker string, category string, start_time double, end_time double, metadata string"


def test_the_last_covering_event_wins(spark):
    f = spark.createDataFrame([(i, "S", e) for i, e in enumerate([0, 1, 2, 3, 9, None])], "feature_id bigint, stream_id string, epoch bigint")
    e = spark.createDataFrame([(1, " s", 0, "a", "t", 12.0, None), (2, "s", 1, "b", None, None, "m"), (3, "s", 2, "c", "t", -5.0, None), (4, "s", 2, "d", "t", 1.0, None)], EV)
    got = {r.feature_id: r.event_name for r in V.merge_covering(f, e).collect()}
    assert got == {0: "a", 1: "b", 2: "d", 3: None, 4: None, 5: None}
    assert V.merge_equal(f, e).count() == 4


def test_spacing_counts_from_the_last_kept(spark):
    ms = [0, 60, 100, 160, 300, 301, 1000]
    wide = spark.createDataFrame([("s", 1, i, T0 + dt.timedelta(milliseconds=m), 9.0, 0.0, 0.0) for i, m in enumerate(ms)], "sid string, session int, pos bigint, ts timestamp_ntz, x double, y double, z double")
    base = 1704067200000000
    for block in (600_000_000, 50_000):
        got = sorted((r.t - base) // 1000 for r in V.spaced_spikes(wide, 5.0, 100_000, block).collect())
        assert got == [0, 160, 300, 1000]
    assert V.spaced_spikes(wide, 50.0, 1).count() == 0


def test_lines_attempts_and_pairs(spark):
    log = spark.createDataFrame([(1, "k", 1, "n_trial_0", "Trial Sets", 1.0, 2.0, None), (2, "k", 1, "n_trial_0", "Trial Sets", 3.0, None, None), (3, "k", 1, "rest", "Rest Events", 5.0, 6.5, None), (4, None, 1, "x", None, 1.0, 2.0, None)], LOG)
    p = L.pair_lines(L.parse_lines(L.to_lines(log)))
    assert {(r.name, r.attempt): r.duration for r in p.collect()} == {("n_trial_1", 1): 1.0, ("n_trial_1", 2): None, ("rest", 1): 1.5}
    prev = {r.line_no: r.previous for r in L.previous_lines(L.to_lines(log)).collect()}
    assert prev[2] is None and prev[3] == "block_trial: n_trial_0 started"
    assert L.parse_lines(spark.createDataFrame([("k", 1, 1, 0.0, "no form")], "log_key string, session int, line_no bigint, ts double, content string")).first().kind is None


def test_metadata_notations_and_repeats(spark):
    log = spark.createDataFrame([(1, "k", 1, "m", None, 1.0, 2.0, "{'a': 'x', 'duration': 3}"), (2, "k", 1, "m", None, 1.0, 2.0, '{"b": 1.5}'), (3, "k", 1, "m", None, 1.0, 2.0, "n/a"), (4, "k", 1, "m", None, 1.0, 2.0, None)], LOG)
    assert {(r.row_id, r.key, r.value) for r in L.metadata_entries(log).collect()} == {(1, "a", "x"), (1, "duration", "3"), (2, "b", "1.5")}
    assert [r.row_id for r in L.without_repeats(log).collect()] == [2]


def test_codes_one_hot_and_frequency(spark):
    df = spark.createDataFrame([(1, "b", "g"), (2, None, "g"), (3, "a", "g"), (4, "b", "h"), (5, None, "i")], "i bigint, v string, k string")
    assert {r.i: r.code for r in C.codes(df, "v", "i").collect()} == {1: 0, 2: -1, 3: 1, 4: 0, 5: -1}
    assert C.one_hot(df, "v").columns[-2:] == ["v_a", "v_b"]
    with pytest.raises(ValueError):
        C.one_hot(df, "v", limit=1)
    assert {r.k: r.v for r in C.most_frequent(df, ["k"], "v", "i").collect()} == {"g": "b", "h": "b", "i": "No Event"}


def test_validation(spark):
    rows = spark.createDataFrame([("s", 1, "X", i, T0 + dt.timedelta(seconds=s), float(v)) for i, (s, v) in enumerate([(0, 1), (1, float("nan")), (1, float("inf"))])], "sid string, session int, channel string, pos bigint, ts timestamp_ntz, value double")
    report = Q.series_report(rows)
    r = report.first()
    assert (r.rows, r.missing, r.infinite, r.not_after) == (3, 1, 1, 1)
    for bad in (lambda: Q.require_increasing(report), lambda: Q.require_columns(rows, ["nope"]), lambda: Q.require_rows(rows, 9), lambda: Q.require_rate(None), lambda: Q.require_rate("0.5")):
        with pytest.raises(ValidationError):
            bad()
    assert Q.require_rate("64") == 64.0


def test_covering_events_by_brute_force_and_a_huge_duration(spark):
    import random

    from pulsegrid.operators.events import merge_covering

    rng = random.Random(4)
    ev = [(i, "s", rng.randint(-3, 60), f"n{i}", "t", rng.choice([None, 0.0, 4.9, 5.0, 23.0, 90.0, 400.0]), "m") for i in range(80)] + [(99, "t", 5, "long", "t", 5e9, "m")]
    ft = [(i, "s", i - 5) for i in range(120)] + [(200, "t", 4), (201, "t", 900_000_000), (202, "t", 2_000_000_000), (203, None, 1), (204, "s", None)]
    got = {r.feature_id: r.event_name for r in merge_covering(spark.createDataFrame(ft, "feature_id bigint, stream_id string, epoch bigint"), spark.createDataFrame(ev, "event_row_id bigint, stream_id string, event_id bigint, event_name string, event_type string, event_duration double, metadata string")).collect()}
    for f, s, e in ft:
        over = [(x[2], x[0], x[3]) for x in ev if e is not None and x[1] == s and x[2] <= e <= x[2] + int((x[5] or 0) // 5)]
        assert got[f] == (max(over)[2] if over else None), f


def test_codes_follow_the_order_of_first_sight(spark):
    from pulsegrid.operators.correlate import codes

    rows = [(i, None if i % 7 == 0 else f"v{(i * 37) % 50}") for i in range(400)]
    got = {r.i: r.code for r in codes(spark.createDataFrame(rows, "i bigint, v string"), "v", "i").collect()}
    seen = []
    for i, v in rows:
        if v is not None and v not in seen:
            seen.append(v)
        assert got[i] == (-1 if v is None else seen.index(v))


def test_log_values(spark):
    from pulsegrid.operators import logs as L

    log = spark.createDataFrame([(1, "{'a': \"it's\", 'b': 2}"), (2, "free text"), (3, "{broken"), (4, " "), (5, None), (6, "{}")], "row_id bigint, metadata string")
    assert {(r.row_id, r.key, r.value) for r in L.metadata_values(log).collect()} == {(1, "a", "it's"), (1, "b", "2"), (2, "raw_metadata", "free text"), (3, "raw_metadata", "{broken")}
    lines = spark.createDataFrame([("k", 1, i, float(i), c) for i, c in enumerate(["block_acc: x_0 started", " 75.5 % ", "block_acc: x_0 ended", "block_rest: r ended", "block_info: completed nback trials in 4.5 minutes", "block_info: completed dual trials"])], "log_key string, session int, line_no bigint, ts double, content string")
    assert {(r.name, r.accuracy) for r in L.accuracies(lines).collect()} == {("x_1", 75.5), ("r", None)}
    assert {(r.task, r.minutes) for r in L.completed_sets(lines).collect()} == {("nback", 4.5), ("dual", None)}


@pytest.mark.parametrize("block_us", [600_000_000, 1000, 137])
def test_spaced_spikes_whatever_the_blocks(spark, block_us):
    import datetime as dt

    from pulsegrid.operators.events import spaced_spikes

    rng = np.random.default_rng(11)
    t0 = dt.datetime(2024, 1, 1)
    want, rows = set(), []
    for s, gaps in (("noisy", rng.integers(1, 40, 500)), ("calm", rng.integers(50, 900, 60)), ("one", [5])):
        last = None
        for i, t in enumerate(np.cumsum(gaps)):
            rows.append((s, 1, i, t0 + dt.timedelta(microseconds=int(t)), 20.0, 0.0, 0.0))
            if last is None or t - last > 100:
                want.add((s, int(t)))
                last = t
    df = spark.createDataFrame(rows + rows[:50], "sid string, session int, pos bigint, ts timestamp_ntz, x double, y double, z double")
    base = int((t0 - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert {(r.sid, r.t - base) for r in spaced_spikes(df, 9.9, 100, block_us).collect()} == want
    assert spaced_spikes(df, 99.0, 100, block_us).count() == 0
