"""Fills, orphan references and intervals against brute force."""

import datetime as dt

import numpy as np
import pytest

from pulsegrid.functions.columns import micros
from pulsegrid.operators.hot_deck import fills, hot_deck_fill
from pulsegrid.operators.intervals import periods_and_gaps
from pulsegrid.operators.orphans import by_period, orphans, references

T0 = dt.datetime(2024, 1, 1)
FEAT = "feature_id bigint, stream_id string, session int, epoch bigint, user_id bigint, ts timestamp_ntz, before string, sid string, t string"


def feat(i, stream, session, epoch, user, s):
    return (i, stream, session, epoch, user, None if s is None else T0 + dt.timedelta(seconds=s), "clash", "clash", "clash")


def filled(spark, rows):
    return {(r.feature_id, r.field, r.filled) for r in fills(hot_deck_fill(spark.createDataFrame(rows, FEAT))).collect()}


def test_each_field_is_filled_from_its_donors(spark):
    rows = [
        feat(1, "A_x", 1, 0, 7, 0.2), feat(2, " a_X ", 1, 1, 7, 5.1), feat(3, "a_x", 1, None, 8, 10.3), feat(4, "a_x", None, None, None, 59.0), feat(5, "a_x", 0, -1, 0, 119.0),
        feat(6, "a_x", None, 24, 7, 400.0), feat(7, "b_x", None, None, 7, 5.0), feat(8, "a_x", 1, None, None, None), feat(9, None, None, None, None, 5.0), feat(10, "a_x", 2, 3, 9, 90000.0),
    ]
    assert filled(spark, rows) == {(3, "epoch", "2"), (4, "session", "1"), (4, "epoch", "12"), (4, "user_id", "7"), (8, "user_id", "7")}


def test_reach_is_closed_and_the_nearer_donor_wins(spark):
    rows = [feat(1, "a", 1, 0, 1, 0), feat(2, "a", None, 0, 1, 60), feat(3, "a", None, 0, 1, 60.000001), feat(4, "b", 1, 0, 1, 0), feat(5, "b", 2, 0, 1, 50), feat(6, "b", None, 0, 1, 24), feat(7, "b", None, 0, 1, 26), feat(8, "b", None, 0, 1, 25)]
    assert {x for x in filled(spark, rows) if x[1] == "session"} == {(2, "session", "1"), (6, "session", "1"), (7, "session", "2"), (8, "session", "1")}


def test_one_wrong_donor_does_not_decide_the_epoch(spark):
    """The nearest donor says another epoch than the three others around it together."""
    t0 = dt.datetime(2024, 1, 1)
    times = [(1, 0.0, 0), (2, 5.0, 1), (3, 10.0, 7), (4, 15.0, 3), (5, 20.0, 4), (9, 11.5, None)]
    df = spark.createDataFrame([(i, "s", 1, e, 5, t0 + dt.timedelta(seconds=x)) for i, x, e in times], "feature_id bigint, stream_id string, session int, epoch bigint, user_id bigint, ts timestamp_ntz")
    r = {r.feature_id: r for r in hot_deck_fill(df).collect()}[9]
    assert (r.epoch, r.epoch_filled, r.epoch_donor) == (2, True, 4)


def test_no_majority_no_fill(spark):
    rows = [feat(1, "a", 1, 0, 1, 0), feat(2, "a", 1, 1, 2, 5), feat(3, "a", 1, 2, None, 10)]
    assert filled(spark, rows) == set()
    assert filled(spark, [*rows, feat(4, "a", 1, 2, 2, 10)]) == {(3, "user_id", "2")}


def test_one_stream_with_a_third_of_rows_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [feat(i, "hot" if i % 3 else f"s{i % 5}", 1 if rng.random() < 0.9 else None, i // 2, 1, i // 2 * 5.0 + 0.3) for i in range(600)]
    got = {x[0] for x in filled(spark, rows) if x[1] == "session"}
    assert got == {r[0] for r in rows if r[2] is None and any(abs(r[5] - q[5]).total_seconds() <= 60 and q[2] and q[1] == r[1] for q in rows)}


def test_no_feature_rows(spark):
    assert filled(spark, []) == set()


REFS, PARENTS = "tbl string, row_id bigint, field string, key string, t bigint", "key string, start bigint, end bigint"


@pytest.mark.parametrize("per_task", [2_000_000, 50])
def test_orphans_by_brute_force(spark, per_task):
    rng = np.random.default_rng(4)
    keys = [f"k{i}" for i in range(60)]
    parents = [(k, int(rng.integers(0, 50)) if rng.random() < 0.9 else None, int(rng.integers(60, 90)) if rng.random() < 0.5 else None) for k in keys[:40]]
    refs = [("t", i, "f", "k1" if i % 3 == 0 else str(rng.choice(keys)), int(rng.integers(0, 100)) if rng.random() < 0.9 else None) for i in range(900)] + [("t", 9999, "f", None, 1)]
    by = {k: (a, z) for k, a, z in parents}

    def reason(k, t):
        if k not in by:
            return "missing"
        a, z = by[k]
        if t is None:
            return None
        return "later" if a is not None and a > t else "deleted" if z is not None and z <= t else None

    want = sorted((i, reason(k, t)) for _, i, _, k, t in refs if k and reason(k, t))
    got = orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), per_task=per_task)
    assert sorted((r.row_id, r.reason) for r in got.collect()) == want
    assert sum(r.refs for r in by_period(got).collect()) == len(want)


def test_orphans_without_parents_or_references(spark):
    refs = spark.createDataFrame([("t", 1, "f", "a", 5), ("t", 1, "f", "a", 5)], REFS)
    none = spark.createDataFrame([], PARENTS)
    assert [r.reason for r in orphans(refs, none).collect()] == ["missing", "missing"]
    assert orphans(spark.createDataFrame([], REFS), spark.createDataFrame([("a", 1, 2)], PARENTS)).count() == 0
    twice = spark.createDataFrame([("a", 9, 10), ("a", 3, None)], PARENTS)
    assert orphans(refs, twice).count() == 0


def test_references_skip_null_keys(spark):
    df = spark.createDataFrame([(1, None, T0, "x"), (2, 5, None, "x")], "row bigint, user bigint, ts timestamp_ntz, tbl string")
    got = references(df, "t", "row", "user", df["user"]).collect()
    assert [(r.row_id, r.key, r.t) for r in got] == [(2, "5", None)]
    assert df.select(micros("ts").alias("m")).first().m == 1704067200000000


def brute_periods(iv, slack):
    out, iv = [], sorted(iv)
    for a, z in iv:
        if out and a <= out[-1][1] + slack:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return {("period", a, z) for a, z in out} | {("gap", p[1], q[0]) for p, q in zip(out, out[1:])}


@pytest.mark.parametrize("bucket", [60_000, 50])
def test_periods_by_brute_force(spark, bucket):
    rng = np.random.default_rng(5)
    rows = []
    for k in ("hot", "b", "c"):
        for _ in range(400 if k == "hot" else 30):
            a = int(rng.integers(0, 20_000))
            rows.append((k, 1, a, a + int(rng.choice([0, 1, 5, 40, 300])), "kind"))
    bad = [(None, 1, 0, 5, ""), ("b", 1, None, 5, ""), ("b", 1, 5, None, ""), ("b", 1, 9, 3, "")]
    df = spark.createDataFrame(rows + bad + rows[:10], "k string, s int, a bigint, z bigint, t string")
    got = periods_and_gaps(df, ["k", "s"], "a", "z", 10, bucket).collect()
    for k in ("hot", "b", "c"):
        mine = [r for r in got if r.k == k]
        assert {(r.kind, r.start, r.end) for r in mine} == brute_periods([(a, z) for q, _, a, z, _ in rows if q == k], 10)
        assert len(mine) == len({(r.kind, r.start) for r in mine})


def test_periods_touch_exactly_at_the_slack(spark):
    df = spark.createDataFrame([("k", None, 0, 5), ("k", None, 15, 20), ("k", None, 31, 40)], "k string, s int, a bigint, z bigint")
    assert {(r.kind, r.start, r.end) for r in periods_and_gaps(df, ["k", "s"], "a", "z", 10).collect()} == {("period", 0, 20), ("gap", 20, 31), ("period", 31, 40)}
    assert periods_and_gaps(df.where("false"), ["k", "s"], "a", "z", 10).count() == 0
