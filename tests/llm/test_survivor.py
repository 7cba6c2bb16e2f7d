import datetime as dt

import numpy as np
import pytest

from pulsegrid.llm.survivor import claims, copies, gap_groups, precedence_records, surviving_records, survivors, truth_model

LOG = "row_id bigint, log_key string, session int, marker string, category string, start_time double, end_time double, metadata string, origin string, recorded_at timestamp_ntz, trust string, group_id string, copies string"
T0 = dt.datetime(2024, 1, 1)


def row(i, marker="m", start=10.0, end=12.0, category="c", metadata="{'a': 1}", origin="x", day=0, key="k", session=1):
    return (i, key, session, marker, category, start, end, metadata, origin, None if day is None else T0 + dt.timedelta(days=day), "clash", "clash", "clash")


@pytest.fixture(scope="module")
def origins(spark):
    return spark.createDataFrame([("x", 2), ("y", 1), ("z", 2), (None, 0)], "origin string, trust int")


def picked(spark, origins, rows):
    c = copies(spark.createDataFrame(rows, LOG), origins)
    return {(r.group_id, r.field): r.row_id for r in survivors(c).collect()}


def test_precedence_field_by_field(spark, origins):
    rows = [
        row(5, metadata=None, end=9.0, category=" N/A "), row(3, " M ", start=10.4, origin="y", metadata="{ }", category=""), row(7, origin="z", day=3, start=10.1, category=None), row(2, origin=None, day=9),
        row(9, origin="nobody", day=10, category=None, metadata="", end=None),
    ]
    assert picked(spark, origins, rows) == {(2, "end_time"): 3, (2, "category"): 2, (2, "metadata"): 7}


def test_latest_then_smallest_and_null_dates(spark, origins):
    rows = [row(4, day=1), row(6, day=1), row(1, day=None)]
    assert set(picked(spark, origins, rows).values()) == {4}


def test_who_is_in_a_group(spark, origins):
    rows = [row(1), row(2, "M", start=10.5), row(3, "a-b c", start=50.0), row(4, "A_B-C", start=50.2), row(5, start=11.1), row(6, None), row(7, start=None), row(8, key=None), row(9, key="other"), row(10, start=float("nan"))]
    assert {g for g, _ in picked(spark, origins, rows)} == {1, 3}


def test_no_copy_has_the_field_and_no_log(spark, origins):
    assert picked(spark, origins, [row(1, metadata="n/a"), row(2, metadata="{}")]).keys() == {(1, "end_time"), (1, "category")}
    assert picked(spark, origins, []) == {} and picked(spark, origins, [row(1)]) == {}


@pytest.mark.parametrize("bucket", [60_000, 1000, 501])
def test_chains_across_buckets(spark, bucket):
    rng = np.random.default_rng(6)
    t = np.cumsum(rng.choice([0, 100, 400, 500, 501, 3000], 400, p=[0.1, 0.3, 0.3, 0.15, 0.1, 0.05]))
    ids = rng.permutation(400)
    rows = [(int(i), "k", int(x)) for i, x in zip(ids, t)]
    got = {r.row_id: r.group_id for r in gap_groups(spark.createDataFrame(rows, "row_id bigint, k string, t bigint"), ["k"], "t", "row_id", 500, bucket).collect()}
    want, group = {}, []
    for n, (i, x) in enumerate(zip(ids, t)):
        if n and x - t[n - 1] > 500:
            want |= dict.fromkeys(group, min(group))
            group = []
        group.append(int(i))
    assert got == want | dict.fromkeys(group, min(group))


def test_truth_model_finds_the_bad_origin(spark):
    rng = np.random.default_rng(8)
    said = []
    for g in range(300):
        for n, (o, right) in enumerate((("good", 0.97), ("fair", 0.9), ("bad", 0.4), ("fine", 0.95))):
            said.append((g, "f", "true" if rng.random() < right else f"wrong{rng.integers(3)}", o, g * 10 + n))
    facts, quality = truth_model(spark.createDataFrame(said, "group_id bigint, field string, fact string, origin string, row_id bigint"))
    assert quality["good"][0] > quality["bad"][0] + 0.2 and quality["good"][1] > quality["bad"][1]
    top = facts.where("p_true >= 0.5").collect()
    assert np.mean([r.fact == "true" for r in top]) > 0.97 and len({r.group_id for r in top}) > 285


def test_multi_valued_metadata_keeps_every_true_entry(spark, origins):
    rows = [row(3 * g + n, start=100.0 * g + 10, end=100.0 * g + 12, origin=o, metadata=m) for g in range(30) for n, (o, m) in enumerate((("x", '{"a": 1, "b": "q"}'), ("y", "{'a': 1, 'b': 'q'}"), ("z", "{'a': 1}")))]
    facts, _ = truth_model(claims(copies(spark.createDataFrame(rows, LOG), origins)))
    kept = {r.fact for r in facts.where("field = 'metadata' and p_true >= 0.5").collect()}
    assert kept == {"a:1", "b:q"}
    built = surviving_records(copies(spark.createDataFrame(rows, LOG), origins)).where("group_id = 0").first()
    assert built.metadata == "{'a': 1, 'b': 'q'}" and built.copies == 3


def test_records_follow_the_model_not_the_trust(spark, origins):
    """y is the most trusted origin and states end times of its own; the others agree with each other."""
    rows = []
    for g in range(60):
        for n, o in enumerate(("x", "y", "z", "w")):
            end = 100.0 * g + 12 + (0 if o != "y" or g % 6 == 0 else 1 + g % 5)
            rows.append(row(4 * g + n, start=100.0 * g + 10, end=end, origin=o, metadata="{}" if o == "y" else "{'a': 1}", category=None))
    c = copies(spark.createDataFrame(rows, LOG), origins)
    _, quality = truth_model(claims(c))
    assert quality["y"][0] < quality["x"][0]
    by_model = {r.group_id: r for r in surviving_records(c).collect()}
    by_trust = {r.group_id: r for r in precedence_records(c).collect()}
    assert all(r.end_time == 25.0 * g + 12 and r.metadata == "{'a': 1}" and r.category is None for g, r in by_model.items())
    assert sum(r.end_time != 25.0 * g + 12 for g, r in by_trust.items()) == 50


def test_rounds_on_spark_equal_those_on_counts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    said = [(g, "f", "t" if rng.random() < q else "w", o, g * 10 + n) for g in range(80) for n, (o, q) in enumerate((("a", 0.9), ("b", 0.6), ("c", 0.8)))]
    df = spark.createDataFrame(said, "group_id bigint, field string, fact string, origin string, row_id bigint")
    _, one = truth_model(df, rounds=4)
    monkeypatch.setattr("pulsegrid.llm.survivor.PATTERNS", 1)
    _, other = truth_model(df, rounds=4)
    assert all(one[o] == pytest.approx(other[o]) for o in "abc")
