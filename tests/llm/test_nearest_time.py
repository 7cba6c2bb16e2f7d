import numpy as np
import pytest

from pulsegrid.llm.nearest_time import nearest_in_time

LEFT, RIGHT = "lid bigint, sid string, t bigint, rid string, d string", "rid bigint, sid string, t bigint, lid string"


def brute(left, right, tol):
    out = {}
    for lid, sid, t, *_ in left:
        c = [(abs(t - u), rid) for rid, s, u, _ in right if s is not None and s == sid and t is not None and u is not None and abs(t - u) <= tol]
        if c:
            out[lid] = min(c)
    return out


@pytest.mark.parametrize("doublings", [0, 1, 3])
@pytest.mark.parametrize("seed, tol", [(0, 64), (1, 64), (2, 8)])
def test_equals_brute_force(spark, doublings, seed, tol):
    rng = np.random.default_rng(seed)
    ids = ["hot"] * 3 + ["a", "b"]
    left = [(i, str(rng.choice(ids)), int(rng.integers(0, 3000)), "x", "x") for i in range(300)] + [(900, None, 5, "", ""), (901, "a", None, "", ""), (902, "zzz", 5, "", "")]
    right = [(1000 + i, str(rng.choice(ids)), int(rng.integers(0, 3000)), "x") for i in range(150)] + [(1, None, 5, ""), (2, "a", None, "")]
    right += [(r[0] + 5000, *r[1:]) for r in right[:40]]  # the same instants under other ids
    got = {r.lid: (r.d, r.rid) for r in nearest_in_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), tol, doublings).collect()}
    assert got == brute(left, right, tol)


def test_one_dense_bucket_and_repeated_left_rows(spark):
    right = [(i, "s", 1000 + i % 20, "") for i in range(400)]
    left = [(7, "s", 1010, "", ""), (7, "s", 1010, "", ""), (8, "s", 1083, "", ""), (9, "s", 1084, "", "")]
    got = sorted((r.lid, r.rid, r.d) for r in nearest_in_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), 64).collect())
    assert got == [(7, 10, 0), (7, 10, 0), (8, 19, 64)]


def test_times_before_zero_and_empty_sides(spark):
    l, r = spark.createDataFrame([(1, "s", -5, "", "")], LEFT), spark.createDataFrame([(2, "s", 3, ""), (1, "s", -13, "")], RIGHT)
    assert [(x.lid, x.rid, x.d) for x in nearest_in_time(l, r, 8).collect()] == [(1, 1, 8)]
    assert nearest_in_time(l, r.where("false"), 8).count() == 0 and nearest_in_time(l.where("false"), r, 8).count() == 0
