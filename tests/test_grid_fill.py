import datetime as dt

import numpy as np

from pulsegrid.operators.grid_fill import LAGS, als_fill, empty_slots, grid_fill, held_out

T0 = dt.datetime(2024, 1, 1)
READ = "stream_id string, session int, modality string, pos bigint, ts timestamp_ntz, channel string, value double, session_note string, slot string"
REC = "stream_id string, session int, rec_start timestamp_ntz, rec_end timestamp_ntz, step_us bigint, value string, channel string"


def at(us):
    return T0 + dt.timedelta(microseconds=us)


def reading(pos, us, channel, value, stream="a_ACC", session=1):
    return (stream, session, "ACC", pos, None if us is None else at(us), channel, value, "extra", "clash")


def rec(slots, stream="a_ACC", session=1, step=100):
    return (stream, session, T0, at(slots * step), step, "clash", "clash")


def cells(df):
    return {(r.channel, r.slot): (r.value, r.status) for r in df.collect()}


def test_als_recovers_a_rank_one_matrix():
    rng = np.random.default_rng(0)
    full = np.outer([1.0, 2.0, -1.5, 0.5], np.sin(np.arange(200) / 7)) + np.array([[5.0], [1.0], [0.0], [-3.0]])
    seen = rng.random(full.shape) < 0.8
    r, c = np.nonzero(seen)
    u, v, m, s = als_fill(r, c, full[r, c], 4, 200, rounds=20, ridge=1e-3)
    back = m[:, None] + s[:, None] * (u[:, :, None] * v[:, None, :]).sum(axis=0)
    supported = seen.sum(axis=0) >= 1
    assert np.abs(back - full)[:, supported].mean() < 0.1


def test_cells_are_observed_filled_or_marked(spark):
    rows = []
    for k in range(20):
        for c in "XYZ":
            if not (k == 5 and c == "Y") and k != 9:
                rows.append(reading(k, k * 100 + 7, c, float(k)))
    rows += [
        reading(3, 3 * 100 + 7, "X", 3.0),  # sent twice
        reading(30, 3 * 100 + 50, "X", 99.0),  # a second reading of the slot
        reading(31, 5 * 100, "Y", float("nan")),
        reading(32, 5 * 100, "Y", None),
        reading(33, None, "Y", 1.0),
        reading(34, -1, "X", 1.0),
        reading(35, 2000, "X", 1.0),  # the end is outside
        reading(36, 100, "nose", 1.0),
        reading(37, 100, "X", 1.0, stream="b_ACC"),  # no such recording
    ]
    got = cells(grid_fill(spark.createDataFrame(rows, READ), spark.createDataFrame([rec(20)], REC)))
    assert len(got) == 60
    assert got["X", 3] == (3.0, "observed")
    assert got["Y", 5][1] == "filled" and abs(got["Y", 5][0] - 5) < 2
    assert all(got[c, 9][1] == "filled" and abs(got[c, 9][0] - 9) < 3 for c in "XYZ")  # a pause of all channels, from the slots around it


def test_the_middle_of_a_long_pause_stays_marked(spark):
    rows = [reading(k, k * 100 + 7, c, float(k % 5)) for k in range(60) for c in "XYZ" if not 20 <= k < 40]
    got = cells(grid_fill(spark.createDataFrame(rows, READ), spark.createDataFrame([rec(60)], REC)))
    for k in range(60):
        want = "observed" if not 20 <= k < 40 else "filled" if k < 20 + LAGS or k >= 40 - LAGS else "unsupported"
        assert {got[c, k][1] for c in "XYZ"} == {want}, k


def test_hidden_cells_are_judged(spark):
    base = np.sin(np.arange(600) / 5)
    rows = [reading(k, k * 100, c, float(g * base[k])) for k in range(600) for c, g in (("X", 1.0), ("Y", 2.0), ("Z", -1.0))]
    out = held_out(spark.createDataFrame(rows, READ), spark.createDataFrame([rec(600)], REC), hidden=100).collect()
    assert {r.channel for r in out} == set("XYZ") and all(30 < r.cells == r.filled and r.error < 0.2 * r.plain for r in out)


def test_one_huge_reading_does_not_bend_the_rest(spark):
    base = np.sin(np.arange(300) / 5)
    rows = [reading(k, k * 100, c, 1e9 if (k, c) == (50, "X") else float(base[k])) for k in range(300) for c in "XYZ" if k % 7 or c != "X"]
    got = cells(grid_fill(spark.createDataFrame(rows, READ), spark.createDataFrame([rec(300)], REC)))
    assert got["X", 50] == (1e9, "observed")
    assert np.mean([abs(got["X", k][0] - base[k]) for k in range(0, 300, 7) if abs(k - 50) > 8]) < 0.15


def test_spelling_of_ids_and_repeated_recordings(spark):
    rows = [reading(0, 0, "X", 1.0, stream=" A_acc ")]
    out = grid_fill(spark.createDataFrame(rows, READ), spark.createDataFrame([rec(2), rec(2)], REC))
    assert {(r.stream_id, r.channel, r.slot) for r in empty_slots(out).collect()} == {("a_ACC", c, s) for c in "XYZ" for s in (0, 1)} - {("a_ACC", "X", 0)}


def test_blocks_do_not_change_which_slots_are_empty(spark):
    rng = np.random.default_rng(1)
    rows = [reading(k, k * 100 + int(rng.integers(100)), c, float(rng.normal())) for k in range(200) for c in "XYZ" if rng.random() < 0.7]
    r, q = spark.createDataFrame(rows, READ), spark.createDataFrame([rec(200), rec(33, "c_ACC")], REC)
    whole, blocks = cells(grid_fill(r, q).where("stream_id = 'a_ACC'")), cells(grid_fill(r, q, block_slots=16).where("stream_id = 'a_ACC'"))
    assert whole.keys() == blocks.keys()
    assert all((whole[k][1] == "observed") == (blocks[k][1] == "observed") for k in whole)
    assert all(whole[k][0] == blocks[k][0] for k in whole if whole[k][1] == "observed")


def test_held_out_cells_are_closer_than_the_mean(spark):
    rng = np.random.default_rng(2)
    base = np.sin(np.arange(300) / 5)
    gain = {"X": 1.0, "Y": 2.0, "Z": -1.0}
    rows = [reading(k, k * 100, c, float(g * base[k] + rng.normal() * 0.05)) for k in range(300) for c, g in gain.items() if rng.random() < 0.8]
    got = cells(grid_fill(spark.createDataFrame(rows, READ), spark.createDataFrame([rec(300)], REC)))
    miss = [(k, v) for k, v in got.items() if v[1] == "filled"]
    err = np.mean([(v - gain[c] * base[k]) ** 2 for (c, k), (v, _) in miss])
    var = np.mean([(gain[c] * base[k]) ** 2 for (c, k), _ in miss])
    assert len(miss) > 100 and err < 0.1 * var


def test_empty_and_broken_inputs(spark):
    none = spark.createDataFrame([], READ)
    assert {s for _, s in cells(grid_fill(none, spark.createDataFrame([rec(3)], REC))).values()} == {"unsupported"}
    bad = [("a_ACC", 1, None, at(9), 100, "", ""), ("b_ACC", 1, T0, at(9), 0, "", ""), (None, 1, T0, at(900), 100, "", ""), ("noname", 1, T0, at(900), 100, "", ""), ("c_ACC", None, T0, at(900), 100, "", "")]
    assert grid_fill(spark.createDataFrame([reading(0, 0, "X", 1.0)], READ), spark.createDataFrame(bad, REC)).count() == 0
    assert grid_fill(none, spark.createDataFrame([], REC)).count() == 0
