import time

import pytest
from pyspark.sql import functions as F

from pulsegrid import errors
from pulsegrid.config import Settings
from pulsegrid.sources import readers as R
from pulsegrid.sources import writers as W
from pulsegrid.streaming import epochs as T


def test_csv_recordings(spark, tmp_path):
    (tmp_path / "a_ACC.csv").write_text("timestamp,X,Y,Z\n1.5,1,2,3\n0.5,4,5,6\n")
    rows = {(r.channel, r.pos): (r.value, str(r.ts)) for r in R.read_recordings(spark, str(tmp_path), "ACC", 2).collect()}
    assert rows["X", 0] == (4.0, "1970-01-01 00:00:00.500000") and rows["Z", 1][0] == 3.0 and len(rows) == 6
    with pytest.raises(errors.SourceError):
        R.read_csv(spark, str(tmp_path), ["X", "nope"])
    assert R.read_csv(spark, str(tmp_path), ["X"]).count() == 2


def test_logs(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "u_m1_e2_events.csv").write_text('Marker,Start,End,Category,Metadata\npose,200,260,Yoga Poses,{}\nx,5,6,Trial Sets,"{\'a\': 1}"\n')
    got = {r.marker: (r.log_key, r.start_time, r.duration) for r in R.read_log_csv(spark, str(tmp_path / "csv")).collect()}
    assert got == {"pose": ("u_m1_e2", 80.0, 60.0), "x": ("u_m1_e2", 5.0, 1.0)}
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "k.txt").write_text("1.5,block_sync: Sstart_YNC, now\nnoise\n2.5,block_rest: a started\n")
    lines = R.read_raw_log(spark, str(tmp_path / "raw")).orderBy("line_no").collect()
    assert [(r.ts, r.content) for r in lines] == [(1.5, "block_sync: start_SYNC, now"), (2.5, "block_rest: a started")]


def test_modalities(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3), (0.2, 0.1, 0.4)], "a double, b double, c double")
    assert R.infer_modality(df) == "ACC" and R.infer_modality(df.select(F.col("a") * 5)) == "TEMP"
    with pytest.raises(errors.SourceError):
        R.infer_modality(df.select("a", "b"))
    s = spark.createDataFrame([("muses-1_PPG",), ("a3_acc",), ("x",)], "s string").select(R.modality_of(F.col("s")), R.sensor_location(F.col("s"))).collect()
    assert [tuple(r) for r in s] == [("PPG", "head"), ("ACC", "wrist"), (None, "unknown")]


def test_round_trip_and_names(spark, data, tmp_path):
    df = spark.read.parquet(f"{data}/signal_long.parquet")
    W.write_signal(df, str(tmp_path / "s"))
    back = R.read_parquet(spark, str(tmp_path / "s"), df.columns)
    assert back.count() == df.count() and (tmp_path / "s" / "session=1" / "modality=ACC").exists()
    with pytest.raises(errors.SinkError):
        W.write_features(df, " ")
    assert W.safe_name('a b/c:"d"') == "a_b_c__d_"


def test_settings_and_retry():
    s = Settings({"root": "/d", "paths": {"in": "${root}/in", "deep": "${paths.in}/x", "loop": "${paths.loop}", "none": "${what}"}})
    assert s.get("paths.deep") == "/d/in/x" and s.get("paths.none") == "${what}" and s.get("paths.loop") == "${paths.loop}" and s.get("no.such", 3) == 3
    calls = []

    @errors.retry(attempts=3, delay=0.0)
    @errors.logged
    def f():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert f() == "ok" and len(calls) == 3


def test_streams_equal_batches(spark, data):
    path = f"{data}/signal_long.parquet"
    got = T.drain(T.tumbling(T.signal_stream(spark, path, "TEMP")), ["sid", "session", "channel", "start"])
    n = spark.read.parquet(path).where("modality = 'TEMP' and value is not null and not isnan(value)").count()
    assert got.agg(F.sum("n")).first()[0] == n
    once = T.drain(T.deduplicated(T.signal_stream(spark, path, "GSR")), [], "append")
    keys = ["sid", "session", "channel", "pos"]
    assert once.count() == once.select(*keys).distinct().count() > 0


def test_spikes_kept_across_micro_batches(spark, tmp_path):
    times = [[0, 5, 5, 11, 12, 40], [45, 51, 80], [90, 91]]
    for i, ts in enumerate(times):  # one file a micro-batch, in the order they were written
        rows = spark.createDataFrame([("s", "ACC", 1, "X", j, 20.0 if t != 12 else None, t) for j, t in enumerate(ts)], "stream_id string, modality string, session int, channel string, pos bigint, value double, t bigint")
        rows.selectExpr("stream_id", "modality", "session", "channel", "pos", "value", "cast(timestamp_micros(t) as timestamp_ntz) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "x"))
        time.sleep(1.1)
    for files in (None, 1):
        got = T.drain(T.spaced(T.signal_stream(spark, str(tmp_path / "x"), "ACC", files), 9.9, 10), [], "append")
        assert sorted(r.t for r in got.collect()) == [0, 11, 40, 51, 80, 91]
