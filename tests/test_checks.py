import logging

import pytest

from pulsegrid import errors as E
from pulsegrid.config import Settings
from pulsegrid.operators import validate as V
from pulsegrid.sources import readers as R
from pulsegrid.sources import writers as W


def test_paths(tmp_path):
    f = tmp_path / "a.CSV"
    f.write_text("x")
    assert V.require_path(str(f), extension=".csv") == str(f) and V.require_path(str(tmp_path), folder=True)
    for bad in ({"path": ""}, {"path": None}, {"path": str(f), "folder": True}, {"path": str(tmp_path)}, {"path": str(f), "extension": ".txt"}):
        with pytest.raises(E.ValidationError):
            V.require_path(**bad)
    with pytest.raises(E.SourceError):
        V.require_path(str(tmp_path / "none"))


def test_arguments():
    @V.checked(rate=V.positive, share=V.in_range(0, 1))
    def f(x, rate, share=0.5):
        return x * rate * share

    assert f(2, 3) == 3.0 and f(2, rate=3, share=1) == 6
    for args in ((1, 0), (1, None), (1, 2, 1.5), (1, 2, None)):
        with pytest.raises(E.ValidationError):
            f(*args)


def test_reports_of_series(spark):
    report = "sid string, session int, channel string, rows bigint, missing bigint, infinite bigint"
    ok = spark.createDataFrame([("s", 1, "X", 5, 0, 0), ("s", 1, "Y", 5, 0, 0)], report)
    assert V.require_readings(ok, 5, 2) is ok
    for df, kw in ((ok, {"least": 6}), (ok, {"most_channels": 1}), (spark.createDataFrame([("s", 1, "X", 5, 1, 0)], report), {}), (ok.where("false"), {})):
        with pytest.raises(E.ValidationError):
            V.require_readings(df, **kw)
    assert V.columns_like(ok, "s") == ["sid", "session", "rows", "missing"]


def test_paths_of_settings(tmp_path):
    s = Settings({"root": str(tmp_path), "paths": {"raw": "${root}/raw", "out": {"features": "${paths.raw}/f"}, "n": 3}})
    assert s.get_all_paths() == {"raw": f"{tmp_path}/raw", "out.features": f"{tmp_path}/raw/f"}
    assert s.get_path("raw", make=True) == f"{tmp_path}/raw" and (tmp_path / "raw").is_dir()
    with pytest.raises(E.ConfigurationError):
        s.get_path("nowhere")


def test_errors_are_kept_and_logged(tmp_path, caplog):
    r = E.ErrorReport()
    for x in (1, 0, 0):
        with r.step(f"step {x}", ZeroDivisionError):
            1 / x
    assert r.counts() == {"ZeroDivisionError": 2}
    with pytest.raises(E.PulsegridError, match="step 0"):
        r.check()
    E.ErrorReport().check()
    assert E.handled(ZeroDivisionError, default=7)(lambda: 1 / 0)() == 7
    log = E.set_up_logging("INFO", str(tmp_path / "log"))
    E.set_up_logging("INFO", str(tmp_path / "log"))
    p = E.Progress(20)
    for _ in range(20):
        p.step()
    assert len(log.handlers) == 2 and (tmp_path / "log").read_text().count("steps:") == 10
    for h in list(log.handlers):
        log.removeHandler(h)
    logging.getLogger("pulsegrid").setLevel(logging.NOTSET)


def test_untimed_files_and_all_sessions(spark, tmp_path):
    (tmp_path / "m_EEG.csv").write_text("\n".join(f"{i},{i + 1},{i + 2},{i + 3},9" for i in range(512)))
    rows = R.read_untimed(spark, str(tmp_path / "m_EEG.csv"), 2)
    assert rows.count() == 4 * 512 and {r[0] for r in rows.select("channel").distinct().collect()} == {"AF7", "AF8", "TP9", "TP10"}
    last = rows.where("channel = 'AF8' and pos = 256").first()
    assert last.value == 257 and last.ts.second == 1 and last.session == 2 and last.stream_id == "m_EEG" and last.modality == "EEG"
    five = spark.createDataFrame([(1.0,) * 5], "a double, b double, c double, d double, e double")
    assert R.format_eeg(five).columns == ["AF7", "AF8", "TP9", "TP10"]
    with pytest.raises(E.SourceError):
        R.format_eeg(five.drop("e"))
    W.write_all_sessions(five, str(tmp_path), "ACC")
    assert list(R.read_all_sessions(spark, str(tmp_path), ["ACC", "BVP"])) == ["ACC"]
    (tmp_path / "yoga.csv").write_text("yoga pose,duration (seconds)\ntree,30\n")
    assert R.read_yoga(spark, str(tmp_path / "yoga.csv")).first() == ("tree", 30.0)
