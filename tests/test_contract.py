"""What the driver relies on."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = "import sys; sys.modules['pulsegrid.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and not any(n.startswith(('p6_', 'p10_')) for n in q); assert set(e.oracle_sql()) <= set(q)"


def test_core_works_without_the_llm_subpackage():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True)
    for p in (ROOT / "pulsegrid").rglob("*.py"):
        if "llm" not in p.parts:
            assert "pulsegrid.llm" not in p.read_text()


@pytest.mark.parametrize("hidden", ["regex", "pulsegrid.llm.mixing"])
def test_core_works_when_the_llm_subpackage_cannot_be_imported(hidden):
    subprocess.run([sys.executable, "-W", "ignore", "-c", CODE.replace("pulsegrid.llm'", f"{hidden}'")], cwd=ROOT, check=True)


def test_a_cluster_without_a_shared_folder_is_refused():
    from pulsegrid.errors import ConfigurationError
    from pulsegrid.session import shared_folder

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://m:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ConfigurationError, match="spark.checkpoint.dir"):
        shared_folder(cluster)
    made = []
    local = SimpleNamespace(conf=cluster.conf, sparkContext=SimpleNamespace(master="local[2]", setCheckpointDir=made.append, getCheckpointDir=lambda: made[-1] if made else None))
    assert shared_folder(local) == shared_folder(local) and len(made) == 1


def test_scratch_removes_what_was_written(spark):
    import pulsegrid.session as S

    with S.scratch(spark):
        assert S.written(spark.range(3), "test").count() == 3
        folder = S._folders[-1]
        assert Path(folder.removeprefix("file:")).exists()
    assert not Path(folder.removeprefix("file:")).exists()


def test_entry(spark, data):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["stream_id", "session", "channel", "slot"] and df.count() > 0


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p4_found", "p5_found", "covering_merge", "held", "parsed_lines"])
def test_queries_equal_their_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    df = e.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[k] for k in cols) for r in df.collect())))
    want = sorted(map(repr, c.execute(f"select {', '.join(cols)} from ({e.oracle_sql()[name]})").fetchall()))
    assert got == want
