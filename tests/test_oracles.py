"""Every registered query against its SQL in DuckDB."""

import pytest

from tests.compare import rows
from tests.conftest import SMALL
from tidefold.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


NO_SQL = {"edge_segments", "embed_windows", "logreg_probe", "cluster_quality"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NO_SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL


def test_flagship_is_not_trivial(spark):
    out = {(r["is_sound"], r["is_artifact"]): r["n"] for r in QUERIES["label_windows"](spark, SMALL).collect()}
    assert 0 < out[True, False] + out.get((True, True), 0) < sum(out.values())


def test_window_ids_run_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, QUERIES["window_projection"](spark, sf).select("row_index", "window_id").collect()))
    ids = sorted(r[0] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect())
    assert got == list(enumerate(ids)) and len(ids) == 10_000


def test_entry_hides_no_error(tmp_path):
    """Without the subpackage the other queries are there; with it, an error inside it comes out."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tidefold", tmp_path / "tidefold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    say = [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"]
    run = lambda: subprocess.run(say, cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert run().stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
    (tmp_path / "tidefold" / "llm" / "__pycache__").mkdir(parents=True)
    assert run().returncode == 0
    (tmp_path / "tidefold" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tidefold" / "llm" / "queries.py").write_text("import no_such_module")
    (tmp_path / "corpus_pipeline.py").write_text("")
    assert "no_such_module" in run().stderr
