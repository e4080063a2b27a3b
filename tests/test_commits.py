"""Sinks that commit: files of failed attempts are never seen, tables are replaced while they are read."""

import os
import subprocess
import sys
import threading
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidefold.sources import commit, sinks, snapshots

ROOT = Path(__file__).resolve().parents[1]


def files(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file())


def batch(*rows):
    return pa.record_batch({"name": [n for n, _ in rows], "content": pa.array([c for _, c in rows], pa.binary())})


def test_only_committed_attempts_are_seen(tmp_path):
    writer = commit.WholeFilesWriter(str(tmp_path))
    lost = writer.write([batch(("a", b"1"), ("d/b", b"22"))])  # an attempt whose message never came
    good = writer.write([batch(("a", b"1"), ("d/b", b"22"))])
    other = writer.write([batch(("c", b""))])
    assert lost.attempt != good.attempt and all(f.startswith("_staging/") for f in files(tmp_path))
    writer.commit([good, None, other])
    assert files(tmp_path) == ["a", "c", "d/b"] and (tmp_path / "d" / "b").read_bytes() == b"22"
    writer = commit.WholeFilesWriter(str(tmp_path))
    writer.abort([writer.write([batch(("z", b"1"))])])
    assert files(tmp_path) == ["a", "c", "d/b"] and not (tmp_path / "_staging").exists()


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from tidefold.sources import sinks
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.range(0, 40, 1, 4).selectExpr("concat('f', id) name", "array(0.5D, id / 100D) samples")

def dies(batches):
    from pyspark import TaskContext
    for pdf in batches:
        for i in range(len(pdf)):
            yield pdf.iloc[i : i + 1]
            if i == 5 and TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() in (1, 2):
                os._exit(1)

sinks.write_wav(df.mapInPandas(dies, df.schema), sys.argv[1], rate=4)
"""


def test_a_killed_first_attempt_leaves_nothing(tmp_path):
    """Workers of two tasks die in the middle of their files; their second attempts write them."""
    run = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path / "w")], capture_output=True, text=True, timeout=150, cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert run.returncode == 0, run.stderr[-2000:]
    assert "exited unexpectedly" in run.stderr or "Lost task" in run.stderr
    assert files(tmp_path / "w") == sorted(f"f{i}.wav" for i in range(40))
    assert len({(tmp_path / "w" / f).stat().st_size for f in files(tmp_path / "w")}) == 1


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 37, F.raise_error(F.lit("no"))).otherwise(F.array(F.lit(0.5))).alias("samples"))
    with pytest.raises(Exception, match="no"):
        sinks.write_wav(df, str(tmp_path), rate=4)
    assert files(tmp_path) == []


def test_npy_parts_and_tables(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("row_index"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    sinks.write_npy(df, str(tmp_path / "n"), rows_each=4)
    parts = [np.load(tmp_path / "n" / f) for f in files(tmp_path / "n")]
    assert np.concatenate(parts).tolist() == [[float(i), 1.0] for i in range(10)]
    sinks.write_npy(df.limit(2), str(tmp_path / "one"), name=F.concat(F.lit("a/"), F.col("row_index").cast("string")))
    assert files(tmp_path / "one") == ["a_0.npy", "a_1.npy"] and np.load(tmp_path / "one" / "a_1.npy").tolist() == [1.0, 1.0]
    events = spark.createDataFrame([("x", 1.0, 2.0, "s"), ("x", 0.5, 0.75, "t")], "fn string, start_s double, end_s double, label string")
    sinks.selection_tables(events, spark.createDataFrame([("x",), ("y",), ("x",)], "fn string"), str(tmp_path / "t"))
    head = "Begin Time (s)\tEnd Time (s)\tAnnotation\n"
    assert {f: (tmp_path / "t" / f).read_text() for f in files(tmp_path / "t")} == {"x.txt": head + "0.5\t0.75\tt\n1.0\t2.0\ts\n", "y.txt": head}


def test_a_reader_never_fails_while_a_table_is_replaced(spark, tmp_path):
    at, seen, stop = str(tmp_path / "t"), [], threading.Event()
    assert snapshots.write_snapshot(spark.range(3), at) == 3

    def read():
        while not stop.is_set():
            try:
                seen.append(snapshots.read_snapshot(spark, at).count())
            except Exception as e:  # what the test is about
                seen.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in (5, 7, 9, 11, 13):
        assert snapshots.write_snapshot(spark.range(n), at) == n
    stop.set()
    reader.join(60)
    assert set(seen) <= {3, 5, 7, 9, 11, 13} and len(seen) > 5
    with pytest.raises(ValueError):
        snapshots.write_snapshot(spark.range(0), at, least_rows=1)
    assert snapshots.read_snapshot(spark, at).count() == 13
    assert snapshots.write_snapshot(spark.range(0), at) == 0 and snapshots.read_snapshot(spark, at).columns == ["id"]
    assert snapshots.read_snapshot(spark, at).count() == 0


def test_an_upsert_writes_the_ranges_that_it_touches(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = spark.range(1000).select("id", F.lit(0).alias("v"))
    snapshots.write_snapshot(rows, at, "id", ranges=5)
    before = [r["folder"] for r in snapshots._current(spark, at)["ranges"]]
    new = spark.createDataFrame([(3, 9), (5, 9), (-7, 9)], "id long, v int")
    assert snapshots.upsert_snapshot(new, at, "id") == 1
    after = [r["folder"] for r in snapshots._current(spark, at)["ranges"]]
    assert before[1:] == after[1:] and before[0] != after[0]
    want = {i: 0 for i in range(1000)} | {3: 9, 5: 9, -7: 9}
    assert dict(map(tuple, snapshots.read_snapshot(spark, at).collect())) == want
    assert snapshots.upsert_snapshot(spark.createDataFrame([(999, 1), (5000, 1), (3, 2)], "id long, v int"), at, "id") == 2
    assert dict(map(tuple, snapshots.read_snapshot(spark, at).collect())) == want | {999: 1, 5000: 1, 3: 2}
    assert snapshots.upsert_snapshot(new.limit(0), at, "id") == 0
    first = str(tmp_path / "first")
    snapshots.upsert_snapshot(new, first, "id")
    assert snapshots.read_snapshot(spark, first).count() == 3
