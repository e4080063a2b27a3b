"""Sources, sinks and streams: written and read again."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.sources import files, sinks
from tidefold.streaming import watch


def test_manifest_columns():
    assert files.manifest_columns(["File", "Start", "x", "end_s"]) == (0, 1, 3)
    assert files.manifest_columns(["a"] * 6) == (3, 4, 5) and files.manifest_columns(["a"] * 5) == (2, 3, 4)
    with pytest.raises(ValueError):
        files.manifest_columns(["a"] * 4)


def test_headerless_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("0,1,a.wav,0.5,bad\n1,1,b.wav,1,2\n")
    assert sorted(map(tuple, files.read_manifest_csv(spark, str(tmp_path / "m.csv"), header=False).collect())) == [("a.wav", 0.5, None), ("b.wav", 1.0, 2.0)]


def test_jsonl(spark, tmp_path):
    rows = ['{"audio_filepath": "a.wav", "duration": 2.5, "sample_rate": 1}', "", "{bad", '{"duration": 1}', '{"audio_filepath": "b", "duration": "abc"}', '{"audio_filepath": "c", "duration": 1}']
    (tmp_path / "m.jsonl").write_text("\n".join(rows))
    good, bad = files.read_jsonl(spark, str(tmp_path / "m.jsonl"))
    assert [tuple(r) for r in good.collect()] == [("a.wav", 2.5, 1, 2)]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad_json", "no_duration", "no_path", "no_rate"]


def test_root_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a b/x.wav", 5), ("c.wav", 7)], "rel_path string, n_samples bigint")
    sinks.write_root_tsv(df, "/data", str(tmp_path / "t"))
    rows, bad = files.read_root_tsv(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, rows.collect())) == [("/data", "a b/x.wav", 5), ("/data", "c.wav", 7)] and bad.count() == 0


def test_npy_round_trip(spark, tmp_path):
    spark.dataSource.register(files.NpySource)
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "x.npy", x)
    df = spark.read.format("npy").option("rowsEach", 3).load(str(tmp_path / "x.npy"))
    assert [list(r["embedding"]) for r in df.orderBy("row_index").collect()] == x.tolist()
    sinks.write_npy(df, str(tmp_path / "out"))
    assert sum(len(np.load(p)) for p in (tmp_path / "out").iterdir()) == 4


def test_wav_round_trip(spark, tmp_path):
    sinks.write_wav(spark.createDataFrame([("a", [0.0, 0.5, -0.5, 0.25])], "name string, samples array<double>"), str(tmp_path / "w"), rate=4)
    (tmp_path / "w/bad.wav").write_bytes(b"no")
    out = {r["path"].rpartition("/")[2]: r for r in files.read_audio(spark, str(tmp_path / "w"), samples=True).collect()}
    assert out["a.wav"]["duration"] == 1.0 and out["a.wav"]["samples"][1] == pytest.approx(0.5, abs=1e-3)
    assert out["bad.wav"]["duration"] is None
    assert files.list_files(spark, str(tmp_path / "w"), [".WAV"]).count() == 2


def test_listing_pages(spark, tmp_path):
    spark.dataSource.register(files.ListingSource)
    (tmp_path / "b-p-0").write_text(json.dumps({"items": [{"name": "p/", "size": "0"}, {"name": "p/x.wav", "size": "3"}]}))
    (tmp_path / "b-q-0").write_text("<R xmlns='u'><Contents><Key>q/y.FLAC</Key><Size>4</Size></Contents></R>")
    got = spark.read.format("listing").options(bucket="b", prefixes="p,q", pages=str(tmp_path)).load()
    assert sorted(map(tuple, got.collect())) == [("b", "p/x.wav", 3), ("b", "q/y.FLAC", 4)]


def test_crawl(spark):
    pages = spark.createDataFrame([("h/a", ["h/b", "x/c"]), ("h/b", ["h/a", "h/d"]), ("x/c", ["h/z"])], "url string, links array<string>")
    assert sorted(r[0] for r in files.crawl(pages, "h/a", "h/").collect()) == ["h/a", "h/b", "h/d"]


def test_small_sources(spark, tmp_path):
    assert files.read_json_or(str(tmp_path / "none"), {}) == {}
    got = files.configured_sources(spark, None, [{"bucket": "b/", "prefix": "/p"}, {"bucket": "b", "prefix": "p/"}, {"bucket": "c"}])
    assert [tuple(r)[1:] for r in got.orderBy("pos").collect()] == [("b", "p/"), ("c", "")]
    assert files.archive_params({"a": 1}, {"a": 2}, {"b": None}, {"c": 3}) == {"a": 2, "c": 3}
    (tmp_path / "d").mkdir()
    (tmp_path / "d/manifest.jsonl").write_text("")
    assert len(files.find_manifests(str(tmp_path))) == 1
    z = spark.createDataFrame([(b"0123456789", "f.zip:2:3")], "content binary, at string").select(files.zip_slice()).first()[0]
    assert bytes(z) == b"234"


def test_tasks(spark, tmp_path):
    task = [{"id": 1, "data": {"audio": "a.wav"}, "annotations": [{"was_cancelled": False, "result": [{"value": {"start": 1.0, "end": 2.0, "labels": ["x"]}}]}]}]
    (tmp_path / "t.json").write_text(json.dumps(task))
    r = files.read_tasks(spark, str(tmp_path / "t.json")).first()
    assert r["data"]["audio"] == "a.wav" and r["annotations"][0]["result"][0]["value"]["labels"] == '["x"]'


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "fn string, label string")
    assert sinks.union_of_keys(df, "fn", "label").columns == ["fn", "x", "y"]
    sinks.write_sharded(spark.range(5), "id", 2, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("shard*")) == [f"shard=shard_{i:06d}" for i in range(3)]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, sinks.upsert(old, spark.createDataFrame([("b", 9)], "k string, v int"), "k").collect())) == [("a", 1), ("b", 9)]
    assert [r[0] for r in sinks.report_lines(spark.createDataFrame([(1, 2)], "a int, b int")).collect()] == ["a=1", "b=2"]
    sinks.fan_out(spark.range(4), F.when(F.col("id") < 1, "rejects").otherwise("kept"), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("route = 'kept'").count() == 3
    assert sinks.metric_series(spark.createDataFrame([("r", 1, 0.5, None)], "run string, step int, a double, b double"), "run", "step").count() == 1


def test_streams(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "task string, step int, score double"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)

    add([("t", 1, 0.5), ("u", 1, 0.1)])
    for _ in range(2):  # the second run finds nothing new
        watch.drain(watch.watch(spark, src, schema), watch.append_to(out), ck)
    assert spark.read.json(out).count() == 2
    add([("t", 2, 0.5), ("u", 2, 0.3)])
    watch.drain(watch.watch(spark, src, schema), watch.append_to(out), ck)
    assert spark.read.json(out).count() == 4


def test_retries():
    calls, waits = [], []

    def task():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert watch.with_retries(task, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
