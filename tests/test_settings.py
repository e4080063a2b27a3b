"""Settings files: YAML's own rules, a folder over all tasks, sources and requests from tables."""

import json

import pytest
from pyspark.sql import functions as F

from tidefold.sources import files, settings


def test_yaml_values():
    assert settings.parse_yaml('x: ["a,b", c]') == {"x": ["a,b", "c"]}
    assert settings.parse_yaml('a: "x" # note') == {"a": "x"}
    assert settings.parse_yaml("k: {a: 1}") == {"k": {"a": 1}}
    for bad in ("a: 1\na: 2", "a: {b: 1, b: 2}", "a: [1", "a: !!python/object/apply:os.getcwd []"):
        with pytest.raises(ValueError):
            settings.parse_yaml(bad)


def test_a_folder_of_settings(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("x: 1\ny: {z: [1, 2], w: no}\nq: 0")
    (tmp_path / "b.json").write_text("\ufeff" + json.dumps({"y": {"z": None}, "e": {}}))
    (tmp_path / "c.yml").write_text("a: 1\n  b: 2")
    (tmp_path / "d.json").write_text("[1]")
    (tmp_path / "e.txt").write_text("x: 1")
    every = sorted(map(tuple, settings.scan_settings(spark, str(tmp_path)).collect()), key=str)
    assert every == [("a.yaml", "q", "0"), ("a.yaml", "x", "1"), ("a.yaml", "y.w", "false"), ("a.yaml", "y.z", "[1,2]"), ("b.json", "e", "{}"), ("b.json", "y.z", "null"), ("c.yml", None, None), ("d.json", "", "[1]")]
    known = settings.scan_settings(spark, str(tmp_path), {"y": {"z": 0}}).where("path is not null and path <> ''")
    assert sorted(map(tuple, known.collect())) == [("a.yaml", "y.z", "[1,2]"), ("b.json", "y.z", "null")]


def test_requests_and_sources_from_tables(spark):
    rows = [("a", {"x": "1"}, {"x": "2", "y": "3"}), ("b", None, None)]
    made = spark.createDataFrame(rows, "target string, core map<string,string>, extra map<string,string>")
    got = {r["target"]: r["params"] for r in files.archive_request_table(made, {"y": 1, "z": 5}, {"z": 6}, "t").collect()}
    assert got == {"a": {"x": "1", "y": "3", "z": "6", "token": "t"}, "b": {"y": "1", "z": "6", "token": "t"}}
    listed = [r["params"] for r in files.archive_requests(spark, [{"name": "a", "core": {"x": 1}, "extra": {"x": 2, "y": 3}}], {"y": 1, "z": 5}, {"z": 6}, token="t").collect()]
    assert listed == [got["a"]]
    s = spark.createDataFrame([(0, "b/", "/p"), (1, "b", "p/"), (2, "/c", None), (3, "c", "")], "pos int, bucket string, prefix string")
    assert sorted(map(tuple, files.source_table(s).collect())) == [(0, "b", "p/"), (2, "c", "")]
