"""Keyed state of streams over restarts: what a batch reads and writes doesn't grow with what came before."""

import time

from tidefold.streaming import state, watch

SCHEMA = "task string, step bigint, score double"


def add(spark, src, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)


def test_best_so_far_over_restarts(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    run = lambda: state.drain_updates(state.best_so_far(watch.watch(spark, src, SCHEMA, per_trigger=1)), out, ck)
    add(spark, src, [("t", 1, 0.5), ("u", 1, 0.1), ("t", 9, 0.5), ("v", 1, None)])
    run()
    assert sorted(map(tuple, state.latest(spark, out, "task").collect())) == [("t", 0.5, 1), ("u", 0.1, 1)]
    run()  # nothing new
    add(spark, src, [("t", 2, 0.5), ("u", 2, 0.3), (None, 1, 1.0)])  # an equal score doesn't count
    again = run()
    assert sorted(map(tuple, state.latest(spark, out, "task").collect()), key=str) == [("t", 0.5, 1), ("u", 0.3, 2), (None, 1.0, 1)]
    last = [p for p in again.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in last] == [3]  # the new file's rows, not those before it
    newest = max(p["batchId"] for p in last)
    assert spark.read.parquet(f"{out}/batch={newest}").count() == 2  # only what changed is written


def test_unseen_over_restarts(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    run = lambda: state.drain_updates(state.unseen(watch.watch(spark, src, "k string, v int", per_trigger=1), "k"), out, ck)
    read = []
    for rows in ([("a", 1), ("a", 2), ("b", 1), (None, 3)], [("a", 9), ("c", 1)], [("c", 2), ("b", 3)], [("d", 1)]):
        add(spark, src, rows, "k string, v int")
        read += [p["numInputRows"] for p in run().recentProgress if p["numInputRows"]]
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]
    assert read == [4, 2, 2, 1]


def test_unseen_forgets(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    run = lambda: state.drain_updates(state.unseen(watch.watch(spark, src, "k string"), "k", forget_ms=1500), out, ck)
    add(spark, src, [("a",)], "k string")
    run()
    time.sleep(2)
    add(spark, src, [("a",), ("b",)], "k string")
    run()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "a", "b"]


def test_settings_come_back(spark):
    name = next(iter(state.STORE))
    before = spark.conf.get(name, None)
    with state.state_store(spark):
        assert spark.conf.get(name) == state.STORE[name]
    assert spark.conf.get(name, None) == before


def test_keys_that_stay_known_are_no_work_for_python(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "k string, v int").write.json(str(tmp_path / "src"))
    plan = state.unseen(watch.watch(spark, str(tmp_path / "src"), "k string, v int"), "k")._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "TransformWithState" not in plan
