"""Annotation tasks, audio, settings, listings, atomic writes and large groups: small cases with worked-out answers."""

import json
import math
from collections.abc import Iterator

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.functions import paths, scalars
from tidefold.operators import annotations, audio, dedup, filters, frames, intervals, models, nested, sampling
from tidefold.sources import files, settings, sinks, storage
from tidefold.streaming import watch


def flat(spark, tasks, **options):
    rows = spark.createDataFrame([(json.dumps(tasks),)], "value string")
    return [r.asDict() for r in annotations.flatten(annotations.tasks_of(rows), **options).orderBy("row_id").collect()]


@pytest.mark.parametrize("labels,want", [(None, ["unknown"]), ("a", ["a"]), (["a", "b"], ["a", "b"]), (["", None], ["unknown"]), (7, ["7"])])
def test_label_forms(spark, labels, want):
    out = flat(spark, [{"id": 1, "label": [{"start": 0, "end": 1, "labels": labels}]}])
    assert [r["label"] for r in out] == want and {r["label_count"] for r in out} == {len(want)}
    assert [r["label"] for r in flat(spark, [{"label": [{"labels": labels}]}], joined=True)] == ["|".join(want)]


def test_cancelled_and_malformed_annotations_go(spark):
    value = {"start": 1, "end": 3, "labels": ["x"]}
    tasks = [
        {"id": 5, "data": {"wav": "a\\b.wav"}, "annotations": [{"was_cancelled": True, "result": [{"value": value}]}, {"was_cancelled": None, "result": [{"value": value}, {"value": {"start": 1}}, {"value": 3}, "x", {}]}, 4, {"result": "no list"}]},
        "no map",
        {"annotations": {"no": "list"}},
        {"label": "not a list", "annotations": [{"result": [{"value": {"start": 5, "end": 2, "choices": ["c"], "labels": []}}]}]},
        {"label": [], "annotations": [{"result": [{"value": value}]}]},
    ]
    out = flat(spark, tasks)
    assert [(r["file_index"], r["event_index"], r["label"], r["duration_s"]) for r in out] == [(0, 0, "x", 2.0), (3, 0, "c", 0.0)]
    assert out[0]["audio"] == "a/b.wav" and out[0]["source_id"] == "5" and out[1]["audio"] == "" and [r["row_id"] for r in out] == [0, 1]
    with pytest.raises(Exception, match="JSON list"):
        annotations.tasks_of(spark.createDataFrame([('{"a": 1}',)], "value string")).collect()
    assert annotations.flatten(annotations.tasks_of(spark.createDataFrame([("[]",)], "value string"))).count() == 0


def test_resampler_is_its_filter_and_cuts_do_not_matter():
    x = np.random.default_rng(0).standard_normal(500)
    for rate, target in ((16_000, 6_000), (8_000, 44_100), (3, 2)):
        both = math.gcd(rate, target)
        up, down = target // both, rate // both
        taps, half = audio._kernel(up, down)
        n = -(-len(x) * up // down)
        want = np.zeros(n)
        for k in range(n):
            for i in range(len(x)):
                j = k * down - i * up + half
                if 0 <= j < len(taps):
                    want[k] += x[i] * taps[j]
        assert np.allclose(audio.resample(x, rate, target), want, atol=1e-5)
        state, parts = audio.Resampler(rate, target), []
        for block in np.split(x, [1, 3, 90, 91, 300]):
            parts.append(state.feed(block))
        parts.append(state.feed(np.zeros(0), last=True))
        assert np.allclose(np.concatenate(parts), want, atol=1e-5)
    tone = np.sin(2 * math.pi * 100 * np.arange(8000) / 8000)
    want = np.sin(2 * math.pi * 100 * np.arange(4000) / 4000)
    assert np.abs(audio.resample(tone, 8000, 4000) - want)[200:-200].max() < 1e-2


def test_blocks_equal_the_whole(spark):
    x = np.random.default_rng(1).standard_normal(1000).astype(np.float32)
    rows = [("f", i, x[i * 90 : (i + 1) * 90].tolist()) for i in range(12)] + [("g", 0, [0.5] * 10)]
    df = spark.createDataFrame(rows, "f string, i int, s array<float>")
    out = audio.resample_blocks(df, "f", "i", "s", 8, 5, 64).orderBy("chunk").collect()
    got = np.concatenate([r["samples"] for r in out if r["f"] == "f"])
    assert np.allclose(got, audio.resample(x, 8, 5), atol=1e-6) and all(len(r["samples"]) == 64 for r in out if r["f"] == "f" and r["chunk"] < 9)
    assert [len(r["samples"]) for r in out if r["f"] == "g"] == [7]
    assert audio.frame_gain(np.ones(10), 4) == 0.0 and audio.frame_gain(np.zeros(3), 4) == -80.0


def test_yaml_round_trip(tmp_path):
    value = {"a": 1, "b": {"c": "x: y", "d": [1, "two", None], "e": {}, "f": []}, "g": "true", "h": 0.5, "i": True, "j": ""}
    sinks.write_yaml(value, str(tmp_path / "c.yaml"))
    assert settings.read_settings(str(tmp_path / "c.yaml")) == value
    assert settings.parse_yaml("# note\na: [1, b]\nl:\n- x\n- 2\nm:\n  n: 'q'\n") == {"a": [1, "b"], "l": ["x", 2], "m": {"n": "q"}}
    assert settings.read_settings(str(tmp_path / "none.yml"), 7) == 7 and settings.parse_yaml("") is None
    with pytest.raises(ValueError):
        settings.parse_yaml("a: 1\n  b: 2")
    assert settings.keep_known({"a": {"x": 1, "y": 2}, "z": 3}, {"a": {"x": 0}}) == {"a": {"x": 1}}


def test_files_are_whole_or_not_there(tmp_path):
    at = str(tmp_path / "d" / "f.bin")
    storage.write_bytes(at, b"one")
    storage.write_bytes("file:" + at, b"three")
    assert storage.names(str(tmp_path / "d")) == ["f.bin"] and storage.open_input(at).read() == b"three"


def test_pages_follow_tokens_and_fall_back():
    assert files.next_token('{"items": [], "nextPageToken": "x"}') == "x" and files.next_token("{}") == ""
    xml = "<R xmlns='u'><IsTruncated>true</IsTruncated><Contents><Key>k1</Key><Size>1</Size></Contents></R>"
    assert files.next_token(xml) == "k1" and files.next_token(xml.replace("true", "false")) == ""
    assert files.month_prefixes("d/{year}/{month}/", [2020], [1, "11"]) == ["d/2020/01/", "d/2020/11/"]
    reader = files._ListingReader({"bucket": "b", "prefixes": "p"})
    with pytest.raises(ValueError, match="comes back"):
        list(reader._listed(lambda *a: '{"items": [], "nextPageToken": "x"}', "json", "p"))


def test_saved_pages_are_opened_by_name(tmp_path, monkeypatch):
    """However many pages a folder holds, it is never listed; pages come one at a time; XML replaces a JSON listing that breaks off."""
    from pyarrow import fs

    n = 50
    page = lambda i: {"items": [{"name": f"{i:03d}", "size": i}], **({"nextPageToken": f"t{i + 1}"} if i < n - 1 else {})}
    for i in range(n):
        for prefix in "pq":
            bad = prefix == "q" and i == 7
            (tmp_path / f"b-{prefix}-json-{f't{i}' if i else 0}").write_text("<html>" if bad else json.dumps(page(i)))
    (tmp_path / "b-q-xml-0").write_text("<R><IsTruncated>true</IsTruncated><Contents><Key>x1</Key><Size>1</Size></Contents></R>")
    (tmp_path / "b-q-xml-x1").write_text("<R><IsTruncated>false</IsTruncated><Contents><Key>x2</Key><Size>2</Size></Contents></R>")
    selected = []
    real = fs.FileSelector
    monkeypatch.setattr(fs, "FileSelector", lambda *a, **k: selected.append(a) or real(*a, **k))
    reader = files._ListingReader({"bucket": "b", "prefixes": "p,q", "pages": str(tmp_path)})
    assert isinstance(reader.pages("p"), Iterator)
    assert [k for _, _, keys in reader.pages("p") for k in keys] == [(f"{i:03d}", i) for i in range(n)]
    assert [(kind, k) for kind, _, keys in reader.pages("q") for k in keys] == [("xml", ("x1", 1)), ("xml", ("x2", 2))]
    assert selected == []
    with pytest.raises(FileNotFoundError):
        list(reader.pages("none"))


def test_tasks_are_parsed_once(spark):
    """Bounds of ranges, the order and the numbers take the parsed rows; what is no map is no event wherever it stands."""
    parsed = spark.sparkContext.accumulator(0)

    def counted(text):
        parsed.add(1)
        return text

    odd = ["x", 7, None, [{"start": 1, "end": 2}], {"start": 1}, {"start": 1, "end": 2, "labels": ["a", "b"]}, {"start": [1], "end": {"x": 1}, "choices": "c"}]
    task = json.dumps({"id": 1, "annotations": [{"result": [{"value": v} for v in odd]}]})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([task, "7", '"no task"', "[1]", "\t\n" + task, "{bad", ""] * 3)], "file_index long, task string").repartition(3)
    out = annotations.flatten(rows.withColumn("task", F.udf(counted, "string").asNondeterministic()("task"))).collect()
    assert parsed.value == rows.count()
    out = sorted(map(tuple, out), key=lambda r: r[0])
    assert [r[0] for r in out] == list(range(18)) and [r[1:4] for r in out] == sorted(r[1:4] for r in out)
    assert [(r[6], r[7], r[10], r[11]) for r in out[:3]] == [(1.0, 2.0, "a", 2), (1.0, 2.0, "b", 2), (None, None, "c", 1)] and {r[1] for r in out} == {0, 4, 7, 11, 14, 18}
    plain = annotations.flatten(rows, numbered=False).collect()
    assert sorted(map(tuple, plain), key=lambda r: r[:3]) == [r[1:] for r in out]


def test_archive_lists_are_put_together(monkeypatch):
    """A frame for many requests, not one for each; long lists are given out on the way."""
    import pandas as pd

    class Requests:
        def mapInPandas(self, run, schema):
            return list(run([pd.DataFrame({"target": [f"t{i}" for i in range(500)], "params": [{"n": str(i % 3)} for i in range(500)]})]))

    fetch = lambda params: [(f"f{i}", i) for i in range(int(params["n"]))]
    whole = files.fetch_archives(Requests(), fetch)
    want = [(f"t{i}", f"f{j}", j) for i in range(500) for j in range(i % 3)]
    assert len(whole) == 1 and list(whole[0].itertuples(index=False, name=None)) == want
    monkeypatch.setattr(files, "FETCHED_ROWS", 100)
    parts = files.fetch_archives(Requests(), fetch)
    assert 4 <= len(parts) <= 6 and [r for p in parts for r in p.itertuples(index=False, name=None)] == want


def test_archive_needs_a_token(spark, monkeypatch):
    monkeypatch.delenv("TIDEFOLD_TOKEN", raising=False)
    with pytest.raises(ValueError):
        files.archive_requests(spark, [], {}, {}, token_variable="TIDEFOLD_TOKEN")
    monkeypatch.setenv("TIDEFOLD_TOKEN", "s")
    r = files.archive_requests(spark, [{"name": "a", "core": {"x": 1}, "extra": {"x": 2, "y": 3}}], {"y": 1}, {}, token_variable="TIDEFOLD_TOKEN").first()
    assert r["params"] == {"x": "1", "y": "3", "token": "s"}


def test_24_bit_audio():
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(3)
        w.setframerate(4)
        w.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in (0, 4194304, -8388608)))
    rate, frames_, x = files._wav(out.getvalue())
    assert (rate, frames_) == (4, 3) and x.tolist() == [0.0, 0.5, -1.0]


def test_large_groups_over_tasks(spark, monkeypatch):
    """The same sums, places and sizes whether a group is sorted by one task or by all."""
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 500).alias("o"), (F.col("id") % 7).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("w"))
    sums = {"s": F.col("v"), "t": F.col("w"), "n": F.lit(1)}
    small = sorted(map(tuple, frames.running_in_groups(df, ["g"], ["o"], sums, counts="c").collect()), key=str)
    monkeypatch.setattr(frames, "GROUP_ROWS", 10)
    assert sorted(map(tuple, frames.running_in_groups(df, ["g"], ["o"], sums, counts="c").collect()), key=str) == small
    split = sorted(map(tuple, sampling.ranked_split(df, "g", "o", (0.2, 0.1), 1).collect()), key=str)
    ema = {r["g"]: r["ema"] for r in frames.ema(df, "g", "o", "v", 0.3).collect()}
    monkeypatch.setattr(frames, "GROUP_ROWS", 10**6)
    assert sorted(map(tuple, sampling.ranked_split(df, "g", "o", (0.2, 0.1), 1).collect()), key=str) == split
    for g, rows in df.toPandas().sort_values("o").groupby("g"):
        acc = None
        for v in rows["v"]:
            acc = float(v) if acc is None else 0.3 * v + 0.7 * acc
        assert ema[g] == pytest.approx(acc)
    nulls = frames.running_in_groups(spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, o int"), ["g"], ["o"], {"n": F.lit(1)})
    assert sorted((str(r["g"]), r["n"]) for r in nulls.collect()) == [("None", 1), ("None", 2), ("a", 1)]


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_buckets_in_semi_and_anti_joins(spark, how):
    w = spark.range(80).select(F.lit("f").alias("k"), (F.col("id") * 7.0).alias("start_s"), (F.col("id") * 7.0 + F.col("id") % 40).alias("end_s"))
    w = w.union(w.limit(3)).unionByName(spark.createDataFrame([("f", None, 3.0), (None, 0.0, 9.0)], "k string, start_s double, end_s double"))
    e = spark.range(40).select(F.lit("f").alias("k"), (F.col("id") * 23.0).alias("event_start"), (F.col("id") * 23.0 + F.col("id") % 9).alias("event_end"))
    plain = sorted(map(tuple, intervals.overlap_join(w, e, "k", 0.5, how=how).collect()), key=str)
    assert sorted(map(tuple, intervals.overlap_join(w, e, "k", 0.5, bucket_s=10.0, how=how).collect()), key=str) == plain and plain


def test_rare_labels_get_their_share(spark):
    rows = [(i, (["rare"] if i % 20 == 0 else []) + (["odd"] if i % 2 else []) + ["all"] * (i < 90)) for i in range(100)]
    out = models.iterative_split(spark.createDataFrame(rows, "id long, l array<string>"), "id", "l", 0.2, 1).collect()
    assert len(out) == 100 and all(r["is_valid"] is not None for r in out)
    valid = lambda name: sum(r["is_valid"] for r in out if name in r["l"])
    assert (valid("rare"), valid("odd"), valid("all")) == (1, 10, 18)


def test_folds_keep_one_row(spark):
    rows = [("a", i, n) for i, n in enumerate([3, 9, 4, 50, 2])] + [("b", 0, None), ("b", 1, 7)]
    df = spark.createDataFrame(rows, "k string, o int, n int")
    assert sorted(map(tuple, frames.greedy_budget(df, "k", "o", "n", 10).collect())) == [("a", 2, 12.0), ("b", 1, 7.0)]
    assert sorted(map(tuple, frames.shard_align(df, "k", "o", "n", 10).collect())) == [("a", 0, 0), ("a", 1, 10), ("a", 2, 20), ("a", 3, 24), ("a", 4, 74), ("b", 1, 0)]


def test_rows_side_by_side_need_one_length(spark):
    with pytest.raises(ValueError):
        dedup.aligned(spark.range(3), spark.range(4), "id")


def test_links_against_a_base(spark):
    cases = {"x": "http://h/a/x", "../x": "http://h/x", "../../x": "http://h/x", "./": "http://h/a/", "/r?q": "http://h/r?q", "//o/p": "http://o/p", "https://z": "https://z", "mailto:me": "mailto:me", "b/../c/./d#e": "http://h/a/c/d#e"}
    df = spark.createDataFrame([(k,) for k in cases], "href string")
    assert {r["href"]: r["u"] for r in df.select("href", paths.join_url("http://h/a/b.html", "href").alias("u")).collect()} == cases


def test_slopes():
    assert scalars.alibi_slopes(4) == [0.25, 0.0625, 0.015625, 0.00390625] and len(scalars.alibi_slopes(6)) == 6


def test_streams_that_end_and_remember(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int").coalesce(1).write.mode("append").json(src)
    waits = []
    assert watch.run_until_idle(watch.watch(spark, src, "k string, v int"), watch.append_to(out), ck, empty_polls=2, poll_s=5.0, sleep=waits.append) == 1
    assert waits == [5.0, 5.0]
    best = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "task string, score double")
    assert watch.composite(best, {"a": 1.0, "b": 3.0}).first()[0] == 0.875 and watch.composite(best, {"a": 1.0, "z": 1.0}).first()[0] is None


def test_pruned_walk(spark):
    names = ["r/manifest.jsonl", "r/1.wav", "r/2.WAV", "r/s/manifest.jsonl", "r/s/t/manifest.jsonl", "q/manifest.jsonl", "q/s/manifest.jsonl", "q/1.wav"]
    df = spark.createDataFrame([("/x/" + n,) for n in names], "path string")
    assert sorted(r[0] for r in files.pruned_manifests(df, 1).collect()) == ["/x/q/manifest.jsonl", "/x/q/s/manifest.jsonl", "/x/r/manifest.jsonl"]


def test_leaves():
    assert list(nested.leaves({"a": {"b": 1, "c": None, "d": {}}, "e": "x", "f": [1], "g": True})) == [("a.b", "1"), ("e", "x"), ("f", "[1]"), ("g", "true")]


def test_filters(spark):
    df = spark.createDataFrame([(1, 16_000, 5.0, "a/MBF01.wav"), (2, 8_000, None, "b/x_mbf01.wav"), (3, None, 0.5, "mbf01/y.wav")], "id int, rate int, d double, name string")
    ids = lambda out: sorted(r["id"] for r in out.collect())
    assert ids(filters.exact_length(df, "rate", 8_000)) == [2] and ids(filters.at_least(df, rate=8_000)) == [1, 2]
    assert ids(filters.duration_between(df, "d", 1)) == [1] and ids(filters.duration_between(df, "d", high=1)) == [3]
    assert ids(filters.without_any(df, "name", ["a/", "y"])) == [2] and ids(filters.with_any(df, "name", ["a/", "y"])) == [1, 3]
    assert ids(filters.of_individual(df, "name", "Mbf01").where("is_individual")) == [1, 2]
    lookup = spark.createDataFrame([("x_", "file_Q9_1"), ("zz", "file_Q8")], "RandomizedName string, OriginalName string")
    assert ids(filters.of_individual(df, "name", "Q9", lookup).where("is_individual")) == [2]
    sizes = spark.createDataFrame([(1, 0), (2, 9)], "id int, label_size int")
    assert ids(filters.labelled_enough(df.fillna(0), sizes, "id", "rate", "label_size", 0)) == [2]


def test_running_sums_backwards_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(frames, "GROUP_ROWS", 5)
    df = spark.range(60).select((F.col("id") % 2).alias("g"), "id")
    out = {r["id"]: r["n"] for r in frames.running_in_groups(df, ["g"], [F.desc("id")], {"n": F.lit(1)}).collect()}
    assert out == {i: 30 - i // 2 for i in range(60)}
