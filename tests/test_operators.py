"""Operators on small cases with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidefold.functions import paths, scalars
from tidefold.operators import dedup, frames, intervals, metrics, sampling


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("start,hit", [(4.75, True), (4.875, False), (5.25, False)])
def test_overlap_threshold(spark, start, hit):
    w = spark.createDataFrame([("f", 0.0, 5.0)], "k string, start_s double, end_s double")
    e = spark.createDataFrame([("f", start, 6.0)], "k string, event_start double, event_end double")
    assert (intervals.overlap_join(w, e, "k", 0.25, how="left_semi").count() == 1) is hit


def test_overlap_of_nulls_is_null(spark):
    df = spark.createDataFrame([(0.0, 5.0, None, None)], "a double, b double, c double, d double")
    assert df.select(intervals.overlap("a", "b", "c", "d")).first()[0] is None


def test_windows_without_events_have_no_label(spark):
    w = spark.createDataFrame([("f", 0.0, 5.0), ("g", 0.0, 5.0)], "k string, start_s double, end_s double")
    e = spark.createDataFrame([("f", 1.0, 2.0, "artifact"), ("f", 4.0, 9.0, "sound")], "k string, event_start double, event_end double, label string")
    out = {r["k"]: (r["is_sound"], r["is_artifact"]) for r in intervals.label_windows(w, e, "k", 0.1).collect()}
    assert out == {"f": (True, True), "g": (False, False)}


def test_bucketed_join_equals_plain(spark):
    w = spark.range(60).select(F.lit("f").alias("k"), (F.col("id") * 7.0).alias("start_s"), (F.col("id") * 7.0 + 15).alias("end_s"))
    e = spark.range(40).select(F.lit("f").alias("k"), (F.col("id") * 11.0).alias("event_start"), (F.col("id") * 11.0 + F.col("id") % 30).alias("event_end"))
    plain = intervals.overlap_join(w, e, "k", 0.5).select("w.start_s", "e.event_start").collect()
    cut = intervals.overlap_join(w, e, "k", 0.5, bucket_s=10.0).select("w.start_s", "e.event_start").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, cut)) and plain


def test_basename_fan_out(spark):
    e = spark.createDataFrame([("d/x.wav",), ("y\\z.wav",), ("w.wav",)], "audio string")
    assert sorted(r[0] for r in intervals.fan_out_basename(e).collect()) == ["d/x.wav", "w.wav", "x.wav", "y\\z.wav", "z.wav"]


@pytest.mark.parametrize("strict,want", [(True, [1, 0, 0, 1, 0, 1]), (False, [1] * 6)])
def test_segment_clip(spark, strict, want):
    events = [(9.0, 11.0), (10.0, 15.0), (12.0, 20.0), (12.0, 15.0), (10.0, 20.0), (5.0, 25.0)]
    df = spark.createDataFrame([(i, 10.0, 20.0, s, e) for i, (s, e) in enumerate(events)], "i int, seg_start double, seg_end double, event_start double, event_end double")
    kept = {r["i"] for r in intervals.clip_to_segment(df, strict).collect()}
    assert [int(i in kept) for i in range(6)] == want


def test_iou_counts(spark):
    t = spark.createDataFrame([("c", 1, 0.0, 10.0)], "k string, id int, t0 double, t1 double")
    p = spark.createDataFrame([("c", 1, 5.0, 15.0)], "k string, id int, p0 double, p1 double")
    assert tuple(intervals.match_by_iou(t, p, "k", 0.0).first())[1:4] == (1, 0, 0)
    assert tuple(intervals.match_by_iou(t, p, "k", 0.5).first())[1:4] == (0, 1, 0)


def test_bracket(spark):
    mins = spark.createDataFrame([("s", float(x)) for x in (0, 4, 9)], "k string, pos double")
    maxs = spark.createDataFrame([("s", 4.0), ("s", 6.0)], "k string, pos double")
    assert sorted(map(tuple, intervals.bracket(maxs, mins, "k").collect())) == [("s", 4.0, 0.0, 9.0), ("s", 6.0, 4.0, 9.0)]


def test_islands_and_take_until(spark):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate((0, 1, 1, 0, 1))], "k string, i int, v int")
    assert sorted((r["first"], r["last"]) for r in frames.islands(df, "k", "i", "v").collect()) == [(1, 2), (4, 4)]
    sizes = spark.createDataFrame([("c", i, 4) for i in range(4)], "k string, i int, n int")
    assert frames.take_until(sizes, "k", ["i"], "n", 9).count() == 3


def test_fraction_sizes(spark):
    for n, want in ((1, (1, 0, 0)), (2, (2, 0, 0)), (3, (1, 1, 1)), (10, (8, 1, 1))):
        got = spark.range(1).select(*sampling.fraction_sizes(F.lit(n), 0.8, 0.1)).first()
        assert tuple(got) == want


def test_first_wins_counts(spark):
    df = spark.createDataFrame([("/a", 1, 10), ("/a", 2, 10), ("/a", 3, 11), ("/b", 4, 5)], "k string, i int, v int")
    out = {r["k"]: (r["v"], r["duplicates"], r["conflicts"]) for r in dedup.first_wins(df, "k", ["i"], "v").collect()}
    assert out == {"/a": (10, 2, 1), "/b": (5, 0, 0)}


def test_two_labels_raise(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "f string, l string")
    with pytest.raises(Exception, match="more than one label"):
        dedup.assert_one_label(df, "f", "l").collect()


def test_reject_reasons(spark):
    nan = float("nan")
    df = spark.createDataFrame([([0.5, -0.5, 0.5],), ([nan, 0.1, 0.1, 0.1],), ([0.5] * 4,), ([0.5, -0.5, 0.5, -0.5],)], "x array<double>")
    assert [r[0] for r in df.select(dedup.reject_reason("x", 4, 1e-6, 1e-5, 1e-4)).collect()] == ["wrong_frame_count", "non_finite", "std_lt", None]


def test_average_precision(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1)], "s double, y int")
    assert metrics.average_precision(df, "s", "y").first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_keep_top_union_small_table_is_whole(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (2, 2.0, 2)], "k int, s double, t int")
    assert sampling.keep_top_union(df, "s", "t", "k", 1).count() == 2


def test_splits_are_stable_under_repartition(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 7)
    a = sampling.ranked_split(df, "g", "id", (0.2, 0.1), 3).select("id", "split")
    b = sampling.ranked_split(df.repartition(5), "g", "id", (0.2, 0.1), 3).select("id", "split")
    assert a.exceptAll(b).count() == 0 and {r[0] for r in a.select("split").distinct().collect()} == {"train", "val", "test"}


def test_strings(spark):
    assert one(spark, paths.sanitize_stem("s"), s="  a b/c_x.wav ") == "a_b_c_x.wav"
    assert [one(spark, paths.strip_upload_prefix("s"), s=x) for x in ("a85ee650-x.wav", "x.wav", "x-")] == ["x.wav", "x.wav", "x-"]
    assert [one(spark, paths.label_path("s"), s=x) for x in ("/d/wav/s/f.flac", "/wav/x/wav/y.wav")] == ["/d/lbl/s/f.h5", "/wav/x/lbl/y.h5"]
    assert [one(spark, paths.stem("s"), s=x) for x in ("a/b.tar.gz", "a/.hid", "c")] == ["b.tar", ".hid", "c"]
    assert [one(spark, scalars.sample_count("d", "r"), d=x, r=1.0) for x in (2.5, 3.5)] == [2, 4]
    with pytest.raises(Exception, match="no label path"):
        one(spark, paths.label_path("s"), s="/d/x/f.flac")
