"""Joins of time intervals, and what follows from them: labels of windows, clipped labels, matches by overlap.

All are equi-joins on a recording key with a range residual. Where one recording can hold very many events, `bucket_s`
adds time cells to the key, so that a hot recording is many join keys. Cells come in levels, each twice as wide as the one
before, and an interval's own level is the first whose cells are as wide as it is long: it stands in two of them at most. Of
two intervals the shorter one stands in the cells of the longer one's level too, so they meet there, and a pair counts in the
one cell in which the later of both starts lies. An interval is thus copied at most twice for its own level and for each
longer one that the other side has, however long the longest is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import frames
from .scratch import written


def overlap(start_a, end_a, start_b, end_b) -> Column:
    """Signed overlap of two intervals; null if any bound is null (least and greatest alone would skip nulls)."""
    bounds = [F.col(c) if isinstance(c, str) else c for c in (start_a, end_a, start_b, end_b)]
    some_null = bounds[0].isNull() | bounds[1].isNull() | bounds[2].isNull() | bounds[3].isNull()
    return F.when(~some_null, F.least(bounds[1], bounds[3]) - F.greatest(bounds[0], bounds[2]))


def _leveled(df: DataFrame, side: str, start: str, end: str, width: float, reach: float, others: list[int]) -> DataFrame:
    """Rows with the cells in which they meet: `__level` and `__cell`, and `side` whether that is their own level."""
    low, high = F.least(start, end) - reach, F.greatest(start, end) + reach
    own = _level(start, end, width, reach)
    met = F.array_union(F.array(own), F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > own))
    cell = lambda t, x: F.floor(t / (F.lit(width) * F.pow(F.lit(2.0), x)))
    cells = F.flatten(F.transform(met, lambda x: F.transform(F.sequence(cell(low, x), cell(high, x)), lambda c: F.struct(x.alias("__level"), c.alias("__cell"), (x == own).alias(side)))))
    return df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*df.columns, F.inline(cells))


def _level(start: str, end: str, width: float, reach: float) -> Column:
    """0 for what fits a cell of `width`, one more for each doubling."""
    long = F.abs(F.col(end) - F.col(start)) + 2 * reach
    return F.greatest(F.ceil(F.log2(F.greatest(long, F.lit(width)) / width)), F.lit(0)).cast("int")


def overlap_join(windows: DataFrame, events: DataFrame, key: str, min_overlap_s: float = 0.0, bucket_s: float | None = None, how: str = "inner") -> DataFrame:
    """Windows (key, start_s, end_s, ...) with events (key, event_start, event_end, ...) of the same key.

    A pair matches where the event starts no later than the window ends and they overlap by `min_overlap_s` or more.
    `how` is inner, left_semi or left_anti. `bucket_s` is the width of the narrowest cells, about the length of most
    intervals; lengths of any range are fine. Each pair comes once. Rows with a null bound match nothing.
    """
    hit = (F.col("e.event_start") <= F.col("w.end_s")) & (overlap("w.start_s", "w.end_s", "e.event_start", "e.event_end") >= min_overlap_s)
    same = F.col(f"w.{key}") == F.col(f"e.{key}")
    if bucket_s is None:
        return windows.alias("w").join(events.alias("e"), same & hit, how)
    if how != "inner":  # what matches depends on a window's key and bounds alone
        found = overlap_join(windows.select(key, "start_s", "end_s").distinct(), events, key, min_overlap_s, bucket_s)
        found = found.select(*[F.col(f"w.{c}").alias(c) for c in (key, "start_s", "end_s")]).distinct()
        return windows.join(found, [key, "start_s", "end_s"], how).select(*windows.columns)
    reach = max(0.0, -min_overlap_s) + (1e-3 if min_overlap_s < 0 else 0.0)
    bounds = {"w": (windows, "start_s", "end_s"), "e": (events, "event_start", "event_end")}
    levels = {n: df.agg(F.collect_set(_level(a, b, bucket_s, reach))).first()[0] for n, (df, a, b) in bounds.items()}  # under 2,100 whatever the data
    w = _leveled(windows, "__own_w", "start_s", "end_s", bucket_s, reach, levels["e"])
    e = _leveled(events, "__own_e", "event_start", "event_end", bucket_s, reach, levels["w"])
    meet = (F.col("w.__level") == F.col("e.__level")) & (F.col("w.__cell") == F.col("e.__cell")) & (F.col("__own_w") | F.col("__own_e"))
    later = F.greatest("w.start_s", "e.event_start")
    once = F.col("w.__cell") == F.floor(later / (F.lit(bucket_s) * F.pow(F.lit(2.0), F.col("w.__level"))))
    return w.alias("w").join(e.alias("e"), same & meet & once & hit).drop("__level", "__cell", "__own_w", "__own_e")


def label_windows(windows: DataFrame, events: DataFrame, key: str, min_overlap_s: float, sound: str = "sound", artifact: str = "artifact", bucket_s: float | None = None) -> DataFrame:
    """Add is_sound and is_artifact: whether any event of that label overlaps the window. One join, one aggregate."""
    w = windows.withColumn("__id", F.struct(key, "start_s", "end_s"))
    pairs = overlap_join(w, events.where(F.col("label").isin(sound, artifact)), key, min_overlap_s, bucket_s).select("w.__id", "e.label")
    flags = pairs.groupBy("__id").agg(F.bool_or(F.col("label") == sound).alias("is_sound"), F.bool_or(F.col("label") == artifact).alias("is_artifact"))
    out = w.join(flags, "__id", "left")
    return out.select(*windows.columns, F.coalesce("is_sound", F.lit(False)).alias("is_sound"), F.coalesce("is_artifact", F.lit(False)).alias("is_artifact"))


def fan_out_basename(events: DataFrame, path: str = "audio") -> DataFrame:
    """Each event under its path and under its base name (back slashes read as slashes): the build side of a lookup."""
    base = F.element_at(F.split(F.translate(F.col(path), "\\", "/"), "/"), -1)
    return events.withColumn(path, F.explode(F.array_distinct(F.array(F.col(path), base))))


def clip_to_segment(pairs: DataFrame, strict: bool = False, rate: float = 1.0) -> DataFrame:
    """From joined (seg_start, seg_end, event_start, event_end): clipped bounds relative to the segment, and frames.

    Inclusive: any positive overlap. Strict: only where a bound of the event lies inside the segment, or the segment
    inside the event, all without equality, which drops events that touch a border from inside.
    """
    a, b, s, e = (F.col(c) for c in ("seg_start", "seg_end", "event_start", "event_end"))
    keep = ((s < a) & (a < e)) | ((s < b) & (b < e)) | ((a < s) & (s < e) & (e < b)) if strict else (s < b) & (e > a)
    clipped = pairs.where(keep).withColumns({"clip_start": F.greatest(s - a, F.lit(0.0)), "clip_end": F.least(e, b) - a})
    return clipped.withColumns({"frame_start": F.floor(F.col("clip_start") * rate), "frame_end": F.ceil(F.col("clip_end") * rate)})


def iou(a0, a1, b0, b1) -> Column:
    shared = F.greatest(overlap(a0, a1, b0, b1), F.lit(0.0))
    return F.try_divide(shared, (F.col(a1) - F.col(a0)) + (F.col(b1) - F.col(b0)) - shared)


def match_by_iou(truth: DataFrame, predicted: DataFrame, key: str, threshold: float = 0.0, bucket_s: float | None = None) -> DataFrame:
    """Counts for each key of truth (key, id, t0, t1) against predictions (key, id, p0, p1): tp, fp, fn, splits, mergers.

    An overlap with IoU above `threshold` is a true positive, any other overlap and an unmatched prediction a false
    positive, truth without any overlap a false negative. A split is truth that several predictions overlap; a merger a
    prediction that overlaps several truths. The pairs are joined once, and counted by both their ends in one aggregate.
    """
    t = truth.withColumnsRenamed({"id": "tid", "t0": "start_s", "t1": "end_s"})
    p = predicted.withColumnsRenamed({"id": "pid", "p0": "event_start", "p1": "event_end"})
    pairs = overlap_join(t, p, key, 0.0, bucket_s).where("start_s < event_end and event_start < end_s")
    hit = iou("start_s", "end_s", "event_start", "event_end") > threshold
    ends = F.explode(F.array(F.struct(F.lit("t").alias("side"), F.col("tid").cast("string").alias("id")), F.struct(F.lit("p").alias("side"), F.col("pid").cast("string").alias("id")))).alias("x")
    by_end = pairs.select(F.col(f"w.{key}").alias(key), hit.alias("hit"), ends).groupBy(key, "x.side", "x.id").agg(F.count("*").alias("n"), F.count_if("hit").alias("tp"), F.count_if(~F.coalesce("hit", F.lit(False))).alias("low"))
    is_t = F.col("side") == "t"
    found = by_end.groupBy(key).agg(F.sum(F.when(is_t, F.col("tp"))).alias("tp"), F.sum(F.when(is_t, F.col("low"))).alias("low"), F.count_if(is_t).alias("t_hit"), F.count_if(~is_t).alias("p_hit"), F.count_if(is_t & (F.col("n") > 1)).alias("splits"), F.count_if(~is_t & (F.col("n") > 1)).alias("mergers"))
    totals = truth.groupBy(key).agg(F.count("*").alias("n_t")).join(predicted.groupBy(key).agg(F.count("*").alias("n_p")), key, "full")
    out = totals.join(found, key, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(key, z("tp").alias("tp"), (z("low") + z("n_p") - z("p_hit")).alias("fp"), (z("n_t") - z("t_hit")).alias("fn"), z("splits").alias("splits"), z("mergers").alias("mergers"))


def bracket(points: DataFrame, bounds: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """For each point the last bound strictly before it and the first strictly after it, within its key.

    Keys of up to GROUP_ROWS rows on both sides together are a window each. Beyond that the rows of a key stand in many tasks:
    bounds are numbered over the whole table, each point counts those before it, and gets its bounds by their numbers. Rows
    with a null position go; repeated points are rows of their own.
    """
    points, bounds = points.where(F.col(pos).isNotNull()).select(key, pos), bounds.where(F.col(pos).isNotNull()).select(key, pos).distinct()
    both = points.withColumn("is_point", F.lit(True)).unionByName(bounds.withColumn("is_point", F.lit(False)))
    if (both.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > frames.GROUP_ROWS:
        return _bracket_wide(both, key, pos)
    both = both.withColumn("b", F.when(~F.col("is_point"), F.col(pos).cast("double")))
    # points stand before the bounds at their own position in both directions, so those are left out
    before = F.max("b").over(W.partitionBy(key).orderBy(F.col(pos), F.desc("is_point")).rowsBetween(W.unboundedPreceding, -1))
    after = F.min("b").over(W.partitionBy(key).orderBy(F.desc(pos), F.desc("is_point")).rowsBetween(W.unboundedPreceding, -1))
    return both.withColumns({"prev_pos": before, "next_pos": after}).where("is_point").select(key, pos, "prev_pos", "next_pos")


def _bracket_wide(both: DataFrame, key: str, pos: str) -> DataFrame:
    named = both.select(F.col(key).alias("k"), F.col(pos).alias("at"), "is_point")
    counted = written(frames.running_totals(named, ["k", "at", F.desc("is_point")], {"n": (~F.col("is_point")).cast("int")}))
    numbered = counted.where("not is_point").select(F.col("n").alias("number"), F.col("k").alias("bk"), F.col("at").alias("b"))
    points = counted.where("is_point").select("k", "at", "n", F.col("n") + 1, F.col("n") + 2).toDF("k", "at", "n0", "n1", "n2")
    for i in range(3):  # the bound before; the first that isn't before, and if that is at the point itself the one after it
        points = points.join(numbered.toDF(f"n{i}", f"k{i}", f"b{i}"), f"n{i}", "left")
        points = points.withColumn(f"b{i}", F.when(F.col(f"k{i}").eqNullSafe(F.col("k")), F.col(f"b{i}")))
    after = F.when(F.col("b1") > F.col("at"), F.col("b1")).when(F.col("b1") == F.col("at"), F.col("b2"))
    return points.select(F.col("k").alias(key), F.col("at").alias(pos), F.col("b0").cast("double").alias("prev_pos"), after.cast("double").alias("next_pos"))
