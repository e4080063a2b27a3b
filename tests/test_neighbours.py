"""Nearest neighbours with pruned cells, and interval joins by levels, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.operators import intervals, neighbours


def made(kind, n=400, dim=6):
    rng = np.random.default_rng(len(kind))
    if kind == "clusters":
        return rng.normal(0, 10, (8, dim))[rng.integers(0, 8, n)] + rng.normal(0, 0.1, (n, dim))
    if kind == "copies":
        return np.where(rng.random((n, 1)) < 0.4, 0.5, rng.normal(0, 1, (n, dim)))
    if kind == "grid":  # very many equal distances
        return rng.integers(0, 3, (n, dim)).astype(float)
    return rng.normal(0, 1, (n, dim)) * 10.0 ** rng.integers(-2, 4, (n, 1))


def brute(ids, x, k):
    out = {}
    for i, a in zip(ids, x):
        near = sorted((round(float(((a - b) ** 2).sum()), 9), j) for j, b in zip(ids, x) if j != i)
        out[i] = [j for _, j in near[:k]]
    return out


@pytest.mark.parametrize("kind,cell_rows", [("clusters", 25), ("copies", 25), ("grid", 25), ("scales", 25), ("copies", 10_000)])
def test_nearest_rows_equal_brute_force(spark, kind, cell_rows, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    x = made(kind)
    ids = random.Random(3).sample(range(9000), len(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "i long, v array<double>").repartition(3)
    stats = {}
    got = {}
    for r in neighbours.nearest_rows(df, "i", "v", 7, cell_rows=cell_rows, stats=stats).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"]))
    assert {i: [o for _, o in sorted(v)] for i, v in got.items()} == brute(ids, x, 7)
    print(kind, stats)
    if kind == "clusters" and cell_rows == 25:
        assert stats["cells"] == 16 and stats["visits"] <= 2 * stats["nodes"]  # of 15 other cells
    if kind == "copies":
        assert stats["nodes"] < 300


def test_copies_per_row_do_not_grow_on_clustered_data(spark):
    """Twice the clusters and rows: visits a row stay what they were."""
    shares = []
    for groups in (10, 40):
        rng = np.random.default_rng(7)
        x = rng.normal(0, 10, (groups, 8))[np.arange(groups * 60) % groups] + rng.normal(0, 0.1, (groups * 60, 8))
        stats = {}
        neighbours.nearest_rows(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>"), "i", "v", 5, cell_rows=30, stats=stats)
        shares.append(stats["visits"] / stats["nodes"])
        print(groups, stats)
    assert max(shares) < 4


def test_copies_per_row_do_not_grow_without_clusters(spark):
    """Nearly all of 150 cells are visited, in 16 bundles or so: a row is copied for each bundle, not for each cell."""
    x = np.random.default_rng(5).normal(0, 1, (1500, 12))
    ids, stats, got = list(range(1500)), {}, {}
    for r in neighbours.nearest_rows(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "i long, v array<double>"), "i", "v", 4, cell_rows=10, stats=stats).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"]))
    assert {i: [o for _, o in sorted(v)] for i, v in got.items()} == brute(ids, x, 4)
    assert stats["cells"] > 100 and stats["visits"] <= 24 * stats["nodes"]


def test_nearest_rows_of_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 0.0]), (None, [0.0, 1.0]), (6, [-0.0, 0.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "i long, v array<double>, cell string")
    got = sorted((r["id"], r["rank"], r["other"]) for r in neighbours.nearest_rows(df, "i", "v", 5).collect())
    assert got == [(1, 1, 6), (1, 2, 7), (1, 3, 7), (6, 1, 1), (6, 2, 7), (6, 3, 7), (7, 1, 1), (7, 1, 1), (7, 2, 6), (7, 2, 6)]
    assert neighbours.nearest_rows(df.limit(0), "i", "v", 5).count() == 0


def intervals_made(spark, seed, n=150):
    rng = random.Random(seed)
    def one():
        start = rng.uniform(-500, 5000)
        return (rng.choice(["a", "a", "b"]), start, start + rng.choice([0.0, 1.0, 5.0, 64.0, 700.0, 2.0**12, -3.0]) * rng.choice([1.0, rng.random()]))
    w = [one() for _ in range(n)] + [("a", 10.0, 20.0), ("a", 20.0, 30.0), ("a", None, 5.0), (None, 0.0, 9.0), ("a", 10.0, 20.0)]
    e = [(*one(), i) for i in range(n)] + [("a", 20.0, 40.0, 1000), ("a", 5.0, None, 1001), ("a", 30.5, 31.0, 1002)]
    return w, e, spark.createDataFrame(w, "k string, start_s double, end_s double"), spark.createDataFrame(e, "k string, event_start double, event_end double, n int")


@pytest.mark.parametrize("least,width", [(0.25, 8.0), (0.0, 0.5), (-2.0, 8.0), (0.25, 100_000.0)])
def test_levels_equal_the_plain_join(spark, least, width):
    _, _, w, e = intervals_made(spark, 1)
    for how in ("inner", "left_semi", "left_anti"):
        plain = sorted(map(tuple, intervals.overlap_join(w, e, "k", least, how=how).collect()), key=repr)
        cut = sorted(map(tuple, intervals.overlap_join(w, e, "k", least, bucket_s=width, how=how).collect()), key=repr)
        assert cut == plain and plain


def test_one_huge_window_leaves_copies_linear(spark):
    """A window of a year among windows of five seconds: every event is copied for that one level, not for each hour of it."""
    n = 2000
    w = spark.range(n).select(F.lit("a").alias("k"), (F.col("id") * 5.0).alias("start_s"), (F.col("id") * 5.0 + 5).alias("end_s"))
    w = w.unionByName(spark.createDataFrame([("a", 0.0, 365 * 86400.0)], w.schema))
    e = spark.range(n).select(F.lit("a").alias("k"), (F.col("id") * 5.0 + 1).alias("event_start"), (F.col("id") * 5.0 + 2).alias("event_end"))
    year = intervals._level("start_s", "end_s", 60.0, 0.0)
    levels = w.agg(F.collect_set(year)).first()[0]
    copies = intervals._leveled(e, "own", "event_start", "event_end", 60.0, 0.0, levels).count()
    assert len(levels) == 2 and copies <= 2 * len(levels) * n
    assert intervals.overlap_join(w, e, "k", 0.5, bucket_s=60.0).count() == 2 * n
