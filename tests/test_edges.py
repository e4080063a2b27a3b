"""Edges of cut series and bounds around points of hot keys: equal to the versions that hold a whole series."""

import importlib.util
import random

import numpy as np
import pytest

from tidefold.operators import edges, frames, intervals, models


def signal(kind, n=900):
    rng = np.random.default_rng(len(kind) + n)
    t = np.arange(n)
    if kind == "flat":
        return np.full(n, 0.7)
    if kind == "long":  # one event over many pieces, no edge between
        return np.where((t > 100) & (t < 800), 1.0, 0.0)
    if kind == "noise":
        return rng.random(n)
    bursts = sum(np.exp(-0.5 * ((t - c) / w) ** 2) for c, w in zip(rng.uniform(0, n, n // 30), rng.uniform(1, 12, n // 30)))
    return np.clip(bursts + rng.normal(0, 0.03, n), 0, None)


@pytest.mark.parametrize("piece", [37, 250])
def test_cut_series_equal_whole_ones(spark, piece, monkeypatch):
    opt = models.EdgeOptions(low=0.4)
    made = {k: signal(k) for k in ("flat", "long", "noise", "bursts")} | {"short": signal("bursts", 60), "two": np.array([0.0, 1.0]), "one": np.array([1.0]), None: signal("noise", 300)}
    rows = [(k, 3 * i - 50, float(v)) for k, x in made.items() for i, v in enumerate(x)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v double")
    monkeypatch.setattr(edges, "PIECE", piece)
    monkeypatch.setattr(frames, "GROUP_ROWS", 40)
    got = {}
    for r in models.edge_segments(df, "k", "i", "v", opt).collect():
        got.setdefault(r["k"], []).append((r["first"], r["last"]))
    want = {k: models.find_edges(x, opt) for k, x in made.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert len(want["bursts"]) > 5


def test_bounds_around_points_of_hot_keys(spark, monkeypatch):
    rng = random.Random(4)
    points = [(rng.choice(["hot", "hot", "b", None]), rng.randint(0, 60)) for _ in range(150)] + [("none", 5), ("hot", None)]
    bounds = [(rng.choice(["hot", "b", None]), rng.randint(0, 60)) for _ in range(60)] + [("hot", None)]
    p, b = spark.createDataFrame(points, "k string, pos long"), spark.createDataFrame(bounds, "k string, pos long")
    plain = sorted(map(tuple, intervals.bracket(p, b, "k").collect()), key=repr)
    monkeypatch.setattr(frames, "GROUP_ROWS", 10)
    wide = sorted(map(tuple, intervals.bracket(p, b, "k").collect()), key=repr)
    of = lambda k: sorted({x for j, x in bounds if j == k and x is not None})
    want = sorted(((k, x, max((float(y) for y in of(k) if y < x), default=None), min((float(y) for y in of(k) if y > x), default=None)) for k, x in points if x is not None), key=repr)
    assert wide == plain == want
