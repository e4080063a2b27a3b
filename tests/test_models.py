"""Numerics and fitted models against direct computation."""

import numpy as np
import pandas as pd
import pytest

from tests.conftest import SMALL
from tidefold.operators import models
from tidefold.plans import registry

Q = registry.queries()


def vectors():
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SMALL}/embeddings.parquet").to_pandas()
    return t, np.array(t.embedding.tolist(), dtype=float)


def test_band_energy(spark):
    t, x = vectors()
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2
    parts = np.array([p.sum(axis=1) for p in np.array_split(power, 8, axis=1)]).T
    want = pd.DataFrame(parts / parts.sum(axis=1, keepdims=True)).groupby(t.label).mean()
    for r in Q["band_energy"](spark, SMALL).collect():
        assert r["share"] == pytest.approx(want.loc[r["label"], r["band"]], abs=1e-5)


def test_occlusion_takes_away_each_bands_power(spark):
    t, x = vectors()
    total = pd.Series((x * x).mean(axis=1)).groupby(t.label).mean()
    got = Q["band_occlusion"](spark, SMALL).toPandas().groupby("label")["drop"].sum()
    assert np.allclose(got, total.loc[got.index], atol=1e-6)


def test_embedding(spark):
    _, x = vectors()
    lines = np.random.default_rng(0).standard_normal((64, 16)).astype(np.float32)
    want = np.tanh(x.astype(np.float32) @ lines)[:, 0]
    got = Q["embed_windows"](spark, SMALL).orderBy("vec_id").toPandas()
    assert (got["size"] == 16).all() and np.allclose(sorted(got["first"]), sorted(want), atol=1e-3)


def test_edges():
    signal = np.zeros(200)
    signal[40:60] = 1
    signal[120:135] = 1
    found = models.find_edges(signal, models.EdgeOptions(sigma=2, reach=3, longest=60, low=0.3))
    assert len(found) == 2
    for (a, b), (s, e) in zip(found, ((40, 60), (120, 135))):
        assert abs(a - s) <= 5 and abs(b - e) <= 5
    assert models.find_edges(np.zeros(1)) == []
    long = models.find_edges(np.concatenate((np.zeros(30), np.ones(100), np.zeros(30))), models.EdgeOptions(longest=40, low=0.3))
    assert all(b - a <= 40 for a, b in long)


def test_probe_finds_classes_and_nothing_else(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 600)
    x = rng.standard_normal((600, 6)) + 4 * np.eye(3, 6)[y]
    rows = [(v.tolist(), int(c), int(c) if i % 2 else int(rng.integers(0, 3)), i % 5) for i, (v, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "v array<double>, y int, noise int, fold int")
    hits = lambda label: models.logistic_probe(df, "v", label, "fold", 0).selectExpr("avg(cast(truth = predicted as int))").first()[0]
    # against the nearest of the class means of the other folds, which is near the best rule here
    held = np.arange(600) % 5 == 0
    means = np.array([x[~held & (y == c)].mean(axis=0) for c in range(3)])
    nearest = np.square(x[held][:, None] - means).sum(axis=2).argmin(axis=1)
    assert abs(hits("y") - (nearest == y[held]).mean()) <= 0.02 and hits("y") > 0.95
    assert hits("noise") < 0.85


def test_clusters_equal_numpy(spark):
    """Groups far apart, so that any k-means finds them: the silhouette and the cost as their formulas give them."""
    rng = np.random.default_rng(6)
    y = np.repeat(np.arange(4), 50)
    x = rng.standard_normal((200, 5)) + 40 * np.eye(4, 5)[y]
    out = models.cluster_quality(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), "v", 4).first()
    d = np.square(x[:, None] - x[None]).sum(axis=2)
    mean = np.array([[d[i][y == c].sum() / ((y == c).sum() - (c == y[i])) for c in range(4)] for i in range(200)])
    a = mean[np.arange(200), y]
    mean[np.arange(200), y] = np.inf
    b = mean.min(axis=1)
    assert out["silhouette"] == pytest.approx(float(((b - a) / np.maximum(a, b)).mean()), abs=0.01)
    assert out["cost"] == pytest.approx(sum(float(np.square(x[y == c] - x[y == c].mean(axis=0)).sum()) for c in range(4)), rel=1e-6)


def test_probe_and_cluster_queries(spark):
    """Accuracy is a share of the whole held-out fold; the cost lies below that of one cluster."""
    r = Q["logreg_probe"](spark, SMALL).first()
    c = Q["cluster_quality"](spark, SMALL).first()
    t, x = vectors()
    assert 0 <= r["macro_f1"] <= 1 and r["accuracy"] * (t.vec_id % 5 == 0).sum() == pytest.approx(round(r["accuracy"] * (t.vec_id % 5 == 0).sum()), abs=0.02)
    assert c["k"] == 10 and 0 < c["cost"] <= float(np.square(x - x.mean(axis=0)).sum())


def test_edge_query(spark):
    rows = Q["edge_segments"](spark, SMALL).collect()
    assert rows and all(r["first"] < r["last"] for r in rows)


def test_edge_query_takes_every_user(spark):
    sf = "/root/testdata/sf0.01"
    ev = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "value").toPandas().sort_values("event_id")
    want = sorted((int(u), a, b) for u, g in ev.groupby("user_id") for a, b in models.find_edges(g["value"].to_numpy(dtype=float), models.EdgeOptions(low=1.0)))
    assert sorted(map(tuple, Q["edge_segments"](spark, sf).collect())) == want
    assert max(u for u, _, _ in want) >= 50
