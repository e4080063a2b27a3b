"""Numeric operators that need array code or a fitted model: edges, spectra, occlusion, inference, probes, clusters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames as frames_module
from .sampling import ranked
from .scratch import written


@dataclass(frozen=True)
class EdgeOptions:
    """Widths in frames, the longest event in frames, the level under which a peak doesn't count."""

    sigma: int = 2
    reach: int = 3
    longest: int = 40
    low: float = 0.5
    bins: int = 256


def _smooth(x: np.ndarray, sigma: float, laplace: bool = False) -> np.ndarray:
    """Gaussian smoothing with mirrored ends, or its second derivative."""
    half = max(1, int(4 * sigma + 0.5))
    t = np.arange(-half, half + 1)
    g = np.exp(-0.5 * (t / sigma) ** 2)
    g /= g.sum()
    if laplace:
        g = g * (t**2 / sigma**4 - 1 / sigma**2)
        g -= g.mean()
    return np.convolve(np.pad(x, half, mode="symmetric"), g, mode="valid")


def _otsu(x: np.ndarray, bins: int) -> float:
    return _otsu_of(*np.histogram(x, bins=bins))


def _otsu_of(counts: np.ndarray, edges: np.ndarray) -> float:
    mid = (edges[1:] + edges[:-1]) / 2
    w0, s0 = np.cumsum(counts)[:-1], np.cumsum(counts * mid)[:-1]
    w, s = counts.sum(), (counts * mid).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((s * w0 / w - s0) ** 2 / (w0 * (w - w0)))
    return float(mid[int(between.argmax())])


def _peaks(curve: np.ndarray, mask: np.ndarray) -> list[int]:
    """In each run of a mask, where the curve is largest."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [int(a + curve[a:b].argmax()) for a, b in zip(edges[::2], edges[1::2])]


def _spread(x: np.ndarray, reach: int, largest: bool) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, (reach // 2, reach - 1 - reach // 2), mode="symmetric"), reach)
    return windows.max(axis=1) if largest else windows.min(axis=1)


def find_edges(signal: np.ndarray, opt: EdgeOptions = EdgeOptions()) -> list[tuple[int, int]]:
    """Events of a signal as (first, last) frames: each peak of curvature between the falls around it.

    Peaks under `low` go. Of peaks between the same falls, near ones leave the higher, far ones share the stretch at the
    level or the middle between them. An event over `longest` shrinks to where the signal holds the level around its peak,
    and to `longest` frames at most.
    """
    n = len(signal)
    if n < 2:
        return []
    smooth = _smooth(signal.astype(float), opt.sigma)
    curve = _smooth(smooth, opt.sigma, laplace=True)
    level = _otsu(np.abs(curve), opt.bins)
    tops = [p for p in _peaks(-curve, _spread(curve, opt.reach, False) < -level) if smooth[p] >= opt.low]
    falls = np.array([0, *_peaks(curve, _spread(curve, opt.reach, True) > level), n - 1])
    groups: dict[tuple[int, int], list[int]] = {}
    for p in tops:
        a, b = np.searchsorted(falls, p, side="left") - 1, np.searchsorted(falls, p, side="right")
        groups.setdefault((int(falls[max(a, 0)]), int(falls[min(b, len(falls) - 1)])), []).append(p)
    flat, quiet = np.flatnonzero(smooth <= opt.low), np.flatnonzero(signal < opt.low)

    def near(places: np.ndarray, p: int) -> tuple[int, int]:
        """The last of the places up to p and the first from p on; far away where there is none."""
        i, j = np.searchsorted(places, p, side="right") - 1, np.searchsorted(places, p, side="left")
        return int(places[i]) if i >= 0 else -1, int(places[j]) if j < len(places) else n

    return [e for (a, b), peaks in sorted(groups.items()) for e in events_between(a, b, [(p, float(smooth[p]), *near(flat, p), *near(quiet, p)) for p in peaks], opt)]


def events_between(a: int, b: int, peaks: list[tuple], opt: EdgeOptions) -> list[tuple[int, int]]:
    """Events of the peaks between two falls. A peak is (place, height, flat_before, flat_after, quiet_before, quiet_after): where
    the smoothed signal is down at the level, and the signal under it, at the peak or nearest to it on both sides."""
    kept = peaks[:1]
    for p in peaks[1:]:
        if p[0] - kept[-1][0] > opt.longest:
            kept.append(p)
        elif p[1] > kept[-1][1]:
            kept[-1] = p
    bounds = [a]
    for p, q in zip(kept, kept[1:]):
        middle = (p[0] + q[0]) // 2
        bounds += [min(p[3], middle), max(q[2], middle)]
    bounds.append(b)
    out = []
    for i, (p, _, _, _, quiet_before, quiet_after) in enumerate(kept):
        first, last = bounds[2 * i], bounds[2 * i + 1]
        if last - first > opt.longest:
            first, last = quiet_before + 1 if quiet_before >= first else first, quiet_after - 1 if quiet_after <= last else last
            if last - first > opt.longest:
                first, last = max(first, p - opt.longest // 2), min(last, p + opt.longest // 2)
        if last > first:
            out.append((int(first), int(last)))
    return out


def edge_segments(frames: DataFrame, key: str, index: str, value: str, opt: EdgeOptions = EdgeOptions()) -> DataFrame:
    """WN6: events of each key's series by edges of its smoothed signal: (key, first, last) as places in the series from 0.

    The index is total within a key; null keys are one series, null values aren't allowed. Series of up to GROUP_ROWS frames
    are one task each; longer ones are cut (`edges.long_edge_segments`), with the same result.
    """
    from . import edges

    sizes = frames.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if sizes > frames_module.GROUP_ROWS:
        return edges.long_edge_segments(frames, key, index, value, opt)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = find_edges(pdf.sort_values(index)[value].to_numpy(dtype=float), opt)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(found), "first": [a for a, _ in found], "last": [b for _, b in found]})

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, index, value).groupBy(key).applyInPandas(run, f"`{key}` {kind}, first long, last long")


def band_shares(vectors: DataFrame, key: str, vector: str, bands: int) -> DataFrame:
    """AG24: share of each of `bands` frequency bands in a vector's power: (key, shares)."""

    def share(x: pd.Series) -> pd.Series:
        out = []
        for v in x:
            power = np.abs(np.fft.rfft(np.asarray(v, dtype=float))) ** 2
            parts = np.array([p.sum() for p in np.array_split(power, bands)])
            out.append((parts / (parts.sum() + 1e-9)).tolist())
        return pd.Series(out)

    return vectors.select(key, F.pandas_udf(share, "array<double>")(vector).alias("shares"))


def occlusion(vectors: DataFrame, key: str, label: str, vector: str, bands: int, score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """ML5: mean drop of a model's score by class and band when that band is taken out: (label, band, drop).

    `score` maps a matrix of signals to a score each. Every signal is scored whole and with each band removed, in batches.
    """

    def drops(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), dtype=float)
        spectrum = np.fft.rfft(m, axis=1)
        whole, out = score(m), []
        for part in np.array_split(np.arange(spectrum.shape[1]), bands):
            cut = spectrum.copy()
            cut[:, part] = 0
            out.append(whole - score(np.fft.irfft(cut, n=m.shape[1], axis=1)))
        return pd.Series(np.array(out).T.tolist())

    rows = vectors.select(label, F.pandas_udf(drops, "array<double>")(vector).alias("d"))
    return rows.select(label, F.posexplode("d").alias("band", "drop")).groupBy(label, "band").agg(F.avg("drop").alias("drop"))


def embed(windows: DataFrame, samples: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], out: str = "embedding") -> DataFrame:
    """ML4: vectors of windows by a model that each worker loads once: `load` gives a function from signals to vectors."""
    held: list = []

    def run(x: pd.Series) -> pd.Series:
        if not held:
            held.append(load())
        return pd.Series([v.tolist() for v in held[0](np.array(x.tolist(), dtype=np.float32))])

    return windows.withColumn(out, F.pandas_udf(run, "array<float>")(samples))


def multilabel_split(df: DataFrame, key: str, labels: str, fraction: float, seed: int | str) -> DataFrame:
    """SO10: add is_valid so that every combination of labels gives round(n * fraction) rows, half to even, in hash order.

    Stratified by combination, so each label's share follows. Rare combinations may leave a label out; `iterative_split` doesn't.
    """
    combo = F.array_join(F.array_sort(F.array_distinct(labels)), "|")
    rows = ranked(df.withColumn("__combo", combo), "__combo", key, seed)
    return rows.withColumn("is_valid", F.col("__rn") <= F.bround(F.col("__n") * fraction)).drop("__combo", "__rn", "__n")


def iterative_split(df: DataFrame, key: str, labels: str, fraction: float, seed: int | str) -> DataFrame:
    """SO10: add is_valid, label by label from the rarest on: of the rows of a label that are still open, so many are valid
    in hash order that the label has round(n * fraction) valid rows in all (half to even), the others aren't.

    So rare labels get their share, in whatever combinations they come. One pass over the open rows a label (labels are a
    set of names, rows without any are the last); equal frequencies go by name. Only counts and names reach the driver.
    """
    found = df.select(F.explode(F.array_distinct(labels)).alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n")).orderBy("n", "label")
    rows = df.withColumn("is_valid", F.lit(None).cast("boolean"))
    for name in [r["label"] for r in found.collect()] + [None]:
        has = F.coalesce(F.array_contains(labels, name), F.lit(False)) if name is not None else F.lit(True)
        here = has if name is not None else F.col("is_valid").isNull()
        n, valid = rows.where(here).agg(F.count("*"), F.count_if("is_valid")).first()
        want = max(0, round(n * fraction) - valid)
        open_ = has & F.col("is_valid").isNull()
        picked = ranked(rows.where(open_), None, key, seed).withColumn("is_valid", F.col("__rn") <= want).drop("__rn", "__n")
        rows = written(rows.where(~open_).unionByName(picked))
    return rows


#: Distinct sets of labels that are dealt out on the driver, at most; counts only.
MOST_SETS = 1_000_000


def deal_sets(sets: dict[tuple[str, ...], int], weights: list[int]) -> dict[tuple[str, ...], list[int]]:
    """How many rows of each set of labels go to each fold, by iterative stratification on counts.

    A fold wants `weight` shares of each label's rows and of all rows. The label with fewest rows left (by name, if as many)
    is dealt out next, set by set: each row goes to the fold that still wants most of the label, then most rows, then to
    the first. Rows without labels come last, by wanted rows alone. All of a set's rows are dealt in one step.
    """
    whole, folds = sum(weights), range(len(weights))
    names = sorted({x for labels in sets for x in labels})
    left = {x: sum(n for labels, n in sets.items() if x in labels) for x in names}
    want = {x: [left[x] * w for w in weights] for x in names}
    rows = [sum(sets.values()) * w for w in weights]
    out = {labels: [0] * len(weights) for labels in sets}
    holding = {x: sorted(labels for labels in sets if x in labels) for x in names}
    open_ = set(sets)

    def deal(labels: tuple[str, ...], by: list[int]) -> None:
        n = sets[labels]
        taken = [0] * len(weights)
        # of the row-by-row choice, all those at which a fold wants more than a level that n rows can't lower it to
        lo, hi = min(by) - whole * (n + 1), max(by)
        while lo < hi:
            level = (lo + hi) // 2
            if sum(max(0, -(-(by[f] - level) // whole)) for f in folds) <= n:
                hi = level
            else:
                lo = level + 1
        for f in folds:
            taken[f] = max(0, -(-(by[f] - lo) // whole))
        now, total = [by[f] - whole * taken[f] for f in folds], [rows[f] - whole * taken[f] for f in folds]
        for _ in range(n - sum(taken)):
            f = max(folds, key=lambda f: (now[f], total[f], -f))
            taken[f], now[f], total[f] = taken[f] + 1, now[f] - whole, total[f] - whole
        for f in folds:
            out[labels][f] = taken[f]
            rows[f] -= whole * taken[f]
            for x in labels:
                want[x][f] -= whole * taken[f]
        for x in labels:
            left[x] -= n
        open_.discard(labels)

    while any(left.values()):
        name = min((x for x in names if left[x]), key=lambda x: (left[x], x))
        for labels in holding[name]:
            if labels in open_:
                deal(labels, list(want[name]))
    for labels in sorted(open_):
        deal(labels, list(rows))
    return out


def iterative_folds(df: DataFrame, key: str, labels: str, weights: list[int], seed: int | str) -> DataFrame:
    """SO10: add fold, from 0, so that every label's rows are shared out by the weights, rare labels first.

    Rows are counted by their set of labels, the counts are dealt out (`deal_sets`), and the rows of each set go to the folds
    in hash order, in one pass: a set however large stands in many tasks. Null and repeated labels don't count; rows
    without any are a set of their own. More than MOST_SETS different sets are an error: they'd be names of rows, not classes.
    """
    named = F.coalesce(F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))), F.array().cast("array<string>"))
    rows = df.withColumn("__set", F.to_json(named))
    counts = rows.groupBy("__set").agg(F.first(named).alias("names"), F.count("*").alias("n")).limit(MOST_SETS + 1).collect()
    if len(counts) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} different sets of labels")
    dealt = deal_sets({tuple(r["names"]): r["n"] for r in counts}, weights)
    ends = [(r["__set"], np.cumsum(dealt[tuple(r["names"])]).tolist()) for r in counts]
    placed = ranked(rows, "__set", key, seed).join(df.sparkSession.createDataFrame(ends, "__set string, __ends array<long>"), "__set")
    return placed.withColumn("fold", F.size(F.filter("__ends", lambda e: e < F.col("__rn")))).select(*df.columns, "fold")


def logistic_probe(vectors: DataFrame, vector: str, label: str, fold: str, held: int) -> DataFrame:
    """ML1, ML3: predictions on one fold of a balanced multinomial logistic regression fitted on the others."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(label, fold, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("raw")).withColumn("y", F.col(label).cast("double"))
    train = rows.where(F.col(fold) != held)
    counts = train.groupBy("y").agg(F.count("*").alias("n"))  # one row a class
    facts = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    weights = counts.join(F.broadcast(facts)).select("y", (F.col("total") / (F.col("k") * F.col("n"))).alias("w"))
    steps = [StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=100, regParam=0.01)]
    model = Pipeline(stages=steps).fit(train.join(weights, "y"))
    return model.transform(rows.where(F.col(fold) == held)).select(F.col(label).cast("long").alias("truth"), F.col("prediction").cast("long").alias("predicted"))


def cluster_quality(vectors: DataFrame, vector: str, k: int, seed: int = 0) -> DataFrame:
    """AG20: one row: the silhouette (squared Euclidean) and cost of k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed).fit(rows)
    score = ClusteringEvaluator().evaluate(model.transform(rows))
    return vectors.sparkSession.createDataFrame([(k, float(score), float(model.summary.trainingCost))], "k int, silhouette double, cost double")
