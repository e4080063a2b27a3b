"""Edges of series that are longer than a task: cut into pieces with a halo, with the result of `find_edges` on the whole.

The filters reach a bounded number of frames, so a piece with that many frames of its neighbours gives the exact values of its
own frames. The level comes from one histogram, added up over the pieces of a series. Runs that touch a cut are joined with
their neighbours; only those, two for each piece, meet in order. Peaks then stand alone: each knows the nearest frames at
which the signal is down, within its piece or from the pieces around, and meets the falls around it by counting.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals
from . import models as m
from .frames import running_totals
from .scratch import written

#: Frames of a piece.
PIECE = 1 << 18


def _halo(opt: m.EdgeOptions) -> int:
    """How far a frame's curvature and its spread depend on others: smoothed twice, then spread."""
    return 2 * max(1, int(4 * opt.sigma + 0.5)) + opt.reach


def _piece(pdf: pd.DataFrame, opt: m.EdgeOptions):
    """A piece's frames in order: where its own ones begin and end, their signal, smoothed signal, curvature, and its least and largest nearby."""
    pdf = pdf.sort_values("at")
    signal, own = pdf["x"].to_numpy(dtype=float), np.flatnonzero(pdf["own"].to_numpy())
    lo, hi = own[0], own[-1] + 1
    smooth = m._smooth(signal, opt.sigma)
    curve = m._smooth(smooth, opt.sigma, laplace=True)
    low, high = m._spread(curve, opt.reach, False), m._spread(curve, opt.reach, True)
    return int(pdf["at"].iloc[lo]), signal[lo:hi], smooth[lo:hi], curve[lo:hi], low[lo:hi], high[lo:hi]


def _runs(curve: np.ndarray, mask: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of a mask as first, last and where the curve is largest in it."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1, int(a + curve[a:b].argmax())) for a, b in zip(edges[::2], edges[1::2])]


def _near(places: np.ndarray, p: int) -> tuple[int | None, int | None]:
    i, j = np.searchsorted(places, p, side="right") - 1, np.searchsorted(places, p, side="left")
    return int(places[i]) if i >= 0 else None, int(places[j]) if j < len(places) else None


def long_edge_segments(frames: DataFrame, key: str, index: str, value: str, opt: m.EdgeOptions) -> DataFrame:
    """`edge_segments` of series of any length."""
    kind = frames.schema[key].dataType.simpleString()
    rows = frames.select(F.col(key).alias("k"), F.col(index).alias("o"), F.col(value).cast("double").alias("x"))
    placed = written(running_totals(rows, ["k", "o"], {"i": F.lit(1)}))
    ends = written(placed.groupBy("k").agg(F.min("i").alias("start"), F.count("*").alias("n")).where("n > 1").withColumn("s", F.col("start")))  # a row a series
    # a series is known by the number of its first row, which is never null
    series = placed.join(ends.select(F.col("k").alias("key"), "start", "n", "s"), F.col("k").eqNullSafe(F.col("key"))).select("s", (F.col("i") - F.col("start")).alias("at"), "n", "x")
    halo = _halo(opt)
    piece = lambda at: F.floor(at / PIECE)
    near = F.array_distinct(F.array(*[piece(F.least(F.greatest(F.col("at") + d, F.lit(0)), F.col("n") - 1)) for d in (-halo, 0, halo)]))
    cut = series.withColumn("piece", F.explode(near)).withColumn("own", F.col("piece") == piece(F.col("at")))
    cut = written(cut.repartition("s", "piece"))

    def bounds(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size = np.abs(_piece(pdf, opt)[3])
        return pd.DataFrame({"s": [k[0]], "lo": [size.min()], "hi": [size.max()]})

    reach = cut.groupBy("s", "piece").applyInPandas(bounds, "s long, lo double, hi double").groupBy("s").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    reach = written(reach)

    def counts(k: tuple, pdf: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
        found = np.histogram(np.abs(_piece(pdf, opt)[3]), bins=opt.bins, range=(ranges["lo"].iloc[0], ranges["hi"].iloc[0]))[0]
        return pd.DataFrame({"s": [k[0]], "counts": [found.tolist()]})

    pieces = cut.select(*[F.col(c).alias(c) for c in ("s", "piece")]).distinct()
    ranged = pieces.join(reach, "s")
    hist = cut.groupBy("s", "piece").cogroup(ranged.groupBy("s", "piece")).applyInPandas(counts, "s long, counts array<long>")
    hist = hist.select("s", F.posexplode("counts").alias("bin", "c")).groupBy("s", "bin").agg(F.sum("c").alias("c"))
    hist = hist.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("bin", "c"))).alias("h")).join(reach, "s")  # `bins` numbers a series

    def level(batches):
        for pdf in batches:
            yield pd.DataFrame({"s": pdf["s"], "level": [m._otsu_of(np.array([b["c"] for b in h]), np.histogram_bin_edges([], bins=opt.bins, range=(lo, hi))) for h, lo, hi in zip(pdf["h"], pdf["lo"], pdf["hi"])]})

    levels = written(hist.mapInPandas(level, "s long, level double"))

    def marks(k: tuple, pdf: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
        first, signal, smooth, curve, low, high = _piece(pdf, opt)
        last, cutoff = first + len(signal) - 1, levels["level"].iloc[0]
        flat, quiet = first + np.flatnonzero(smooth <= opt.low), first + np.flatnonzero(signal < opt.low)
        out = [("piece", first, last, None, None, None, *(int(x) if x is not None else None for places in (flat, quiet) for x in (places[0] if len(places) else None, places[-1] if len(places) else None)))]
        for name, c, mask in (("top", -curve, low < -cutoff), ("fall", curve, high > cutoff)):
            out += [(name, first + a, first + b, first + p, float(c[p]), float(smooth[p]), *_near(flat, first + p), *_near(quiet, first + p)) for a, b, p in _runs(c, mask)]
        found = pd.DataFrame(out, columns=["kind", "a", "b", "p", "c", "height", "flat0", "flat1", "quiet0", "quiet1"])
        found = found.astype({c: "Int64" for c in ("a", "b", "p", "flat0", "flat1", "quiet0", "quiet1")})
        return found.assign(s=k[0], piece=k[1], open0=(found["a"] == first) & (first > 0), open1=(found["b"] == last) & (last < int(pdf["n"].iloc[0]) - 1))

    marked = cut.groupBy("s", "piece").cogroup(pieces.join(levels, "s").groupBy("s", "piece")).applyInPandas(marks, "kind string, a long, b long, p long, c double, height double, flat0 long, flat1 long, quiet0 long, quiet1 long, s long, piece long, open0 boolean, open1 boolean")
    marked = written(marked)

    # what stands nearest outside a piece; a row a piece: flat0, flat1 are its first and last flat frame
    over = W.partitionBy("s").orderBy("piece")
    before, after = over.rowsBetween(W.unboundedPreceding, -1), over.rowsBetween(1, W.unboundedFollowing)
    around = marked.where("kind = 'piece'").select("s", "piece", *[x for c in ("flat", "quiet") for x in (F.max(f"{c}1").over(before).alias(f"{c}_before"), F.min(f"{c}0").over(after).alias(f"{c}_after"))])
    runs = marked.where("kind <> 'piece'").join(around, ["s", "piece"])
    runs = runs.withColumns({x: y for c in ("flat", "quiet") for x, y in ((f"{c}0", F.coalesce(f"{c}0", f"{c}_before", F.lit(-1))), (f"{c}1", F.coalesce(f"{c}1", f"{c}_after", F.lit(2**62))))})
    peak = ["p", "c", "height", "flat0", "flat1", "quiet0", "quiet1"]
    runs = runs.select("s", "kind", "a", "b", "open0", "open1", *peak)
    whole = runs.where("not open0 and not open1").select("s", "kind", *peak)
    chain = W.partitionBy("s", "kind").orderBy("a")  # of the runs at cuts, two for each piece
    broken = runs.where("open0 or open1").withColumn("new", (F.coalesce(F.lag("b").over(chain), F.lit(-2)) + 1 != F.col("a")).cast("int")).withColumn("run", F.sum("new").over(chain))
    joined = broken.groupBy("s", "kind", "run").agg(F.max_by(F.struct(*peak), F.struct("c", -F.col("p"))).alias("top")).select("s", "kind", "top.*")
    peaks = written(whole.unionByName(joined))
    tops = peaks.where(F.col("kind") == "top").where(F.col("height") >= opt.low)
    falls = peaks.where(F.col("kind") == "fall").select("s", F.col("p").alias("pos")).distinct()
    between = intervals.bracket(tops.select("s", F.col("p").alias("pos")), falls, "s")
    sized = ends.select("s", "n")
    found = tops.join(between.withColumnRenamed("pos", "p"), ["s", "p"]).join(sized, "s")
    found = found.withColumns({"lo": F.coalesce(F.col("prev_pos").cast("long"), F.lit(0)), "hi": F.coalesce(F.col("next_pos").cast("long"), F.col("n") - 1)})

    def events(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = [tuple(r) for r in pdf.sort_values("p")[["p", "height", "flat0", "flat1", "quiet0", "quiet1"]].itertuples(index=False)]
        out = m.events_between(int(k[1]), int(k[2]), held, opt)
        return pd.DataFrame({"s": [k[0]] * len(out), "first": [a for a, _ in out], "last": [b for _, b in out]}).astype({"s": "int64", "first": "int64", "last": "int64"})

    out = found.groupBy("s", "lo", "hi").applyInPandas(events, "s long, first long, last long")
    return out.join(ends.select("s", F.col("k").cast(kind).alias(key)), "s").select(key, "first", "last")
