"""Exact k nearest neighbours of every row of a table, with cells that a row needn't meet left out.

Rows are put into the Voronoi cells of pivots, a bounded sample of the rows. A row first meets its own cell, which gives a
radius that holds its k nearest. Then it is sent to those other cells alone that the triangle inequality leaves: with a
distance `x` to another pivot, whose cell reaches out to `R`, no row of that cell is nearer than `x - R`, nor than the row's
distance to the plane between both pivots. Equal vectors are one node with their `k + 1` smallest ids, more of them can't be
anybody's neighbours, so a group of copies is one row from the start, however large.

Cells are visited in bundles: a row goes once to a bundle, with the cells of it that it wants, so on data without clusters,
where a row visits nearly all cells, it is copied for each bundle, not for each cell. A bundle and the rows that visit it are
dealt as pairs of blocks, so a task holds two blocks whatever the data look like.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

#: Rows of a cell that are aimed at; pivots at most, 32,768 vectors of 64 numbers are 16 MB; rows of a block at most, 32 MB
#: of such vectors; bundles that are aimed at while they hold no more rows than that.
CELL_ROWS, MOST_PIVOTS, BLOCK, BUNDLES = 2_048, 32_768, 65_536, 16
#: Rows of a tile of distances.
ASKS, TILE = 1_024, 2_048
#: Squared distances are compared with so many decimals, as the SQL form of the join does.
DECIMALS = 9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by matrix products, a little off."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def _slack(*vectors: np.ndarray) -> float:
    """More than the error of `_distances` and the rounding to DECIMALS together."""
    return 2 * 10.0**-DECIMALS + 1e-12 * sum(float((v * v).sum(axis=1).max(initial=0)) for v in vectors)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _place(pivots):
    """The nearest pivot of each row, and how far it is."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x, p = _matrix(pdf["v"]), pivots.value
                cell = _distances(x, p).argmin(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32), r=np.sqrt(((x - p[cell]) ** 2).sum(axis=1)))

    return run


def _bundles(held: dict[int, int], cell_rows: int) -> dict[int, int]:
    """A bundle for each cell: cells in a row until they have the rows of a block, a larger cell is one of its own."""
    rows = min(BLOCK, max(cell_rows, -(-sum(held.values()) // BUNDLES)))
    out, bundle, filled = {}, 0, 0
    for cell in sorted(held):
        if filled and filled + held[cell] > rows:
            bundle, filled = bundle + 1, 0
        out[cell] = bundle
        filled += held[cell]
    return out


def _visits(pivots, cells: dict[int, tuple[int, float]], bundles: dict[int, int], k: int):
    """The other cells that may hold a row nearer than `worst`, the squared distance that a row's own cell leaves it with.

    A row for each bundle: the cells of it, null where they are all but the row's own.
    """
    numbers = np.array(sorted(cells))
    ids, reach = np.array([cells[c][0] for c in numbers]), np.array([cells[c][1] for c in numbers])
    bundle = np.array([bundles[c] for c in numbers])  # ascending, as bundles are cells in a row
    starts = np.flatnonzero(np.diff(bundle, prepend=-1))
    size = np.diff(np.append(starts, len(numbers)))
    step = max(16, 2**20 // len(numbers))

    def run(batches):
        p = pivots.value[numbers]
        for pdf in batches:
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i : i + step]
                x, own = _matrix(part["v"]), np.searchsorted(numbers, part["cell"].to_numpy())
                away = np.sqrt(_distances(x, p))
                worst = np.sqrt(part["worst"].to_numpy(dtype=np.float64))
                for j in np.flatnonzero(np.isnan(worst)):  # a cell of few rows: the nearest cells that have enough hold them all
                    order = np.argsort(away[j] + reach)
                    enough = np.searchsorted(np.cumsum(ids[order]), k + 1)
                    worst[j] = (away[j] + reach)[order[enough]] if enough < len(order) else np.inf
                between = np.sqrt(_distances(p[own], p))
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = away**2 - away[np.arange(len(x)), own][:, None] ** 2 - 10 * _slack(x, p)  # a row near the plane may stand on either side
                    plane = np.nan_to_num(plane / (2 * between), nan=0, posinf=0, neginf=0)
                slack = math.sqrt(_slack(x, p))
                meet = np.maximum(away - reach, plane) <= worst[:, None] + slack
                meet[np.arange(len(x)), own] = False
                n = np.add.reduceat(meet, starts, axis=1, dtype=np.int64)
                every = n == size
                every[np.arange(len(x)), bundle[own]] = n[np.arange(len(x)), bundle[own]] == size[bundle[own]] - 1
                a, b = np.nonzero(n)
                only = [None if every[r, g] else numbers[starts[g] : starts[g] + size[g]][meet[r, starts[g] : starts[g] + size[g]]].tolist() for r, g in zip(a.tolist(), b.tolist())]
                yield pd.DataFrame({"d1": part["d1"].to_numpy()[a], "d2": part["d2"].to_numpy()[a], "bundle": b.astype(np.int32), "only": pd.Series(only, dtype=object), "worst": part["worst"].to_numpy(dtype=np.float64)[a]})

    return run


def _vectors(table: pa.Table) -> np.ndarray:
    column = table["v"].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _first_of(group: np.ndarray, n: int) -> np.ndarray:
    """The first `n` places of each run of equal values."""
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    return np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group)))) < n


def _nearest(k: int):
    """In a pair of blocks: for each row that asks, the k + 1 nearest ids of the cells it wants, its own included."""

    def run(asks: pa.Table, rows: pa.Table) -> pa.Table:
        who = rows["who"].combine_chunks()
        flat, lengths = who.flatten(), pc.list_value_length(who).to_numpy(zero_copy_only=False)
        order = pc.sort_indices(pa.table({"id": flat.field("id"), "tag": flat.field("tag")}), sort_keys=[("id", "ascending"), ("tag", "ascending")]).to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))  # of each id among all
        first_id = np.cumsum(lengths) - lengths
        found = np.empty((3, 0))  # who asks, squared distance, row
        if len(asks) and len(rows):
            found = _pairs(_vectors(asks), asks, _vectors(rows), rows["cell"].to_numpy(), place[first_id], k)
        a, d, y = found[0].astype(np.int64), found[1], found[2].astype(np.int64)
        ids = np.repeat(first_id[y], lengths[y]) + np.arange(lengths[y].sum()) - np.repeat(np.cumsum(lengths[y]) - lengths[y], lengths[y])
        a, d = np.repeat(a, lengths[y]), np.repeat(d, lengths[y])
        o = np.lexsort((place[ids], d, a))
        o = o[_first_of(a[o], k + 1)]
        a, d, taken = a[o], d[o], flat.take(pa.array(ids[o]))
        those, begin = np.unique(a, return_index=True)
        near = pa.StructArray.from_arrays([pa.array(d), taken.field("id"), taken.field("tag")], ["d", "id", "tag"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(a)), pa.int32()), near)
        some = pa.array(those)
        return pa.table({"d1": asks["d1"].take(some), "d2": asks["d2"].take(some), "near": lists})

    return run


def _pairs(x: np.ndarray, asks: pa.Table, y: np.ndarray, cell: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """For each row that asks, the k + 1 nearest of the cells it wants: (who asks, squared distance, row), ties by `place`.

    Tiles of distances are held against the worst that a row still takes; only what passes is measured exactly. They are
    single precision where that can hold the squares, with more than its error allowed for.
    """
    kind = np.float32 if max(np.abs(x).max(), np.abs(y).max()) < 1e15 else np.float64
    error = (4 * (x.shape[1] + 4) * float(np.finfo(kind).eps)) if kind is np.float32 else 1e-12
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    allowed = 2 * 10.0**-DECIMALS + error * (xx + yy.max())
    worst = asks["worst"].to_numpy().astype(np.float64)
    worst[np.isnan(worst)] = np.inf
    left = np.ascontiguousarray(np.column_stack([-2 * x, np.ones(len(x))]), dtype=kind)
    order = np.argsort(cell, kind="stable")
    right = np.ascontiguousarray(np.column_stack([y, yy])[order].T, dtype=kind)
    own, only = asks["cell"].to_numpy(), asks["only"].combine_chunks()
    every = only.is_null().to_numpy(zero_copy_only=False)
    asked, wanted = pc.list_parent_indices(only).to_numpy(), only.flatten().to_numpy(zero_copy_only=False)
    by_cell = np.argsort(wanted, kind="stable")
    asked, wanted = asked[by_cell], wanted[by_cell]
    best = np.empty((3, 0))
    numbers, starts = np.unique(cell[order], return_index=True)
    for c, lo, hi in zip(numbers.tolist(), starts.tolist(), np.append(starts[1:], len(order)).tolist()):
        named = asked[np.searchsorted(wanted, c) : np.searchsorted(wanted, c, side="right")]
        those = np.union1d(named, np.flatnonzero(every & (own != c)))
        for t in range(lo, hi, TILE):
            columns = right[:, t : min(t + TILE, hi)]
            new = []
            for i in range(0, len(those), ASKS):
                part = those[i : i + ASKS]
                near = left[part] @ columns  # less the square of the one that asks
                bound = worst[part] - xx[part] + allowed[part]
                if not np.isfinite(bound).all() and near.shape[1] > k + 1:
                    bound = np.minimum(bound, np.partition(near, k, axis=1)[:, k] + 2 * allowed[part])
                a, b = np.nonzero(near <= bound.astype(kind)[:, None] if kind is np.float64 else near <= np.nextafter(bound.astype(kind), kind(np.inf))[:, None])
                a, b = part[a], order[t + b]
                d = np.round(((x[a] - y[b]) ** 2).sum(axis=1), DECIMALS)
                keep = d <= worst[a]
                new.append(np.array([a[keep], d[keep], b[keep]], dtype=np.float64))
            new = np.concatenate(new, axis=1) if new else np.empty((3, 0))
            if new.shape[1]:
                touched = np.zeros(len(x), dtype=bool)
                touched[new[0].astype(np.int64)] = True
                again = touched[best[0].astype(np.int64)]
                both = np.concatenate([best[:, again], new], axis=1)
                both = both[:, np.lexsort((place[both[2].astype(np.int64)], both[1], both[0]))]
                both = both[:, _first_of(both[0], k + 1)]
                last = ~_first_of(both[0], k)  # the last of k + 1
                worst[both[0, last].astype(np.int64)] = np.minimum(worst[both[0, last].astype(np.int64)], both[1, last])
                best = np.concatenate([best[:, ~again], both], axis=1)
    return best


def _least(found: DataFrame, k: int) -> DataFrame:
    """Lists of (d, id, tag) put together: of each row the k + 1 first."""
    return found.groupBy("d1", "d2").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))


def _met(asks: DataFrame, placed: DataFrame, rows: dict[int, int], asking: dict[int, int], k: int, id_type: str) -> DataFrame:
    """Rows (d1, d2, v, cell, bundle, only, worst) with the rows of the cells they want in their bundle, as pairs of blocks."""
    spark = placed.sparkSession
    sizes = spark.createDataFrame([(c, -(-rows[c] // BLOCK), -(-n // min(BLOCK, max(rows[c], ASKS)))) for c, n in asking.items()], "bundle int, held int, asked int")
    sizes = F.broadcast(sizes)  # a row for each bundle
    some = lambda n, seed: F.pmod(F.xxhash64("d1", "d2", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    named = [F.col(c).alias(c) for c in ("d1", "d2", "v", "cell", "bundle", "only", "worst")]  # both sides may be one table
    left = asks.join(sizes, "bundle").select(*named, some("asked", 1).alias("i"), every("held").alias("j"))
    right = placed.join(sizes, "bundle").select("v", "who", "cell", "bundle", some("held", 2).alias("j"), every("asked").alias("i"))
    return left.groupBy("bundle", "i", "j").cogroup(right.groupBy("bundle", "i", "j")).applyInArrow(_nearest(k), f"d1 long, d2 long, near array<struct<d:double,id:{id_type},tag:string>>")


def nearest_rows(df: DataFrame, key: str, vector: str, k: int, tag: str | None = None, cell_rows: int = CELL_ROWS, stats: dict | None = None) -> DataFrame:
    """For each row its `k` nearest other rows, exactly: (id, tag, rank from 1, other, other_tag, d the squared distance).

    Distances are Euclidean, rounded to 9 decimals when they are compared; ties go to the smaller key. All rows are searched,
    those of equal vectors too. Rows whose vector is null, empty or holds a null or non-finite component, and rows with a
    null key, take no part; vectors have one length. Repeated keys are rows of their own that don't find each other.
    Fewer than `k` other rows give as many. An empty table gives no rows. `stats` gets the number of nodes, of cells, and of
    visits, the copies of nodes that were sent to bundles for cells other than their own.
    """
    spark = df.sparkSession
    id_type = df.schema[key].dataType.simpleString()
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    rows = df.select(F.col(key).alias("id"), (F.col(tag).cast("string") if tag else F.lit(None).cast("string")).alias("tag"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    rows = rows.withColumns({"d1": F.xxhash64("v"), "d2": F.xxhash64("v", F.lit(1))})
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("d1", "d2").orderBy("id", "tag"))).where(F.col("n") <= k + 1)
    nodes = written(first.groupBy("d1", "d2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct("id", "tag"))).alias("who")))
    count = nodes.count()
    if not count:
        return spark.createDataFrame([], f"id {id_type}, tag string, rank int, other {id_type}, other_tag string, d double")
    wanted = max(1, min(MOST_PIVOTS, -(-count // cell_rows)))
    pivots = spark.sparkContext.broadcast(_matrix(pd.Series([r["v"] for r in nodes.select("d1", "d2", "v").orderBy("d1", "d2").limit(wanted).collect()])))
    placed = written(nodes.mapInPandas(_place(pivots), f"d1 long, d2 long, v array<double>, who array<struct<id:{id_type},tag:string>>, cell int, r double"))
    found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("who")).alias("ids"), F.max("r").alias("reach")).collect()  # a row for each pivot
    held = {r["cell"]: r["n"] for r in found}
    own = placed.select("*", F.col("cell").alias("bundle"), F.array("cell").alias("only"), F.lit(None).cast("double").alias("worst"))
    best = written(_least(_met(own, own, held, held, k, id_type), k))
    worst = best.select("d1", "d2", F.when(F.size("near") > k, F.element_at("near", -1)["d"]).alias("worst"))
    asking = placed.join(worst, ["d1", "d2"]).select("d1", "d2", "v", "cell", "worst")
    bundles = _bundles(held, cell_rows)
    cells = {r["cell"]: (r["ids"], r["reach"]) for r in found}
    visits = written(asking.mapInPandas(_visits(pivots, cells, bundles, k), "d1 long, d2 long, bundle int, only array<int>, worst double"))
    visited = {r["bundle"]: r["n"] for r in visits.groupBy("bundle").agg(F.count("*").alias("n")).collect()}
    if stats is not None:
        stats |= {"nodes": count, "cells": len(held), "visits": sum(visited.values())}
    if visited:
        sent = visits.join(placed.select("d1", "d2", "v", "cell"), ["d1", "d2"])
        filled: dict[int, int] = {}
        for cell, bundle in bundles.items():
            filled[bundle] = filled.get(bundle, 0) + held[cell]
        named = F.broadcast(spark.createDataFrame(list(bundles.items()), "cell int, bundle int"))  # a row for each cell
        best = _least(best.unionByName(_met(sent, placed.join(named, "cell"), filled, visited, k, id_type)), k)
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    out = rows.select("id", "tag", "d1", "d2").join(best, ["d1", "d2"]).select("id", "tag", F.posexplode(others).alias("rank", "x"))
    return out.select("id", "tag", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("other"), F.col("x.tag").alias("other_tag"), F.col("x.d").alias("d"))


def knn_purity(df: DataFrame, key: str, vector: str, label: str, k: int) -> DataFrame:
    """Mean share of the k nearest other rows (`nearest_rows`) that have the row's label: one row, purity. A null label counts as another one."""
    same = F.coalesce(F.col("tag") == F.col("other_tag"), F.lit(False))
    return nearest_rows(df, key, vector, k, tag=label).agg(F.avg(same.cast("double")).alias("purity"))
