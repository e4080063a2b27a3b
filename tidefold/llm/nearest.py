"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are lifted so that the largest inner product is the smallest Euclidean distance (one coordinate more makes all
candidates equally long), then projected on STABLE Gaussian, that is 2-stable, lines: for two points at distance d, their
projected squared distance over d squared follows a chi-square law with STABLE degrees of freedom.

One kd-tree over the projections covers the table: its splits come from a bounded sample (SAMPLE rows), every row is dealt
into one of its cells (CELLS at most), and a cell over ROWS rows, whether the tree is small or a vector is repeated, is dealt
into parts. A query visits cells in the order of their projected distance, 1, 4, 16, ... of them a round, until the next is so
far that a row nearer than the query's k-th over all cells visited would lie within that reach with probability CONFIDENCE:
the chi-square stopping test. Inside a part the same test, from the same k-th on, decides how many leaves of the part's own
kd-tree are verified by the true inner product. A part is read once a round for each QUERIES queries that visit it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, partitions_for, scratch, small_batches

STABLE, CONFIDENCE = 8, 0.95
ROWS, QUERIES, LEAF = 8_192, 8_192, 64
SAMPLE, CELLS = 262_144, 16_384


def chi_square(x: np.ndarray, freedom: int = STABLE) -> np.ndarray:
    """Distribution function of the chi-square law with an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, dtype=np.float64) / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, freedom // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def _quantile(share: float) -> float:
    low, high = 0.0, 1_000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle) < share else (low, middle)
    return high


#: A cell whose projected squared distance is over STOP times the squared distance of the k-th row found is not visited.
STOP = _quantile(CONFIDENCE)


def _halves(points: np.ndarray, most: int) -> list:
    """Splits (axis, value, left, right) of a kd-tree over sample points, halving the largest cell until there are `most`
    cells; a negative child is the cell ~child."""
    import heapq

    splits: list[list] = []
    cells = [(-len(points), 0, np.arange(len(points)), None)]  # the last: the split and the side that lead here
    made, done = 1, []
    while cells and len(cells) + len(done) < most:
        cell = heapq.heappop(cells)
        rows = points[cell[2]]
        axis = int(np.ptp(rows, axis=0).argmax()) if len(rows) > 1 else 0
        value = float(np.median(rows[:, axis])) if len(rows) > 1 else 0.0
        left = rows[:, axis] <= value if len(rows) > 1 else np.zeros(0, bool)
        if len(rows) < 2 or left.all():  # no plane parts them
            done.append(cell)
            continue
        at = len(splits)
        splits.append([axis, value, 0, 0])
        if cell[3]:
            splits[cell[3][0]][cell[3][1]] = at
        for side, part in ((2, cell[2][left]), (3, cell[2][~left])):
            heapq.heappush(cells, (-len(part), made, part, (at, side)))
            made += 1
    for number, cell in enumerate(sorted(cells + done, key=lambda c: c[1])):
        if cell[3]:
            splits[cell[3][0]][cell[3][1]] = ~number
    return splits


def cells_of(points: np.ndarray, splits: list) -> np.ndarray:
    """The cell of each point."""
    out = np.zeros(len(points), dtype=np.int64)
    todo = [(0, np.arange(len(points)))] if splits else []
    while todo:
        at, rows = todo.pop()
        axis, value, left, right = splits[at]
        low = points[rows, axis] <= value
        for child, part in ((left, rows[low]), (right, rows[~low])):
            if child < 0:
                out[part] = ~child
            elif len(part):
                todo.append((child, part))
    return out


def reach(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of every query to every box."""
    out = np.zeros((len(queries), len(low)))
    for k in range(queries.shape[1]):
        q = queries[:, k : k + 1]
        out += np.maximum(np.maximum(low[None, :, k] - q, q - high[None, :, k]), 0.0) ** 2
    return out


class KdTree:
    """Leaves of about LEAF rows, by medians of the widest coordinate, with their bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                continue
            axis = int(np.ptp(points[rows], axis=0).argmax())
            order = rows[np.argsort(points[rows, axis], kind="stable")]
            todo += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.low = np.array([points[r].min(axis=0) for r in self.leaves])
        self.high = np.array([points[r].max(axis=0) for r in self.leaves])


def _lines(dim: int) -> np.ndarray:
    return np.random.default_rng([3, dim]).standard_normal((dim + 1, STABLE))


def project(x: np.ndarray, longest: float) -> np.ndarray:
    """Projections of rows, lifted to the length `longest`."""
    lines = _lines(x.shape[1])
    lift = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0.0))
    return x @ lines[:-1] + lift[:, None] * lines[-1]


def _plain(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Query vectors times a power of two each, so that their largest component is 0.5 to 1, and their lengths."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, np.sqrt((x * x).sum(axis=1))


def aim(x: np.ndarray, longest: float) -> np.ndarray:
    """Projections of queries, scaled to the length `longest`."""
    x, size = _plain(x)
    return (x * (longest / size)[:, None]) @ _lines(x.shape[1])[:-1]


def _distance(kth: np.ndarray, size: np.ndarray, longest: float) -> np.ndarray:
    """Squared distance of a query's k-th row; a little more, for rounding; without a k-th row no bound."""
    with np.errstate(invalid="ignore"):
        found = 2 * longest**2 - 2 * kth * longest / size
    return np.where(np.isfinite(kth), np.maximum(found, 0.0) + 1e-9 * longest**2, np.inf)


def search_part(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, kth: np.ndarray, longest: float, k: int):
    """The k best rows of a part for each query, but for rows below its `kth` score: query places, row places, scores.

    `x` are rows scaled as a whole, `longest` their length at most; scores are inner products with `_plain` queries.
    """
    tree = KdTree(project(x, longest))
    aims = aim(q, longest)
    q, size = _plain(q)
    slack = 1e-12 * longest * size  # rounding of a product by BLAS; what is near the k-th is computed row by row
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q), 256):
        part = slice(lo, min(lo + 256, len(q)))
        far = reach(aims[part], tree.low, tree.high)
        order = np.argsort(far, axis=1, kind="stable")
        scores = np.full((far.shape[0], len(x)), -np.inf)
        best = kth[part].copy()
        open_, done, step = np.arange(far.shape[0]), 0, 4
        while done < len(tree.leaves):
            nxt = far[open_, order[open_, done]]
            open_ = open_[nxt <= STOP * _distance(best[open_], size[part][open_], longest)]
            if not len(open_):
                break
            upto = min(done + step, len(tree.leaves))
            picked = np.zeros((len(open_), len(tree.leaves)), dtype=bool)
            np.put_along_axis(picked, order[open_, done:upto], True, axis=1)
            for leaf in np.flatnonzero(picked.any(axis=0)):
                who, rows = open_[picked[:, leaf]], tree.leaves[leaf]
                found = q[part][who] @ x[rows].T
                found[query_ids[part][who][:, None] == ids[rows][None, :]] = -np.inf
                scores[np.ix_(who, rows)] = found
            done, step = upto, step * 2
            if len(x) >= k:
                best[open_] = np.maximum(best[open_], np.partition(scores[open_], len(x) - k, axis=1)[:, len(x) - k])
        for i in range(scores.shape[0]):
            near = np.flatnonzero((scores[i] >= best[i] - slack[lo + i]) & np.isfinite(scores[i]))
            exact = (x[near] * q[lo + i]).sum(axis=1)
            first = np.lexsort((ids[near], -exact))[:k]
            out.append((np.full(len(first), lo + i), near[first], exact[first]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _by_size(vectors: pd.Series):
    """Row places of each length of vectors; those of different lengths have no inner product."""
    sizes = vectors.map(len).to_numpy()
    return [(int(n), np.flatnonzero(sizes == n)) for n in np.unique(sizes)]


def _searched(exponent: int, longest: float, k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        asked = dict(_by_size(queries["vector"])) if len(queries) else {}
        for size, at in _by_size(rows["vector"]) if len(rows) else []:
            if size in asked:
                r, s = rows.iloc[at], queries.iloc[asked[size]]
                whole, q, ids = _matrix(r["vector"]), _matrix(s["vector"]), r["id"].to_numpy(dtype=np.int64)
                who, row, near = search_part(ids, np.ldexp(whole, -exponent), s["id"].to_numpy(dtype=np.int64), q, s["kth"].to_numpy(dtype=np.float64), longest, k)
                with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                    score = (whole[row] * q[who]).sum(axis=1)
                found.append((s["ask"].to_numpy(dtype=np.int64)[who], ids[row], near, score))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        return pd.DataFrame(dict(zip(("ask", "vec_id", "near", "score"), cols)))

    return run


def _projected(exponent: int, longest: float):
    """Every row's projection: as a candidate, and for a query as one that asks."""

    def run(batches):
        for pdf in batches:
            for _, at in _by_size(pdf["vector"]):
                part = pdf.iloc[at]
                x = _matrix(part["vector"])
                asks = np.flatnonzero(part["asks"].to_numpy(dtype=bool))
                aims = pd.Series([None] * len(part), index=part.index, dtype=object)
                if len(asks):
                    aims.iloc[asks] = list(aim(x[asks], longest))
                yield part.assign(place=list(project(np.ldexp(x, -exponent), longest)), aim=aims)

    return run


def _dealt(splits: list, keep: list[str]):
    """Rows with the cell that their place is in."""

    def run(batches):
        for pdf in batches:
            yield pdf[keep].assign(cell=cells_of(_matrix(pdf["place"]), splits) if len(pdf) else np.zeros(0, np.int64))

    return run


def _sizes(vectors: pd.Series) -> np.ndarray:
    out = np.zeros(len(vectors))
    for _, at in _by_size(vectors):
        out[at] = _plain(_matrix(vectors.iloc[at]))[1]
    return out


def query_groups(homes: list, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each part the first number of its queries' groups, and how many groups they are dealt to.

    `homes` has (part, queries in it). Parts that follow each other in the tree, and so lie near each other, share a group until it
    has about QUERIES queries: their queries visit much the same parts, which are then read once for the group. A part with
    more queries has groups of its own.
    """
    count = np.zeros(parts, dtype=np.int64)
    for part, n in homes:
        count[part] = n
    base, sub, group, held = np.zeros(parts, dtype=np.int64), np.ones(parts, dtype=np.int64), 0, 0
    for part in range(parts):
        if held and held + count[part] > QUERIES:
            group, held = group + 1, 0
        base[part], sub[part] = group, max(1, -(-int(count[part]) // QUERIES))
        held += int(count[part])
        if sub[part] > 1:
            group, held = group + int(sub[part]), 0
    return base, sub


def _routed(low: np.ndarray, high: np.ndarray, parts: np.ndarray, first: np.ndarray, done: int, upto: int, groups: tuple[np.ndarray, np.ndarray], longest: float):
    """A row for each query and part that it visits in this round."""

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                q = pdf.iloc[lo : lo + 256]
                far = reach(_matrix(q["aim"]), low, high)
                order = np.argsort(far, axis=1, kind="stable")[:, done:upto]
                size = _sizes(q["vector"])
                kth = q["kth"].to_numpy(dtype=np.float64)
                go = np.take_along_axis(far, order, axis=1) <= (STOP * _distance(kth, size, longest))[:, None]
                who, at = np.nonzero(go)
                cell = order[who, at]
                who, part = np.repeat(who, parts[cell]), np.repeat(first[cell], parts[cell])
                part = part + np.arange(len(part)) - np.repeat(np.cumsum(parts[cell]) - parts[cell], parts[cell])
                ask, home = q["ask"].to_numpy(dtype=np.int64)[who], q["home"].to_numpy(dtype=np.int64)[who]
                group = groups[0][home] + ask % groups[1][home]
                for i in range(0, len(who), 20_000):
                    s = slice(i, i + 20_000)
                    yield pd.DataFrame({"part": part[s], "group": group[s], "ask": ask[s], "id": q["id"].to_numpy()[who[s]], "vector": q["vector"].to_numpy()[who[s]], "kth": kth[who[s]]})

    return run


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", stats: dict | None = None) -> DataFrame:
    """For each row for which the column `is_query` holds, its k nearest other rows: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision, ties go to the smaller id; fewer rows than k are all returned.
    Products that leave the range of doubles are ranked by their value all the same (vectors are scaled by powers of two,
    which changes no order), though `score` is then infinite or zero. Vectors that are null, empty, all zero or hold null or
    non-finite components take no part, nor do rows with a null id. A row never finds its own id; a repeated id is found
    once for each of its rows, and ranks anew for each row that asks. Other columns aren't read; an empty table, or no
    query, gives no rows. `stats` gets `reads`, how often a part of the table was read for a group of queries.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.when(sound, v).alias("vector")).where("vector is not null")
    with scratch(spark):
        # lengths as logarithms, from each vector over its largest component: nothing leaves the range of doubles
        largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
        sized = rows.select("asks", "vector", largest.alias("m"))
        length = F.log2("m") + F.log2(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / F.col("m")) * (x / F.col("m")))) / 2
        facts = sized.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max("m").alias("most"), F.max(length).alias("length")).first()
        if not facts["q"]:
            return spark.createDataFrame([], RESULT)
        exponent = int(np.frexp(facts["most"])[1])
        longest = 2.0 ** (facts["length"] - exponent) * (1 + 1e-9)
        with small_batches(spark):
            placed = materialize(rows.withColumn("ask", F.monotonically_increasing_id()).mapInPandas(_projected(exponent, longest), "id long, asks boolean, vector array<double>, ask long, place array<double>, aim array<double>"), "placed")
        # splits from a bounded sample: about SAMPLE rows, chosen by a hash
        share = min(1.0, SAMPLE / max(facts["n"], 1))
        picked = placed.where(F.pmod(F.xxhash64("ask", F.lit(5)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("place").toPandas()
        splits = _halves(_matrix(picked["place"]), min(CELLS, partitions_for(facts["n"], ROWS))) if len(picked) else []
        box = [f(F.element_at("place", i + 1)).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(STABLE)]
        cells = placed.select("place").mapInPandas(_dealt(splits, ["place"]), "place array<double>, cell long").groupBy("cell").agg(F.count("*").alias("n"), *box).orderBy("cell").toPandas()
        low, high = (cells[[f"{name}{i}" for i in range(STABLE)]].to_numpy(dtype=np.float64).reshape(-1, STABLE) for name in ("low", "high"))
        parts = -(-cells["n"].to_numpy(dtype=np.int64) // (2 * ROWS))
        first = np.cumsum(parts) - parts
        number = spark.createDataFrame(list(zip(cells["cell"].tolist(), parts.tolist(), first.tolist())), "cell long, parts long, first long")
        columns = ["id", "asks", "vector", "ask", "aim"]
        if int(parts.sum()) == 1:
            dealt = placed.select(*columns, F.lit(0).cast("long").alias("part"))
        else:
            dealt = placed.mapInPandas(_dealt(splits, columns), "id long, asks boolean, vector array<double>, ask long, aim array<double>, cell long")
            dealt = dealt.join(F.broadcast(number), "cell").withColumn("part", F.col("first") + F.pmod(F.xxhash64("ask"), F.col("parts")))
            dealt = materialize(dealt.select(*columns, "part"), "dealt")
            discard(placed)
        asked = dealt.where("asks").select("ask", "id", "vector", "aim", F.col("part").alias("home"))
        groups = query_groups([tuple(r) for r in asked.groupBy("home").agg(F.count("*")).collect()], int(parts.sum()))  # a row a part
        rank = F.row_number().over(W.partitionBy("ask").orderBy(F.desc("near"), "vec_id"))
        best, done, upto = None, 0, 1
        while done < len(cells):
            open_ = asked.withColumn("kth", F.lit(float("-inf")))
            if best is not None:
                full = best.groupBy("ask").agg(F.count("*").alias("held"), F.min("near").alias("kth")).where(F.col("held") >= k).select("ask", "kth")
                open_ = asked.join(full, "ask", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
            visits = materialize(open_.mapInPandas(_routed(low, high, parts, first, done, upto, groups, longest), "part long, group long, ask long, id long, vector array<double>, kth double"), "visits")
            if best is not None and visits.isEmpty():
                break
            pairs = visits.select(F.col("part").alias("visited"), F.col("group").alias("by")).distinct()
            if stats is not None:
                stats["reads"] = stats.get("reads", 0) + pairs.count()
            read = dealt.join(pairs, F.col("part") == F.col("visited")).select("visited", "by", "id", "vector")
            found = read.groupBy("visited", "by").cogroup(visits.groupBy("part", "group")).applyInPandas(_searched(exponent, longest, k), "ask long, vec_id long, near double, score double")
            both = found if best is None else best.unionByName(found)
            after = materialize(both.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "best")
            discard(visits, *([best] if best is not None else []))
            best, done, upto = after, upto, min(len(cells), upto * 4)
        out = best.withColumn("rank", rank).join(asked.select("ask", F.col("id").alias("query_id")), "ask")
        return materialize(out.select("query_id", "rank", "vec_id", "score"), "nearest", keep=True)


def query(spark, sf_dir: str) -> DataFrame:
    """`op8_nearest`: the 20 nearest of every row whose id is divisible by 20, against all rows."""
    from .common import table

    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
