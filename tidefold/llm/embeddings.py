"""Embedding near-duplicates by collision-counting projections.

Vectors are scaled to unit length and projected on many random lines. For each pair that meets, collisions are counted on
COUNTED lines: those on which one falls into the window centred on the other. A pair whose count reaches the calibrated
bound is verified by its cosine in double precision.

Which pairs meet is not left to single lines. On one line a window that holds pairs at cosine 0.95 with probability p1 holds
any two unlike vectors with p2, and p2 / p1 is never under 0.22 however narrow the window; so to meet each link three times
on some line, over 0.3 n^2 pairs have to be counted, whatever the number of lines. Lines are therefore grouped: on each line
values are cut into cells, a seed group takes several lines together, and vectors that stand in the same cells of one group
meet. The number of lines in a group grows with the logarithm of the table, so that a vector meets about two unlike ones in
each group at any size; the number of groups follows from the recall (`seed_groups`).

Calibration, for a pair exactly at the cosine: its distance gives the probability to share a cell of width WIDTH, hence a
group; groups are so many that all of them miss it with MISSED at most, less above it. The window's half-width is that
distance, so a line counts it with probability 0.683, and the bound lies 4.5 deviations below the mean count (1 in 300,000
is missed).

Equal vectors are one node with a weight. A bucket over BLOCK rows is dealt to several tasks as pairs of blocks. Tasks hold
a few buckets at a time, and emit counts for each node and spanning forests of their links, not the links, so a group of
thousands of copies stays linear.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, join_facts, materialize, partitions_for, scratch, small_batches

WIDTH, COUNTED, MISSED = 2.0, 64, 4e-4
BLOCK = 4096
#: Rows that a task holds before it works on its whole buckets, links that it holds before it passes them on, rows of a partition.
PIECE, HELD, ROWS = 16_384, 500_000, 400_000


def _lines(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def _one_cell(distance: float) -> float:
    """Probability that two points at a distance fall into one cell of a line."""
    r = WIDTH / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def seed_groups(rows: int, cosine: float) -> tuple[int, int]:
    """How many groups, and lines in each, for so many vectors."""
    near, far = _one_cell(math.sqrt(max(2 - 2 * cosine, 1e-6))), _one_cell(math.sqrt(2))
    lines = max(4, math.ceil(math.log(max(rows, 2) / 2) / -math.log(far)))
    return math.ceil(math.log(MISSED) / math.log(1 - near**lines)), lines


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(unit: np.ndarray, seeds: tuple[int, int]) -> np.ndarray:
    """A 64-bit key for each row and seed group: its cells, hashed."""
    groups, lines = seeds
    dim = unit.shape[1]
    shift = np.random.default_rng([11, dim]).random(groups * lines) * WIDTH
    cells = np.floor((unit @ _lines(dim, groups * lines, 1) + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(-1, groups, lines)
    h = np.full(cells.shape[:2], dim, dtype=np.uint64) + np.arange(groups, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
    for k in range(lines):
        h = (h ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _seeds(seeds: tuple[int, int]):
    """A row for each node and seed group: key, node, weight and the vector's bytes, as floats where those are exact."""

    def run(batches):
        for pdf in batches:
            sizes = pdf["vector"].map(len).to_numpy()
            for dim in np.unique(sizes):
                part = pdf[sizes == dim]
                x = np.array(part["vector"].tolist(), dtype=np.float64)
                keys = _keys(_unit(x), seeds)
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                wide = (short.astype(np.float64) != x).any(axis=1)
                raw = np.array([(v if w else f).tobytes() for v, f, w in zip(x, short, wide)], dtype=object)
                for lo in range(0, len(part), 256):
                    rows = slice(lo, lo + 256)
                    each = lambda column: np.repeat(column[rows], seeds[0])  # noqa: B023, E731
                    yield pd.DataFrame({"key": keys[rows].ravel(), "node": each(part["node"].to_numpy()), "weight": each(part["weight"].to_numpy()), "wide": each(wide), "raw": each(raw)})

    return run


def _only_keys(seeds: tuple[int, int]):
    def run(batches):
        for pdf in batches:
            sizes = pdf["vector"].map(len).to_numpy()
            for dim in np.unique(sizes):
                yield pd.DataFrame({"key": _keys(_unit(np.array(pdf["vector"][sizes == dim].tolist(), dtype=np.float64)), seeds).ravel()})

    return run


def _bound(cosine: float) -> tuple[float, int]:
    """Half-width of the windows, and the least count of collisions."""
    half = math.sqrt(2 - 2 * cosine)
    p = math.erf(1 / math.sqrt(2))
    return half, math.floor(COUNTED * p - 4.5 * math.sqrt(COUNTED * p * (1 - p)))


def _linked(cosine: float, seeds: tuple[int, int]):
    half, least = _bound(cosine)

    def pairs_of(lo: int, hi: int, side: np.ndarray):
        """Pairs within a bucket, a block of rows at a time; across blocks only those of different sides."""
        for i in range(lo, hi, 256):
            a = np.arange(i, min(i + 256, hi))
            for j in range(i, hi, 1024):
                b = np.arange(j, min(j + 1024, hi))
                x, y = np.meshgrid(a, b, indexing="ij")
                ok = (x < y) & ((side[x] != side[y]) | (side[x] == 0))
                yield x[ok], y[ok]

    def run(batches):
        """Sorted rows to counts and forests; whole buckets are worked on as soon as PIECE rows are there."""
        links: dict[int, int] = {}
        parent: dict[int, int] = {}
        held: pd.DataFrame | None = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held) < PIECE:
                continue
            new = (held["key"].to_numpy()[1:] != held["key"].to_numpy()[:-1]) | (held["part"].to_numpy()[1:] != held["part"].to_numpy()[:-1])
            if new.any():
                cut = int(np.flatnonzero(new)[-1]) + 1
                work(held.iloc[:cut], links, parent)
                held = held.iloc[cut:].reset_index(drop=True)
            if len(links) > HELD:
                yield from flush(links, parent)
        if held is not None and len(held):
            work(held, links, parent)
        yield from flush(links, parent)

    def find(parent: dict[int, int], x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def flush(links: dict[int, int], parent: dict[int, int]):
        if links:
            nodes = np.fromiter(links, dtype=np.int64, count=len(links))
            yield pd.DataFrame({"node": nodes, "other": nodes, "links": np.fromiter(links.values(), dtype=np.int64, count=len(links))})
            yield pd.DataFrame({"node": nodes, "other": np.array([find(parent, int(n)) for n in nodes], dtype=np.int64), "links": np.zeros(len(nodes), dtype=np.int64)})
        links.clear()
        parent.clear()

    def work(pdf: pd.DataFrame, links: dict[int, int], parent: dict[int, int]) -> None:
        key, part, node, weight, side = (pdf[c].to_numpy(dtype=np.int64) for c in ("key", "part", "node", "weight", "side"))
        raw, wide = pdf["raw"].to_numpy(copy=True), pdf["wide"].to_numpy(dtype=bool)
        if wide.any():  # all as doubles
            for i in np.flatnonzero(~wide):
                raw[i] = np.frombuffer(raw[i], dtype=np.float32).astype(np.float64).tobytes()
        kind = np.float64 if wide.any() else np.float32
        sizes = np.array(list(map(len, raw)))
        cut = np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (sizes[1:] != sizes[:-1])))
        starts = np.flatnonzero(cut)
        ends = np.concatenate((starts[1:], [len(pdf)]))
        shared = ends - starts > 1
        starts, ends = starts[shared], ends[shared]

        def settle(x: np.ndarray, y: np.ndarray, unit: np.ndarray, lines: np.ndarray, base: int) -> None:
            """Count, verify and note the pairs of one piece."""
            u, v = x - base, y - base
            hit = np.zeros(len(u), dtype=bool)
            for i in range(0, len(u), 65_536):
                s = slice(i, i + 65_536)
                count = (np.abs(lines[u[s]] - lines[v[s]]) <= half).sum(axis=1)
                near = np.flatnonzero(count >= least) + i
                hit[near] = np.einsum("ij,ij->i", unit[u[near]], unit[v[near]]) >= cosine
            u, v = u[hit], v[hit]
            if not len(u):
                return
            rows, at = np.unique(np.concatenate((u, v)), return_inverse=True)
            keys = _keys(unit[rows], seeds)
            a, b = at[: len(u)], at[len(u) :]
            first = np.empty(len(u), dtype=np.int64)
            for i in range(0, len(u), 65_536):
                s = slice(i, i + 65_536)
                first[s] = (keys[a[s]] == keys[b[s]]).argmax(axis=1)
            mine = keys[a, first] == key[u + base]  # each pair counts in the first seed group that holds it
            u, v = u[mine] + base, v[mine] + base
            for p, q in ((u, v), (v, u)):
                for n, w in pd.Series(weight[q]).groupby(node[p]).sum().items():
                    links[n] = links.get(n, 0) + int(w)
            for p, q in zip(node[u].tolist(), node[v].tolist()):
                rp, rq = find(parent, p), find(parent, q)
                if rp != rq:
                    parent[max(rp, rq)] = min(rp, rq)

        i = 0
        while i < len(starts):  # pieces of whole buckets
            j = i + 1
            while j < len(starts) and ends[j] - starts[i] <= 8_192 and sizes[starts[j]] == sizes[starts[i]]:
                j += 1
            lo, hi = int(starts[i]), int(ends[j - 1])
            rows = [raw[r] if len(raw[r]) == sizes[lo] else raw[lo] for r in range(lo, hi)]  # rows between buckets may differ in size
            x = np.frombuffer(b"".join(rows), dtype=kind).reshape(hi - lo, -1).astype(np.float64)
            unit = _unit(x)
            lines = unit @ _lines(unit.shape[1], COUNTED, 2)
            small: list[tuple[np.ndarray, np.ndarray]] = []
            for b in range(i, j):
                s, e = int(starts[b]), int(ends[b])
                if e - s <= 16:
                    for step in range(1, e - s):
                        small.append((np.arange(s, e - step), np.arange(s + step, e)))
                else:
                    for p, q in pairs_of(s, e, side):
                        settle(p, q, unit, lines, lo)
            if small:
                p, q = (np.concatenate([z[k] for z in small]) for k in (0, 1))
                ok = (side[p] != side[q]) | (side[p] == 0)
                settle(p[ok], q[ok], unit, lines, lo)
            i = j

    return run


def _digests() -> dict:
    """What tells unequal vectors apart: 128 bits."""
    return {"d1": F.xxhash64("vector"), "d2": F.xxhash64("vector", F.lit(1))}


def _named(nodes: DataFrame) -> DataFrame:
    """Nodes with a name of 64 bits: the first half of their digest, or a hash of both halves where another node has that half too."""
    shared = nodes.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1", F.lit(True).alias("shared"))
    if shared.isEmpty():
        return nodes.withColumn("node", F.col("d1"))
    return nodes.join(shared, "d1", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("d1", "d2")).otherwise(F.col("d1"))).drop("shared")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each row of `vectors`: key, n_links (other rows linked directly), component (its smallest key), kept.

    Rows whose cosine reaches `cosine` are linked. A vector that is null, empty, all zero, or holds a null or non-finite
    component links with nothing: no links, its own key as component. Equal rows link with each other; a repeated key
    stands for each of its rows. Rows with a null key take part; kept is false for them. Vectors of different lengths
    never link. Other columns aren't read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("key"), sound.alias("sound"), v.alias("vector"))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + 0.0)).withColumns(_digests())
    with scratch(spark), small_batches(spark):
        nodes = rows.where("sound").groupBy("d1", "d2").agg(F.count("*").alias("weight"), F.min("key").alias("smallest"), F.first("vector").alias("vector"))
        nodes = materialize(_named(materialize(nodes, "vectors")), "nodes")
        count = nodes.count()
        plan = seed_groups(count, cosine)
        seeds = nodes.select("node", "weight", "vector").mapInPandas(_seeds(plan), "key long, node long, weight long, wide boolean, raw binary")
        crowded = nodes.select("vector").mapInPandas(_only_keys(plan), "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        crowded = materialize(crowded.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "crowded")
        plain = seeds.withColumns({"part": F.lit(0).cast("long"), "side": F.lit(0).cast("long")})
        if not crowded.isEmpty():
            mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")
            dealt = seeds.join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", mine)
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
            low, high = F.least("mine", "other"), F.greatest("mine", "other")
            plain = dealt.select("key", "node", "weight", "wide", "raw", (low * F.col("blocks") + high).alias("part"), F.when(F.col("other") == F.col("mine"), 0).when(F.col("mine") == low, 1).otherwise(2).cast("long").alias("side"))
        parts = partitions_for(count * plan[0], ROWS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        found = plain.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "node").mapInPandas(_linked(cosine, plan), "node long, other long, links long")
        found = materialize(found, "found")
        discard(crowded)
        counts = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(found.where("node <> other"), "node", "other").withColumnRenamed("component", "root")
        labelled = nodes.select("node", "d1", "d2", "weight", "smallest").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        first = labelled.groupBy("root").agg(F.min("smallest").alias("component"))
        labels = labelled.join(first, "root").select("d1", "d2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component", F.col("weight").alias("n"))
        named = rows.select("key", "sound", "d1", "d2")
        joined = join_facts(named.where("sound").drop("sound"), materialize(labels, "labels"), ["d1", "d2"], named.count()).select("key", F.col("n_links").cast("long").alias("n_links"), "component")
        alone = named.where("not sound").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
        out = joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("key") == F.col("component"), F.lit(False)))
        return materialize(out, "groups", keep=True)


def query(spark, sf_dir: str) -> DataFrame:
    """`op4_embedding_near_dedup`: all vectors by cosine of 0.95 or more."""
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
