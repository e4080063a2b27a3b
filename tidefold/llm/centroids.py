"""Centroid clustering of weighted distinct vectors.

Equal vectors on the grid become one row with the number of its copies, before anything else: partial counts meet in one
shuffle, so a group of copies, however large, is one row from then on. Lloyd's rounds run over the distinct rows. Each is a
map that adds weight times vector for the nearest centroid, in whole numbers, and a sum of what the partitions return; the
table isn't written again. In the end each distinct row's centroid is joined back to the ids by a 128-bit digest, hot
digests dealt over tasks. Only centroids and sums, a bounded number of integers, reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_facts, materialize, scratch, table
from .grid import SUMS, doubles, finite, on_grid, split_sums, total

SCALE, DIM, CLUSTERS, ROUNDS, SEED = 256, 64, 40, 5, 2


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number at a tie, and its squared distance, exactly.

    Whole numbers below 2 ** 53 are exact in doubles too, and then products run as matrices of doubles.
    """
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < 2**53:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    else:
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best.astype(np.int32), d[np.arange(len(x)), best].astype(np.int64)


def _batch(b, dim: int) -> np.ndarray:
    return b.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(centroids: np.ndarray):
    """Weighted sums of components and weights for each centroid, over a partition."""

    def run(batches):
        import pyarrow as pa

        count, dim = centroids.shape
        sums, weights = np.zeros((count, dim), dtype=object), np.zeros(count, dtype=object)
        for b in batches:
            if not b.num_rows:
                continue
            x, n = _batch(b, dim), b.column("n").to_numpy(zero_copy_only=False)
            own, _ = nearest(x, centroids)
            narrow = int(np.abs(x).max()) * int(n.sum()) < 2**62
            mine, heavy = np.zeros((count, dim), dtype=np.int64 if narrow else object), np.zeros(count, dtype=np.int64)
            np.add.at(mine, own, x * n[:, None] if narrow else x.astype(object) * n.astype(object)[:, None])
            np.add.at(heavy, own, n)
            sums += mine
            weights += heavy
        slots = [*sums.ravel(), *weights]
        hi, lo = split_sums(slots)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(slots)), pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["slot", "hi", "lo"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                own, d = nearest(_batch(b, centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays([b.column("d1"), b.column("d2"), b.column("n"), pa.array(own), pa.array(d)], names=["d1", "d2", "n", "cluster", "distance"])

    return run


def digests(q: Column) -> list[Column]:
    return [F.xxhash64(q).alias("d1"), F.xxhash64(q, F.lit(1)).alias("d2")]


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The cluster of each vector, (vec_id, cluster, distance, cluster_inertia, inertia), and the centroids, (clusters, dim) integers.

    A component becomes floor(scale * x). The centroids start as the vectors whose keys have the least sha256 of
    `<seed>:<key>`, in that order; with fewer rows there are fewer. Equal distances go to the smaller number; centroids
    that no vector is nearest to stay. Distances are squared, inertias their sums.

    Vectors that are null, have not `dim` components, or hold a null or non-finite one are dropped. A vector with a component
    so large that a squared distance might not fit a long stays with null results; an inertia that doesn't fit a long is
    null. Repeated rows are rows of their own, those of a repeated key in order of their vectors; rows with a null key take
    part but start no cluster unless there are too few others. An empty table gives no rows and no centroids. Other
    columns aren't read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), doubles(vector).alias("v")).where((F.size("v") == dim) & finite(F.col("v")))
    rows = rows.select("vec_id", on_grid(F.col("v"), scale).alias("q"))
    with scratch(spark):
        whole = rows.where("q is not null")
        by_hash = [F.when(F.col("vec_id").isNotNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).asc_nulls_last(), F.col("q")]
        centroids = np.array([r["q"] for r in whole.orderBy(*by_hash).limit(clusters).collect()], dtype=np.int64).reshape(-1, dim)
        distinct = materialize(whole.groupBy("q").agg(F.count("*").alias("n")).select("q", "n", *digests(F.col("q"))), "distinct")
        for _ in range(rounds if len(centroids) else 0):
            slots = total(distinct.select("q", "n").mapInArrow(_sums(centroids), SUMS), centroids.size + len(centroids))
            sums, weights = slots[: centroids.size], slots[centroids.size :]
            centroids = np.array([sums[i] // weights[i // dim] if weights[i // dim] else int(v) for i, v in enumerate(centroids.ravel())], dtype=np.int64).reshape(-1, dim)
        found = materialize(distinct.mapInArrow(_assigned(centroids), "d1 long, d2 long, n long, cluster int, distance long"), "assigned")
        inertias = found.groupBy("cluster").agg(F.sum(F.col("n") * F.col("distance").cast("decimal(20,0)")).alias("s"), F.sum("n").alias("n")).collect()
        count, fits = sum(r["n"] for r in inertias), lambda x: int(x) if x < 2**63 else None
        each = spark.createDataFrame([(r["cluster"], fits(r["s"])) for r in inertias], "cluster int, cluster_inertia long")
        whole_sum = F.lit(fits(sum(r["s"] for r in inertias))).cast("long")
        joined = join_facts(whole.select("vec_id", *digests(F.col("q"))), found, ["d1", "d2"], count).join(F.broadcast(each), "cluster")  # a row for each centroid
        out = joined.select("vec_id", "cluster", "distance", "cluster_inertia", whole_sum.alias("inertia"))
        beyond = rows.where("q is null").select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in out.dtypes[1:]])
        return materialize(out.unionByName(beyond), "clustered", keep=True), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op13_centroids`: all vectors of 64 components, 40 clusters, 5 rounds."""
    out, centroids = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(rows, "cluster int, centroid_sha256 string")
    return out.join(F.broadcast(named), "cluster", "left").select(*out.columns, "centroid_sha256")


def _oracle() -> str:
    """Plain Lloyd over all rows, round by round."""
    steps = [f"""k AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = {DIM} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT vec_id, i AS pos, floor({SCALE} * e[i])::BIGINT AS x FROM k, range(1, {DIM + 1}) t(i)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM k QUALIFY c < {CLUSTERS}),
c0 AS (SELECT c, pos, x FROM q JOIN f USING (vec_id))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS (SELECT vec_id, c, sum((q.x - c.x) * (q.x - c.x))::BIGINT AS d FROM q JOIN c{r} c USING (pos) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, d * {CLUSTERS} + c) AS c, min(d) AS d FROM d{r} GROUP BY ALL)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (SELECT c, pos, sum(x)::BIGINT AS s, count(*) AS n FROM q JOIN a{r} USING (vec_id) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c, pos, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} LEFT JOIN s{r} USING (c, pos))""")
    return f"""WITH {', '.join(steps)}, h AS (SELECT c, sha256(string_agg(x, ',' ORDER BY pos)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN h USING (c)"""


ORACLE_SQL = _oracle()
