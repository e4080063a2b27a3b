"""Shared pieces of the training-data operators: tables, scratch space, connected components.

Scratch tables go to the folder that the cluster names in ``spark.checkpoint.dir`` (a fresh temporary folder where that is
unset and everything runs on one machine, as in tests). They cut lineage: a lost executor never makes an earlier stage
run again. `scratch` deletes what was written inside it, also after a failure; what is left is deleted with the application.
"""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import delete, folder

_HERE = threading.local()  # the open scopes of this thread, the innermost last


def _scopes() -> list[list[str]]:
    if not hasattr(_HERE, "scopes"):
        _HERE.scopes = []
    return _HERE.scopes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def scratch(spark: SparkSession):
    """Tables that `materialize` writes inside are deleted at the end, but for those that it is told to keep."""
    open_ = _scopes()
    open_.append([])
    try:
        yield
    finally:
        delete(spark, *open_.pop())


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it again; `keep` leaves it to the scope around."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}/{name}"
    scopes = _scopes()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidefold_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `materialize` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_tidefold_path", None):
            delete(df.sparkSession, path)


#: Rows and bytes that a Python worker gets at once inside `small_batches`.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """Inside, Python workers get few rows and bytes at once, so that long texts fit in their memory; settings come back after.

    They hold for what runs inside, so a table that is read later is written here.
    """
    given = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def partitions_for(rows: int, rows_each: int, least: int = 1) -> int:
    return max(least, -(-rows // rows_each))


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Nodes that a worker holds at most while it joins the edges of its partition. Half as many edges are joined by one worker.
FOREST_NODES = 1_000_000


def _local_forest(batches):
    """A spanning forest of the edges of one partition, each tree a star around its smallest node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["hi"].tolist(), pdf["lo"].tolist()):
            ra, rb = find(_seen(parent, a)), find(_seen(parent, b))
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > FOREST_NODES:  # the forests of two parts hold the same links as one of both
            yield from _stars(parent, find)
            parent.clear()
    yield from _stars(parent, find)


def _stars(parent: dict[int, int], find):
    import pandas as pd

    pairs = [(x, find(x)) for x in parent]
    pairs = [(x, r) for x, r in pairs if x != r]
    for i in range(0, len(pairs), 50_000):
        part = pairs[i : i + 50_000]
        yield pd.DataFrame({"hi": np.array([p[0] for p in part], dtype=np.int64), "lo": np.array([p[1] for p in part], dtype=np.int64)})


def _seen(parent: dict[int, int], x: int) -> int:
    if x not in parent:
        parent[x] = x
    return x


#: A key with over a share of 1 / (HOT x shuffle partitions) of all rows is hot; there are at most HOT x partitions of them.
HOT = 4


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """`rows`, `total` of them, joined with `facts`, a written table of one row a key whose column `n` counts its rows.

    A hot key's rows are dealt over as many tasks as it has shares of the bound, and its facts are copied to each. All hot
    keys together have 2 x HOT times the number of shuffle partitions of copies at most, whatever the input, so that their
    names are broadcast.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = max(1, total // (HOT * parts))
    hot = facts.where(F.col("n") > bound)
    if hot.isEmpty():
        return rows.join(facts, keys)
    share = F.ceil(F.col("n") / bound)
    marked = rows.join(F.broadcast(hot.select(*keys, share.alias("__shares"))), keys, "left")
    marked = marked.withColumn("__share", F.pmod(F.xxhash64(*rows.columns), F.coalesce("__shares", F.lit(1)))).drop("__shares")
    copied = facts.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > bound, share).otherwise(1) - 1)))
    return marked.join(copied, [*keys, "__share"]).drop("__share")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table of long ids: rows (node, component), component = smallest node.

    Alternating large-star and small-star rounds over tables; each partition first shrinks its own edges to spanning
    forests. The links of a hub are dealt over tasks (`join_facts`). Rounds go on until nothing changes, or until the edges
    that are left, FOREST_NODES / 2 at most, are a bounded task for one worker. Links, nodes and components stay in the
    cluster; only counts and a checksum reach the driver. Nulls and self-links are ignored; repeated links count once; no
    links give no rows.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi is not null and lo is not null and hi <> lo")
    with scratch(spark):
        edges = materialize(edges.mapInPandas(_local_forest, "hi long, lo long"), "edges")
        state, count = None, edges.count()
        while count > FOREST_NODES // 2:
            sym = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
            least = sym.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            least = materialize(least.withColumn("m", F.least("u", "m")), "least")
            large = join_facts(sym.where("v > u"), least, ["u"], 2 * count).select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
            large = materialize(large, "large")
            lowest = materialize(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "lowest")
            joined = join_facts(large, lowest, ["hi"], large.count())
            small = joined.select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
            after = materialize(small.mapInPandas(_local_forest, "hi long, lo long"), "edges")
            discard(edges, least, large, lowest)
            edges = after
            now = edges.distinct().agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
            if now == state:
                break
            state, count = now, edges.count()
        else:
            edges = materialize(edges.coalesce(1).mapInPandas(_local_forest, "hi long, lo long"), "edges")
        stars = edges.distinct()
        roots = stars.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
        return materialize(stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots), "components", keep=True)
