"""Streams with keyed state in Spark's state store: the best value so far, keys seen before.

A batch reads its own rows and the state of their keys alone; state is checkpointed with the stream's offsets, so a restart goes
on from there, and a batch that is run again starts from the state before it. What a batch changed is appended, one folder
a batch, so nothing that was written before is read or written again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Keyed state with time to live needs this store, and would run batches without rows for ever while time goes on.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def state_store(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB; the session's settings come back after."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Best(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "score double, step bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get() if self.best.exists() else None
        found = held
        for pdf in rows:
            pdf = pdf[pdf["score"].notna()]
            if len(pdf):
                top = pdf[pdf["score"] == pdf["score"].max()]
                score, step = float(top["score"].iloc[0]), top["step"].min()
                if found is None or score > found[0] or (score == found[0] and found is not held and step < found[1]):
                    found = (score, int(step))
        if found is not held:
            self.best.update(found)
            yield pd.DataFrame({"task": [key[0]], "score": [found[0]], "step": [found[1]]})

    def close(self) -> None:
        pass


def best_so_far(stream: DataFrame) -> DataFrame:
    """ST2: of a stream of (task, step, score) a row whenever a task's best score rises: (task, score, step).

    Only a strictly larger score replaces the best; within a batch the smallest step with the largest score counts. Null
    scores count nothing.
    """
    return stream.select("task", F.col("step").cast("long").alias("step"), F.col("score").cast("double").alias("score")).groupBy("task").transformWithStateInPandas(_Best(), "task string, score double, step bigint", "Update", "None")


class _Unseen(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield next(iter(rows)).head(1)

    def close(self) -> None:
        pass


def unseen(stream: DataFrame, key: str, forget_ms: int | None = None) -> DataFrame:
    """ST4: one row of each key that no earlier batch had; with `forget_ms` a key is new again when it is that old.

    The key isn't null in what comes out. State is one flag a key, which the time to live bounds.
    """
    known = stream.where(F.col(key).isNotNull())
    if forget_ms is None:
        return known.dropDuplicates([key])  # the same state, without a call to Python for each key and batch
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return known.groupBy(key).transformWithStateInPandas(_Unseen(forget_ms), schema, "Append", "ProcessingTime")


def drain_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stateful stream over what is there, a folder of changed rows for each batch; one that runs again replaces its own."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_store(updates.sparkSession):
        query = updates.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last row of each key over the folders of `drain_updates`."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(key, "row.*")
