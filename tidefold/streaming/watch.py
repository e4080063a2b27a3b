"""Streams: a watched folder, appended manifests, idle stop, calls side by side. Keyed state is in `state`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, path: str, schema: str, fmt: str = "json", per_trigger: int = 1_000) -> DataFrame:
    """ST1, ST4: each file of a folder once; what was seen is in the query's checkpoint, so a restart goes on from there."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def drain(stream: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """ST3: take what is there in micro-batches and stop: idle ends the run. `sink` gets each batch and its number."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_to(path: str):
    """ST5: a sink that appends; a batch that is run again replaces its own folder."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return sink


def composite(best: DataFrame, weights: dict[str, float]) -> DataFrame:
    """ST2: one row, the weighted mean of the best scores of all named tasks; null where one is missing."""
    named = best.where(F.col("task").isin(*weights)).groupBy().agg(F.count("*").alias("n"), F.sum(F.col("score") * F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("task")]).alias("s"))
    return named.select(F.when(F.col("n") == len(weights), F.col("s") / sum(weights.values())).alias("composite"))


def run_until_idle(stream: DataFrame, sink, checkpoint: str, empty_polls: int = 3, poll_s: float = 10.0, sleep=None) -> int:
    """ST3: poll the source until `empty_polls` polls in a row bring nothing, then stop; the number of batches run."""
    import time

    batches: list[int] = []

    def counted(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        batches.append(number)

    idle = 0
    while idle < empty_polls:
        before = len(batches)
        drain(stream, counted, checkpoint)
        idle = 0 if len(batches) > before else idle + 1
        if idle < empty_polls:
            (sleep or time.sleep)(poll_s)
    return len(batches)


def bounded_map(df: DataFrame, work, result: str, workers: int = 8) -> DataFrame:
    """ST7: `work` (a function of a row as a dict, giving a dict of `result` columns) over all rows, for calls that wait.

    Each task runs `workers` of them side by side and has twice as many pending at most; rows come in the order of
    completion, so give them a key.
    """

    def run(batches):
        from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

        import pandas as pd

        with ThreadPoolExecutor(workers) as pool:
            pending: set = set()
            for row in (r for pdf in batches for r in pdf.to_dict("records")):
                pending.add(pool.submit(work, row))
                if len(pending) >= 2 * workers:
                    done, pending = wait(pending, return_when=FIRST_COMPLETED)
                    yield pd.DataFrame([f.result() for f in done], dtype=object)
            if pending:
                yield pd.DataFrame([f.result() for f in wait(pending).done], dtype=object)

    return df.mapInPandas(run, result)


def with_retries(task, attempts: int = 5, longest_s: float = 10.0, sleep=None):
    """ST8: call `task` until it succeeds, waiting 1, 2, 4, ... seconds, `longest_s` at most."""
    import time

    sleep = sleep or time.sleep
    for n in range(1, attempts + 1):
        try:
            return task()
        except OSError:
            if n == attempts:
                raise
            sleep(min(longest_s, 2.0 ** (n - 1)))
