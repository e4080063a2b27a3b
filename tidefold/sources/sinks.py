"""Writers: CSV, JSON lines, manifests, shards, matrices, audio, registries, reports."""

from __future__ import annotations

import io
import json
import math
import re
import wave

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frames import running_totals
from .commit import files_of, write_files
from .files import LABEL_ARRAYS
from .settings import dump_yaml, read_settings
from .storage import write_bytes


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """SNK1."""
    df.write.mode(mode).csv(path, header=True, sep=sep)


def union_of_keys(df: DataFrame, key: str, label: str) -> DataFrame:
    """SNK2: counts by key with a column for each label, in order; absent ones are blank."""
    wide = df.groupBy(key).pivot(label).count()
    return wide.select(key, *sorted(c for c in wide.columns if c != key))


def selection_tables(events: DataFrame, files: DataFrame, path: str) -> None:
    """SNK3: a file `fn.txt` of Begin Time, End Time and Annotation for each file; one without events has a header only.

    Rows are sorted by file within partitions, so that a task holds one file's lines at a time.
    """
    rows = files.select("fn").distinct().join(events.select("fn", "start_s", "end_s", "label"), "fn", "left")
    head = "Begin Time (s)\tEnd Time (s)\tAnnotation\n"

    def make(rows):
        name, lines = None, []
        for fn, start, end, label in rows:
            if name is not None and fn != name:
                yield f"{safe_name(name)}.txt", (head + "".join(lines)).encode()
                lines = []
            name = fn
            if start is not None and not math.isnan(start):
                lines.append(f"{start}\t{end}\t{label}\n")
        if name is not None:
            yield f"{safe_name(name)}.txt", (head + "".join(lines)).encode()

    write_files(files_of(rows.where("fn is not null").repartition("fn"), make, ["fn", "start_s", "end_s", "label"]), path)


def safe_name(name: str) -> str:
    """A file name without separators and other odd characters."""
    return re.sub(r"[^\w.\-]", "_", str(name)).lstrip(".") or "_"


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """SNK4."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_root_tsv(df: DataFrame, root: str, path: str) -> None:
    """SNK5: one file whose first line is the root, then rel_path and n_samples, sorted. A manifest is one file by format."""
    spark = df.sparkSession
    head = spark.createDataFrame([(0, root)], "o int, line string")
    body = df.select(F.lit(1).alias("o"), F.concat_ws("\t", "rel_path", F.col("n_samples").cast("string")).alias("line"))
    head.union(body).coalesce(1).sortWithinPartitions("o", "line").select("line").write.mode("overwrite").text(path)


def fan_out(df: DataFrame, route: Column, path: str) -> None:
    """SNK6: one pass, a folder for each route."""
    df.withColumn("route", route).write.mode("overwrite").partitionBy("route").parquet(path)


def write_sharded(df: DataFrame, order: str, per_folder: int, path: str) -> None:
    """SNK8: folders shard_000000, ... of `per_folder` rows by the order, which must be total; numbered without one task for all."""
    numbered = running_totals(df, [order], {"__row": F.lit(1).cast("long")})
    shard = F.floor((F.col("__row") - 1) / per_folder)
    named = numbered.withColumn("shard", F.concat(F.lit("shard_"), F.lpad(shard.cast("string"), 6, "0")))
    named.drop("__row").write.mode("overwrite").partitionBy("shard").parquet(path)


def _npy(rows: list) -> bytes:
    out = io.BytesIO()
    np.save(out, np.array(rows, dtype=np.float32) if rows else np.zeros((0, 0), np.float32))
    return out.getvalue()


def write_npy(df: DataFrame, path: str, index: str = "row_index", vector: str = "embedding", rows_each: int = 65_536, name: Column | None = None) -> None:
    """SNK9: a folder of .npy parts, sorted by index within ranges of it; each task writes its own parts, of `rows_each` rows.

    With `name` one file for each row, called by it. An empty table gives one file of no rows.
    """
    if name is not None:
        write_files(files_of(df.select(vector, name.cast("string")), lambda rows: ((f"{safe_name(n)}.npy", _npy(list(v))) for v, n in rows), []), path)
        return

    def make(rows):
        first, data = None, []
        for at, v in rows:
            first = at if first is None else first
            data.append(v)
            if len(data) == rows_each:
                yield f"part-{first:012d}.npy", _npy(data)
                first, data = None, []
        if data:
            yield f"part-{first:012d}.npy", _npy(data)

    if df.isEmpty():
        write_files(df.sparkSession.createDataFrame([(f"part-{0:012d}.npy", _npy([]))], "name string, content binary"), path)
    write_files(files_of(df.select(index, vector).repartitionByRange(index), make, [index]), path)


def wav_bytes(samples, rate: int) -> bytes:
    """A 16-bit mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, dtype=np.float64), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def write_wav(df: DataFrame, path: str, name: str = "name", samples: str = "samples", rate: int = 16_000) -> None:
    """SNK11: a 16-bit mono WAV file for each row, in folders as its name says."""
    write_files(files_of(df.select(F.col(name).cast("string"), samples), lambda rows: ((f"{n}.wav", wav_bytes(x, rate)) for n, x in rows), []), path)


def empty_labels(clips: DataFrame) -> DataFrame:
    """SNK10: label rows without labels, for clips that have none."""
    return clips.select("clip", *[F.array().cast(t).alias(c) for c, t in LABEL_ARRAYS.items()])


def write_labels(events: DataFrame, clips: DataFrame, path: str, rate: int, categories: list[str]) -> None:
    """SNK10: a store of label arrays by clip, in time order: times, frames at `rate`, names, categories (their place in the
    list, null for others) and focal marks. Clips without events have empty arrays.

    `events` has clip, start_s, end_s, label and focal (boolean). A clip's events are one row, as the format asks.
    """
    category = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("label"))
    event = F.struct("start_s", "end_s", "label", F.when(category > 0, category - 1).alias("category"), F.coalesce(F.col("focal").cast("long"), F.lit(0)).alias("foc"))
    grouped = events.groupBy("clip").agg(F.array_sort(F.collect_list(event)).alias("e"))
    parts = {
        "start_time_lbl": lambda e: e["start_s"], "end_time_lbl": lambda e: e["end_s"], "start_frame_lbl": lambda e: F.floor(e["start_s"] * rate), "end_frame_lbl": lambda e: F.floor(e["end_s"] * rate),
        "lbl": lambda e: e["label"], "lbl_cat": lambda e: e["category"], "foc": lambda e: e["foc"],
    }
    rows = clips.select("clip").distinct().join(grouped, "clip", "left").withColumn("e", F.coalesce("e", F.array().cast(grouped.schema["e"].dataType)))
    rows.select("clip", *[F.transform("e", parts[c]).cast(t).alias(c) for c, t in LABEL_ARRAYS.items()]).write.mode("overwrite").parquet(path)


def save_bundle(model, labels: list[str], path: str) -> None:
    """SNK15: a fitted pipeline with its label names."""
    model.write().overwrite().save(f"{path}/model")
    write_bytes(f"{path}/labels.json", json.dumps(labels).encode())


def load_bundle(path: str):
    """The pipeline and label names that `save_bundle` wrote."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), read_settings(f"{path}/labels.json")


def write_yaml(value: dict, path: str) -> None:
    """SNK18: a small configuration file."""
    write_bytes(path, dump_yaml(value).encode())


def write_arrow(df: DataFrame, path: str) -> None:
    """SRC10's counterpart: an Arrow file for each partition, in a folder."""

    def save(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held = list(batches)
        if held:
            out = io.BytesIO()
            with pa.ipc.new_file(out, held[0].schema) as w:
                for b in held:
                    w.write_batch(b)
            yield pa.record_batch({"name": [f"part-{TaskContext.get().partitionId():05d}.arrow"], "content": pa.array([out.getvalue()], pa.binary())})

    write_files(df.mapInArrow(save, "name string, content binary"), path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK13: rows of `new` replace rows of `old` with their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def report_lines(df: DataFrame) -> DataFrame:
    """SNK14: a one-row table as key=value lines."""
    pairs = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in df.columns]
    return df.select(F.explode(F.array(*pairs)).alias("line"))


def metric_series(df: DataFrame, run: str, step: str) -> DataFrame:
    """SNK17: metrics as (run, step, metric, value)."""
    rest = [c for c in df.columns if c not in (run, step)]
    return df.unpivot([run, step], rest, "metric", "value").where("value is not null")


def label_mapping(labels: list[str], unknown: str, spark) -> DataFrame:
    """SNK18: label to target; the unknown label maps to null."""
    return spark.createDataFrame([(x, x) for x in labels] + [(unknown, None)], "label string, target string")
