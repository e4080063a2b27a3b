"""Readers: CSV with given or inferred columns, tolerant JSON lines, manifests with a root line, matrices, audio, listings."""

from __future__ import annotations

import importlib
import io
import json
import os
import pickle
import re
import struct
import tempfile
import urllib.parse
import urllib.request
import wave
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.scalars import sample_count
from ..operators.scratch import written
from ..streaming.watch import with_retries
from .settings import read_settings
from .storage import is_file, names, open_input

#: Rows of what archives list that a task puts together.
FETCHED_ROWS = 10_000
# Names by which a manifest's columns are known, compared in lower case without spaces.
ALIASES = {"filename": ("filename", "file"), "start_s": ("start_s", "start"), "end_s": ("end_s", "end")}
MANIFEST = "audio_filepath string, duration string, sample_rate string, _corrupt string"
VALUE = "struct<start:double,end:double,channel:int,labels:string,choices:string>"
TASKS = (
    "id bigint, data struct<audio:string,file:string,wav:string>, audio string, file_upload string, label string,"
    f" annotations array<struct<was_cancelled:boolean,result:array<struct<value:{VALUE}>>>>"
)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """SRC1, SRC6: a declared schema; bad fields become null."""
    return spark.read.schema(schema).csv(path, header=header, sep=sep, mode="PERMISSIVE")


def manifest_columns(columns: list[str], given: tuple[int, int, int] | None = None) -> tuple[int, int, int]:
    """SRC2: positions of file name, start and end: given ones, else by alias, else by width (6 or more: 3 4 5; 5: 2 3 4)."""
    if given:
        return given
    plain = [re.sub(r"\s", "", c).lower() for c in columns]
    by_name = [next((plain.index(a) for a in names if a in plain), None) for names in ALIASES.values()]
    if all(i is not None for i in by_name):
        return tuple(by_name)
    if len(columns) >= 6:
        return 3, 4, 5
    if len(columns) == 5:
        return 2, 3, 4
    raise ValueError(f"can't tell the columns of a manifest with {len(columns)} columns")


def read_manifest_csv(spark: SparkSession, path: str, header: bool = True, given: tuple[int, int, int] | None = None) -> DataFrame:
    """SRC2: (filename, start_s, end_s) of a CSV with or without a header."""
    raw = spark.read.csv(path, header=header)
    at = manifest_columns(raw.columns, given)
    name, start, end = (raw.columns[i] for i in at)
    return raw.select(F.col(f"`{name}`").alias("filename"), F.expr(f"try_cast(`{start}` as double)").alias("start_s"), F.expr(f"try_cast(`{end}` as double)").alias("end_s"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: a JSON array of annotation tasks; a byte order mark is ignored, labels stay text (a string or a list)."""
    return spark.read.option("multiLine", True).schema(TASKS).json(path)


def read_jsonl(spark: SparkSession, path: str, default_rate: int | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC4: (records, rejects) of a JSON lines manifest.

    Records have audio_filepath, duration, sample_rate and n_samples, rounded half to even. Blank lines go; lines that
    aren't JSON, or have no path, duration or rate, are rejects with a reason.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    got = F.from_json("value", MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.withColumn("r", got).select("value", "r.*")
    duration = F.expr("try_cast(duration as double)")
    rate = F.coalesce(F.expr("try_cast(sample_rate as int)"), F.lit(default_rate).cast("int"))
    reason = F.when(F.col("_corrupt").isNotNull(), "bad_json").when(F.coalesce("audio_filepath", F.lit("")) == "", "no_path").when(duration.isNull(), "no_duration").when(rate.isNull(), "no_rate")
    rows = rows.withColumns({"reason": reason, "d": duration, "rate": rate})
    good = rows.where("reason is null").select("audio_filepath", F.col("d").alias("duration"), F.col("rate").alias("sample_rate"), sample_count("d", "rate").alias("n_samples"))
    return good, rows.where("reason is not null").select(F.col("value").alias("line"), "reason")


def read_root_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC5: (rows, bad lines) of manifests whose first line is a root folder: (root, rel_path, n_samples).

    The root of each file is its line at byte 0; the other lines are read in parallel and joined to it by file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    numbered = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.substring_index("value", "\n", 1).alias("root"))
    m = F.regexp_extract("value", r"^(.*\S)\s+(\d+)\s*$", 1)
    body = lines.join(numbered, "file").where((F.col("value") != F.col("root")) & (F.trim("value") != ""))
    body = body.withColumns({"rel_path": m, "n": F.expr("try_cast(regexp_extract(value, '^(.*\\\\S)\\\\s+(\\\\d+)\\\\s*$', 2) as bigint)")})
    ok = (F.col("rel_path") != "") & F.col("n").isNotNull()
    return body.where(ok).select(F.trim("root").alias("root"), "rel_path", F.col("n").alias("n_samples")), body.where(~ok).select("file", F.col("value").alias("line"))


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, count: int, before: int):
        self.path, self.first, self.count, self.before = path, first, count, before


def _npy_header(f) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type of an open .npy file, which is left at its first value."""
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if len(shape) != 2 or fortran:
        raise ValueError(f"a matrix in row order is needed, not {len(shape)} dimensions{' in column order' * fortran}")
    return shape, dtype


class _NpyReader(DataSourceReader):
    """Row ranges of a two-dimensional .npy file, or of a folder's files in the order of their names; each task seeks to its
    own rows and gives them as Arrow batches."""

    def __init__(self, options):
        self.path = options["path"]
        self.rows_each = int(options.get("rowseach", "65536"))
        self.first, self.end = int(options.get("firstrow", "0")), int(options.get("endrow", str(2**62)))

    def partitions(self):
        parts, before = [], 0
        for path in _files(self.path):
            with open_input(path) as f:
                rows = _npy_header(f)[0][0]
            lo, hi = max(0, self.first - before), min(rows, self.end - before)
            parts += [_Rows(path, i, min(self.rows_each, hi - i), before) for i in range(lo, hi, self.rows_each)]
            before += rows
        return parts or [_Rows("", 0, 0, 0)]

    def read(self, part):
        import pyarrow as pa

        if not part.count:
            return
        with open_input(part.path) as f:
            shape, dtype = _npy_header(f)
            width = shape[1] * dtype.itemsize
            f.seek(f.tell() + part.first * width)
            for lo in range(0, part.count, 4096):
                n = min(4096, part.count - lo)
                data = np.frombuffer(f.read(n * width), dtype=dtype).astype(np.float32)
                index = np.arange(n, dtype=np.int64) + part.before + part.first + lo
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * shape[1]), pa.array(data))
                yield pa.RecordBatch.from_arrays([pa.array(index), rows], names=["row_index", "embedding"])


class NpySource(DataSource):
    """SRC7: spark.read.format("npy").load(path) of a file or a folder -> (row_index, embedding).

    The options `firstRow` and `endRow` (exclusive) leave only that range's rows to be opened. Filters aren't taken over: Spark
    keeps what one query handed down for all others of the same DataFrame, which would then lose rows.
    """

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "row_index bigint, embedding array<float>"

    def reader(self, schema):
        return _NpyReader(self.options)


def list_files(spark: SparkSession, root: str, extensions: Iterable[str]) -> DataFrame:
    """SRC15: (path, length, modificationTime) of files below a root, by extension in any case; contents aren't read."""
    wanted = "|".join(re.escape(e.lstrip(".").lower()) for e in extensions)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return files.where(F.regexp_like(F.lower("path"), F.lit(rf"\.({wanted})$")))


def find_manifests(root: str, wav_limit: int | None = None) -> list[str]:
    """SRC16: every manifest.jsonl below a local root, depth first; with a limit, a folder with more WAV files ends its branch."""
    found = []
    for folder, folders, files in os.walk(root):
        if "manifest.jsonl" in files:
            found.append(os.path.join(folder, "manifest.jsonl"))
        if wav_limit is not None and sum(f.lower().endswith(".wav") for f in files) > wav_limit:
            folders.clear()
        folders.sort()
    return sorted(found)


def pruned_manifests(files: DataFrame, wav_limit: int, path: str = "path", name: str = "manifest.jsonl") -> DataFrame:
    """SRC16 over a listing of any size: paths of manifests that have no folder of over `wav_limit` WAV files above their own."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    rows = files.select(path, folder.alias("folder"))
    full = rows.where(F.lower(path).endswith(".wav")).groupBy("folder").agg(F.count("*").alias("n")).where(F.col("n") > wav_limit).select(F.col("folder").alias("above"))
    found = rows.where(F.substring_index(path, "/", -1) == name)
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i - 1), "/"))
    cut = found.select(path, F.explode(above).alias("above")).join(full, "above", "left_semi").select(path).distinct()
    return found.select(path).join(cut, path, "left_anti")


def _wav(content: bytes) -> tuple[int, int, np.ndarray] | None:
    try:
        with wave.open(io.BytesIO(content)) as w:
            width, channels, rate, frames = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.getnframes()
            if rate <= 0 or width not in (1, 2, 3, 4):
                return None
            data = w.readframes(frames)
            if width == 3:  # to the upper bytes of 32 bits
                wide = np.zeros((len(data) // 3, 4), dtype=np.uint8)
                wide[:, 1:] = np.frombuffer(data[: len(wide) * 3], dtype=np.uint8).reshape(-1, 3)
                data, width = wide.tobytes(), 4
            raw = np.frombuffer(data, dtype={1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
            x = ((raw - 128) / 128 if width == 1 else raw / float(1 << (8 * width - 1))).astype(np.float32)
            return rate, frames, x.reshape(-1, channels).mean(axis=1)
    except (wave.Error, EOFError, struct.error):
        return None


def decode_audio(df: DataFrame, content: str, samples: bool = True) -> DataFrame:
    """SRC11, SRC13, SRC14: replace a column of WAV bytes by duration, sample_rate and, if asked, samples (channels averaged).

    What can't be read, or holds no samples, has nulls; other columns pass through.
    """
    kept = [f for f in df.schema.fields if f.name != content]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "duration double, sample_rate int" + (", samples array<float>" if samples else "")

    def parse(batches):
        for pdf in batches:
            got = [None if c is None else _wav(bytes(c)) for c in pdf[content]]
            out = pdf.drop(columns=content).assign(duration=[g[1] / g[0] if g and g[1] else None for g in got], sample_rate=pd.array([g[0] if g and g[1] else None for g in got], dtype="Int32"))
            yield out.assign(samples=[g[2] if g else None for g in got]) if samples else out

    return df.mapInPandas(parse, schema)


#: The format numbers of plain samples and of the extended header.
PCM, EXTENSIBLE = 1, 0xFFFE


def wav_header(f) -> tuple[int, int] | None:
    """Sample rate and number of frames of an open WAV file: its chunks' heads are read, what lies between is passed over."""
    if f.read(4) != b"RIFF" or len(f.read(4)) < 4 or f.read(4) != b"WAVE":
        return None
    form = None
    while len(head := f.read(8)) == 8:
        name, size = head[:4], int.from_bytes(head[4:], "little")
        begin = f.tell()
        if name == b"fmt ":
            data = f.read(min(size, 16))
            if len(data) < 16:
                return None
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", data)
            if kind not in (PCM, EXTENSIBLE) or not channels or not 0 < bits <= 32:
                return None
            form = channels * ((bits + 7) // 8), rate
        elif name == b"data":
            return (form[1], size // form[0]) if form and form[1] > 0 else None
        f.seek(begin + size + size % 2)
    return None


def read_headers(files_: DataFrame, path: str = "path") -> DataFrame:
    """SRC13: add duration and sample_rate of WAV files from their headers; a file's samples aren't read, however long it is.

    What can't be read, or holds no samples, has nulls. Paths are those of `storage`.
    """
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in files_.schema.fields) + "duration double, sample_rate int"

    def run(batches):
        for pdf in batches:
            got = []
            for at in pdf[path]:
                try:
                    with open_input(at) as f:
                        got.append(wav_header(f))
                except OSError:
                    got.append(None)
            yield pdf.assign(duration=[g[1] / g[0] if g and g[1] else None for g in got], sample_rate=pd.array([g[0] if g and g[1] else None for g in got], dtype="Int32"))

    return files_.mapInPandas(run, schema)


def read_audio(spark: SparkSession, root: str, samples: bool = False) -> DataFrame:
    """SRC13, SRC14: (path, duration, sample_rate[, samples]) of WAV files; unreadable ones have nulls. Channels are averaged.

    Without samples only headers are read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(root)
    return decode_audio(found.select("path", "content"), "content", True) if samples else read_headers(found.select("path"))


def zip_slice(content: str = "content", at: str = "at") -> F.Column:
    """SRC17: the bytes `offset:length` of a container's content, from a reference `file.zip:offset:length`."""
    return F.expr(f"substring({content}, cast(split({at}, ':')[1] as int) + 1, cast(split({at}, ':')[2] as int))")


def read_slices(references: DataFrame, at: str = "at") -> DataFrame:
    """SRC17 for containers of any size: add `bytes`, read by seeking to `offset:length` of each reference's file."""
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in references.schema.fields) + "bytes binary"

    def read(batches):
        for pdf in batches:
            out = []
            for reference in pdf[at]:
                path, offset, length = reference.rsplit(":", 2)
                with open_input(path) as f:
                    f.seek(int(offset))
                    out.append(f.read(int(length)))
            yield pdf.assign(bytes=out)

    return references.mapInPandas(read, schema)


def read_splits(spark: SparkSession, **paths: str) -> DataFrame:
    """SRC10, SRC11: Parquet splits, or Arrow files (`.arrow`, `.feather`), as one table with a split column."""
    parts = []
    for name, p in paths.items():
        arrow = p.rstrip("/").endswith((".arrow", ".feather"))
        parts.append((spark.read.format("arrow_files").load(p) if arrow else spark.read.parquet(p)).withColumn("split", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _arrow_open(f):
    """A reader of an open Arrow file, by which single batches are read, or of a stream."""
    import pyarrow as pa

    try:
        return pa.ipc.open_file(f)
    except pa.ArrowInvalid:
        f.seek(0)
        return pa.ipc.open_stream(f)


class _ArrowReader(DataSourceReader):
    """A task for some batches of a file; a stream is one task. Only a task's own batches are read."""

    def __init__(self, options):
        self.path, self.batches_each = options["path"], int(options.get("batcheseach", "16"))

    def partitions(self):
        parts = []
        for path in _files(self.path):
            with open_input(path) as f:
                count = getattr(_arrow_open(f), "num_record_batches", None)
            parts += [InputPartition((path, i, min(count, i + self.batches_each))) for i in range(0, count, self.batches_each)] if count is not None else [InputPartition((path, None, None))]
        return parts or [InputPartition((None, 0, 0))]

    def read(self, part):
        path, first, end = part.value
        if path is None:
            return
        with open_input(path) as f:
            reader = _arrow_open(f)
            yield from (reader if first is None else (reader.get_batch(i) for i in range(first, end)))


def _files(path: str) -> list[str]:
    """A file, or the files of a folder."""
    return [f"{path.rstrip('/')}/{n}" for n in names(path)] if not os.path.splitext(path)[1] else [path]


class ArrowSource(DataSource):
    """SRC10: spark.read.format("arrow_files").load(path): Arrow files or streams, batches as they are, `batchesEach` of a file to a task."""

    @classmethod
    def name(cls):
        return "arrow_files"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        with open_input(_files(self.options["path"])[0]) as f:
            return from_arrow_schema(_arrow_open(f).schema)

    def reader(self, schema):
        return _ArrowReader(self.options)


LABEL_ARRAYS = {"start_time_lbl": "array<float>", "end_time_lbl": "array<float>", "start_frame_lbl": "array<bigint>", "end_frame_lbl": "array<bigint>", "lbl": "array<string>", "lbl_cat": "array<bigint>", "foc": "array<bigint>"}


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: a store of label arrays by clip to a row for each label, in order: clip, pos and the arrays' values.

    The store is nested Parquet (`sinks.write_labels`), or a folder of HDF5 files, one a clip, where h5py is installed. A
    clip without labels has no row.
    """
    hdf5 = any(n.lower().endswith((".h5", ".hdf5")) for n in names(path)) if "*" not in path else False
    stored = _hdf5_labels(spark, path) if hdf5 else spark.read.parquet(path)
    return stored.select("clip", F.posexplode(F.arrays_zip(*LABEL_ARRAYS)).alias("pos", "z")).select("clip", F.col("pos").cast("long").alias("pos"), "z.*")


def _hdf5_labels(spark: SparkSession, path: str) -> DataFrame:
    importlib.import_module("h5py")  # say so here, not in a task
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{h5,hdf5}").load(path).select("path", "content")

    def parse(batches):
        import h5py

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                with h5py.File(io.BytesIO(bytes(content)), "r") as f:
                    rows.append([os.path.splitext(os.path.basename(name))[0], *[[v.decode() if isinstance(v, bytes) else v for v in f[c][()].tolist()] if c in f else [] for c in LABEL_ARRAYS]])
            yield pd.DataFrame(rows, columns=["clip", *LABEL_ARRAYS])

    return files.mapInPandas(parse, "clip string, " + ", ".join(f"{c} {t}" for c, t in LABEL_ARRAYS.items()))


def read_label_frame(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: a label frame (Name, AudioFile, StartRelative, EndRelative, Focal), converted to Parquet once, in seconds.

    Times are intervals or numbers. Pickled frames are never loaded here, as that would run whatever they hold.
    """
    frame = spark.read.parquet(path)

    def seconds(c: str):
        kind = frame.schema[c].dataType.typeName()
        return F.col(c).cast("double") if "interval" not in kind else F.expr(f"extract(DAY FROM {c}) * 86400D + extract(HOUR FROM {c}) * 3600D + extract(MINUTE FROM {c}) * 60D + extract(SECOND FROM {c})").cast("double")

    return frame.select(F.col("Name").alias("name"), F.col("AudioFile").alias("audio_file"), seconds("StartRelative").alias("start_s"), seconds("EndRelative").alias("end_s"), F.col("Focal").alias("focal"))


def read_windows(spark: SparkSession, store: str) -> DataFrame:
    """SRC8: a vector store of three tables: windows with their recording's name and their vector."""
    windows, recordings, vectors = (spark.read.parquet(f"{store}/{t}") for t in ("windows", "recordings", "vectors"))
    return windows.join(recordings, "recording_id").join(vectors, "window_id").select("window_id", "recording_id", "filename", "start_s", "end_s", "embedding")


def read_json_or(path: str, default):
    """SRC23: a small result file, JSON or YAML, or a default where it is missing."""
    return read_settings(path if path.endswith((".json", ".yaml", ".yml")) else f"{path}.json", default)


def configured_sources(spark: SparkSession, given: list[dict] | None, defaults: list[dict], prefixes: list[str] | None = None) -> DataFrame:
    """SRC24: configured (bucket, prefix) pairs or the defaults, slashes normalised, distinct in order, optionally filtered."""
    seen: dict[tuple[str, str], None] = {}
    for s in given or defaults:
        seen.setdefault((s["bucket"].strip("/"), s.get("prefix", "").strip("/") + "/" if s.get("prefix", "").strip("/") else ""))
    kept = [k for k in seen if not prefixes or k[1].strip("/") in [p.strip("/") for p in prefixes]]
    return spark.createDataFrame([(i, *k) for i, k in enumerate(kept)], "pos int, bucket string, prefix string")


def source_table(sources: DataFrame, pos: str = "pos", bucket: str = "bucket", prefix: str = "prefix") -> DataFrame:
    """SRC24 from a table: (pos, bucket, prefix) with slashes normalised, each pair once, at its first place. A null prefix is none."""
    plain = F.btrim(F.coalesce(prefix, F.lit("")), F.lit("/"))
    rows = sources.select(F.col(pos).alias("pos"), F.btrim(bucket, F.lit("/")).alias("bucket"), F.when(plain != "", F.concat(plain, F.lit("/"))).otherwise("").alias("prefix"))
    return rows.groupBy("bucket", "prefix").agg(F.min("pos").alias("pos")).select("pos", "bucket", "prefix")


def saved_pages(options: dict) -> Callable[[str, str, str, str], str]:
    """Pages from a folder: `bucket-prefix-kind-token`, or without the kind; the first page's token is 0."""
    folder = options["pages"].rstrip("/")

    def fetch(kind: str, bucket: str, prefix: str, token: str) -> str:
        stem = f"{bucket}-{prefix.strip('/').replace('/', '-')}"
        for name in (f"{stem}-{kind}-{token or 0}", f"{stem}-{token or 0}"):
            if is_file(f"{folder}/{name}"):  # the folder itself isn't listed, a page would then cost as much as all of them
                with open_input(f"{folder}/{name}") as f:
                    return f.read().decode()
        raise FileNotFoundError(f"{stem}-{kind}-{token or 0}")

    return fetch


def web_pages(options: dict) -> Callable[[str, str, str, str], str]:
    """Pages over HTTP from the templates `json_url` and `xml_url`, which name {bucket}, {prefix} and {token}, with retries."""

    def fetch(kind: str, bucket: str, prefix: str, token: str) -> str:
        if not options.get(f"{kind}_url"):
            raise FileNotFoundError(f"no {kind}_url")
        quoted = {k: urllib.parse.quote(v, safe="") for k, v in (("bucket", bucket), ("prefix", prefix), ("token", token))}

        def get() -> str:
            with urllib.request.urlopen(options[f"{kind}_url"].format(**quoted), timeout=60) as f:
                return f.read().decode()

        return with_retries(get)

    return fetch


class _ListingReader(DataSourceReader):
    """One task for each prefix. Pages follow each other by their tokens; where the JSON listing fails, the XML one is read."""

    def __init__(self, options):
        self.options = dict(options)
        self.bucket, self.prefixes = options["bucket"], options.get("prefixes", "").split(",")
        self.extensions = tuple(e.strip().lower() for e in options.get("extensions", "").split(",") if e.strip())

    def partitions(self):
        return [InputPartition(p) for p in self.prefixes]

    def _fetch(self) -> Callable[[str, str, str, str], str]:
        module, _, name = self.options.get("fetch", f"{__name__}:{'saved_pages' if 'pages' in self.options else 'web_pages'}").partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def _listed(self, fetch: Callable[[str, str, str, str], str], kind: str, prefix: str, token: str = "") -> Iterator[tuple[str, str, list[tuple[str, int]]]]:
        seen = set()
        while token not in seen:
            seen.add(token)
            page = fetch(kind, self.bucket, prefix, token)
            if kind == "json":
                json.loads(page)  # an error page isn't a listing
            yield kind, token, parse_listing(page)
            token = next_token(page)
            if not token:
                return
        raise ValueError(f"the listing of {prefix} comes back to {token}")

    def pages(self, prefix: str, kind: str = "", token: str = "") -> Iterator[tuple[str, str, list[tuple[str, int]]]]:
        """Pages from a token on as (kind, token, keys and sizes); where the kind isn't known yet JSON is tried, then XML.

        The first page of a kind that isn't known comes when the JSON listing is through, as XML replaces all of it where it
        fails; until then its pages are in a temporary file, so that one page at a time is in memory.
        """
        fetch = self._fetch()
        if kind:
            yield from self._listed(fetch, kind, prefix, token)
            return
        with tempfile.TemporaryFile() as kept:
            try:
                for page in self._listed(fetch, "json", prefix, token):
                    pickle.dump(page, kept)
            except (OSError, ValueError, KeyError):
                yield from self._listed(fetch, "xml", prefix, token)
                return
            end = kept.tell()
            kept.seek(0)
            while kept.tell() < end:
                yield pickle.load(kept)

    def wanted(self, key: str) -> bool:
        return not key.endswith("/") and key.lower().endswith(self.extensions or ("",))

    def read(self, part):
        for _, _, keys in self.pages(part.value):
            yield from ((self.bucket, key, size) for key, size in keys if self.wanted(key))


class _ListingStream(DataSourceStreamReader):
    """A listing as a stream: how far it is, for each prefix the kind of its pages, the token of the last page and the last key.

    Pages come in the order of their keys, so new keys stand behind the last one: a batch begins at the page where the one
    before it ended, and tasks, one a prefix, list what is new. Keys that are added before the last one aren't seen.
    """

    def __init__(self, options):
        self.listing, self.at = _ListingReader(options), None

    def initialOffset(self):
        return {p: ["", "", ""] for p in self.listing.prefixes}

    def latestOffset(self):
        self.at = {p: self._last(p, at) for p, at in (self.at or self.initialOffset()).items()}
        return self.at

    def _last(self, prefix: str, at: list) -> list:
        for kind, token, keys in self.listing.pages(prefix, at[0], at[1]):
            at = [kind, token, max([at[2], *(k for k, _ in keys)])]
        return at

    def partitions(self, start, end):
        return [InputPartition((p, start.get(p, ["", "", ""]), upto)) for p, upto in end.items() if upto[2] > start.get(p, ["", "", ""])[2]]

    def read(self, part):
        prefix, (kind, token, after), (_, _, upto) = part.value
        for _, _, keys in self.listing.pages(prefix, kind, token):
            for key, size in keys:
                if after < key <= upto and self.listing.wanted(key):
                    yield self.listing.bucket, key, size


class ListingSource(DataSource):
    """SRC18-SRC20: spark.read.format("listing"): pages of bucket listings, JSON or XML -> (bucket, key, size); ST1:
    spark.readStream.format("listing"): keys that are new since the batch before.

    Options: bucket, prefixes (comma-separated), extensions (those to keep), and where pages come from: `pages` (a folder of
    saved ones), `json_url` and `xml_url` (templates), or `fetch` (`module:function`, called with the options, giving a
    function of kind, bucket, prefix and token).
    """

    @classmethod
    def name(cls):
        return "listing"

    def schema(self):
        return "bucket string, key string, size bigint"

    def reader(self, schema):
        return _ListingReader(self.options)

    def streamReader(self, schema):
        return _ListingStream(self.options)


def month_prefixes(template: str, years: Iterable[int], months: Iterable[int | str] | None = None) -> list[str]:
    """SRC20: prefixes of the wanted months, so that others are never listed: a template with {year} and {month}."""
    return [template.format(year=int(y), month=f"{int(m):02d}") for y in years for m in (months or range(1, 13))]


def next_token(page: str) -> str:
    """The token of the page after this one; empty after the last."""
    try:
        return str(json.loads(page).get("nextPageToken") or "")
    except ValueError:
        import xml.etree.ElementTree as ET

        values = {e.tag.rpartition("}")[2]: (e.text or "") for e in ET.fromstring(page)}
        if values.get("IsTruncated", "").strip().lower() != "true":
            return ""
        keys = [k for k, _ in parse_listing(page)]
        return values.get("NextContinuationToken") or values.get("NextMarker") or (keys[-1] if keys else "")


def parse_listing(page: str) -> list[tuple[str, int]]:
    """(name, size) of one page: JSON with `items`, else XML with Contents of Key and Size."""
    try:
        return [(i["name"], int(i.get("size", 0))) for i in json.loads(page).get("items", [])]
    except ValueError:
        import xml.etree.ElementTree as ET

        local = lambda e: e.tag.rpartition("}")[2]
        out = []
        for item in ET.fromstring(page).iter():
            if local(item) == "Contents":
                values = {local(c): c.text for c in item}
                out.append((values["Key"], int(values.get("Size") or 0)))
        return out


def crawl(pages: DataFrame, start: str, base: str, folders: list[str] | None = None, extensions: Iterable[str] | None = None) -> DataFrame:
    """SRC21: URLs reachable from `start` below `base`, over a table of saved pages (url, links): frontiers by joins.

    Links ending in a slash that name none of `folders`, if given, aren't followed; of the URLs found those with one of the
    `extensions`, if given, are returned. Each round joins the frontier with the pages and takes away what was seen; it ends
    when nothing new is found, which it must, as every round adds URLs of the table.
    """
    spark = pages.sparkSession
    seen = frontier = spark.createDataFrame([(start,)], "url string")
    allowed = F.col("url").startswith(base)
    if folders:
        allowed = allowed & (~F.col("url").endswith("/") | F.element_at(F.split("url", "/"), -2).isin(*folders))
    while True:
        fresh = written(pages.join(frontier, "url").select(F.explode("links").alias("url")).where(allowed).distinct().join(seen, "url", "left_anti"))
        if fresh.isEmpty():
            break
        seen, frontier = written(seen.unionByName(fresh)), fresh
    if extensions:
        seen = seen.where(F.lower("url").rlike(r"\.(" + "|".join(re.escape(e.lstrip(".").lower()) for e in extensions) + ")$"))
    return seen


def archive_params(defaults: dict, shared: dict, target: dict, core: dict) -> dict:
    """SRC22: parameters of an archive request: defaults, then shared, then the target's extras, then core fields; nulls drop."""
    return {k: v for k, v in {**defaults, **shared, **target, **core}.items() if v is not None}


def archive_requests(spark: SparkSession, targets: list[dict], defaults: dict, shared: dict, token: str | None = None, token_variable: str | None = None) -> DataFrame:
    """SRC22: a row for each target: (target, params), its extras over shared parameters over defaults, its core fields over all.

    A target has `name`, `core` and `extra`. The token is the one given, else that of the environment variable; without
    either it raises.
    """
    secret = token or (os.environ.get(token_variable) if token_variable else None)
    if not secret:
        raise ValueError("no token: give one, or name an environment variable that holds it")
    rows = [(t["name"], {k: str(v) for k, v in archive_params(defaults, shared, t.get("extra", {}), t["core"] | {"token": secret}).items()}) for t in targets]
    return spark.createDataFrame(rows, "target string, params map<string,string>")


def archive_request_table(targets: DataFrame, defaults: dict, shared: dict, token: str) -> DataFrame:
    """SRC22 from a table of (target, core, extra), the latter two maps of strings: (target, params) as `archive_requests` layers them."""
    layer = lambda under, over: F.map_zip_with(under, over, lambda k, x, y: F.coalesce(y, x))
    fixed = archive_params(defaults, shared, {}, {})
    base = F.create_map(*[F.lit(str(x)) for kv in fixed.items() for x in kv]) if fixed else F.create_map().cast("map<string,string>")
    some = lambda c: F.coalesce(c, F.create_map().cast("map<string,string>"))
    params = layer(layer(base, some("extra")), layer(some("core"), F.create_map(F.lit("token"), F.lit(token))))
    return targets.select("target", F.map_filter(params, lambda k, v: v.isNotNull()).alias("params"))


def fetch_archives(requests: DataFrame, fetch: Callable[[dict], Iterable[tuple[str, int]]]) -> DataFrame:
    """SRC22: (target, file, size) of what `fetch` lists for each request, with retries; tasks fetch side by side."""

    def frame(rows: list[tuple[str, str, int]]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["target", "file", "size"]).astype({"target": object, "file": object, "size": "int64"})

    def run(batches):
        for pdf in batches:
            rows: list[tuple[str, str, int]] = []
            for target, params in zip(pdf["target"], pdf["params"]):
                rows += [(target, f, n) for f, n in with_retries(lambda: list(fetch(dict(params))))]  # noqa: B023
                if len(rows) >= FETCHED_ROWS:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    return requests.mapInPandas(run, "target string, file string, size bigint")
