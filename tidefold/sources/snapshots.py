"""Tables that are replaced as a whole while others read them: immutable folders, and a small file for each version.

A version is a list of folders, one for each range of keys, and the first key of each. Writing makes new folders, then a file
that names them, which gets its name, the next number, by one rename when it is whole. A reader takes the file of the highest
number and reads folders that nobody changes. An upsert writes the ranges that it touches and names the others again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Versions whose folders stay, for readers that began before the last ones.
KEPT = 3
VERSION = "_version-"


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> list[str]:
    system, at = _system(spark, path)
    if not system.exists(at):
        return []
    return sorted(n for n in (s.getPath().getName() for s in system.listStatus(at)) if n.startswith(VERSION))


def _read(spark: SparkSession, path: str, name: str) -> dict:
    system, at = _system(spark, f"{path}/{name}")
    stream = system.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def _current(spark: SparkSession, path: str) -> dict | None:
    found = _versions(spark, path)
    return _read(spark, path, found[-1]) if found else None


def _publish(spark: SparkSession, path: str, ranges: list[dict], schema: dict) -> None:
    """The next version; versions before the last KEPT go, with folders that only they name."""
    names = _versions(spark, path)
    system, part = _system(spark, f"{path}/_{uuid.uuid4().hex}.part")
    out = system.create(part)
    out.write(bytearray(json.dumps({"ranges": ranges, "schema": schema}).encode()))
    out.close()
    number = int(names[-1].removeprefix(VERSION)) + 1 if names else 0
    if not system.rename(part, _system(spark, f"{path}/{VERSION}{number:012d}")[1]):
        raise OSError(f"version {number} of {path} is there already")
    names = _versions(spark, path)
    folders = {name: {r["folder"] for r in _read(spark, path, name)["ranges"]} for name in names}
    needed = set().union(*(folders[name] for name in names[-KEPT:]))
    for name in names[:-KEPT]:
        for folder in folders[name] - needed:
            system.delete(_system(spark, f"{path}/{folder}")[1], True)
        system.delete(_system(spark, f"{path}/{name}")[1], False)


def _written(df: DataFrame, path: str, place: Column) -> str:
    folder = f"data-{uuid.uuid4().hex}"
    df.withColumn("__range", place).write.partitionBy("__range").parquet(f"{path}/{folder}")
    return folder


def write_snapshot(df: DataFrame, path: str, key: str | None = None, ranges: int = 1, least_rows: int = 0) -> int:
    """Replace the table at `path` by `df`, cut into `ranges` ranges of `key`; its rows. Under `least_rows` rows it raises and changes nothing.

    Readers see the old table or the new one, at any time. One writer at a time. A key is a number or a string; null keys are
    in the first range.
    """
    spark = df.sparkSession
    place = F.spark_partition_id() if key and ranges > 1 else F.lit(0)
    folder = _written(df.repartitionByRange(ranges, key) if key and ranges > 1 else df, path, place)
    stored = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__range", T.IntegerType())])).parquet(f"{path}/{folder}")
    found = stored.groupBy("__range").agg(F.count("*").alias("n"), *([F.min(key).alias("first")] if key else [])).orderBy("__range").collect()  # a row a range
    rows = sum(r["n"] for r in found)
    if rows < least_rows:
        system, at = _system(spark, f"{path}/{folder}")
        system.delete(at, True)
        raise ValueError(f"{rows} rows instead of {least_rows} at least")
    _publish(spark, path, [{"first": r["first"] if key else None, "folder": f"{folder}/__range={r['__range']}"} for r in found], df.schema.jsonValue())
    return rows


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is now; what is read later is this version too."""
    now = _current(spark, path)
    if now is None:
        raise FileNotFoundError(f"no version of a table in {path}")
    schema = T.StructType.fromJson(now["schema"])
    return spark.read.schema(schema).parquet(*[f"{path}/{r['folder']}" for r in now["ranges"]]) if now["ranges"] else spark.createDataFrame([], schema)


def upsert_snapshot(new: DataFrame, path: str, key: str) -> int:
    """Rows of `new` replace those of their key, others are added; how many ranges were written anew.

    Only ranges that hold keys of `new` are read and written. Keys compare as they did in `write_snapshot`; of several new
    rows of one key all stay, and rows with a null key replace nothing.
    """
    spark = new.sparkSession
    now = _current(spark, path)
    if now is None or not now["ranges"]:
        write_snapshot(new, path, key)
        return 1
    firsts = F.array(*[F.lit(r["first"]).cast(new.schema[key].dataType) for r in now["ranges"]])
    mine = F.greatest(F.size(F.filter(firsts, lambda x: x <= F.col(key))) - 1, F.lit(0))
    placed = new.withColumn("__at", mine)
    touched = sorted(r[0] for r in placed.select("__at").distinct().collect())  # ranges, a bounded number
    if not touched:
        return 0
    schema = T.StructType.fromJson(now["schema"])
    parts = [spark.read.schema(schema).parquet(f"{path}/{now['ranges'][k]['folder']}").withColumn("__at", F.lit(k)) for k in touched]
    old = parts[0]
    for p in parts[1:]:
        old = old.unionByName(p)
    merged = old.join(new.select(key).distinct(), key, "left_anti").unionByName(placed)
    folder = _written(merged, path, F.col("__at"))
    ranges = [dict(r) for r in now["ranges"]]
    for k in touched:
        ranges[k]["folder"] = f"{folder}/__range={k}"
    _publish(spark, path, ranges, now["schema"])
    return len(touched)
