"""Intermediate tables in the folder that `spark.checkpoint.dir` names; a temporary one where that is unset, on one machine only.

All go below one folder of the application, which the file system deletes when the application ends, also after a failure.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[tuple[str, str], str] = {}


def folder(spark: SparkSession) -> str:
    """The application's folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or ""
    at = (spark.sparkContext.applicationId, named)
    if at not in _FOLDERS:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = named.rstrip("/") or f"file://{tempfile.mkdtemp(prefix='tidefold-')}"
        _FOLDERS[at] = f"{base}/tidefold-{at[0]}"
        system, path = _place(spark, _FOLDERS[at])
        system.mkdirs(path)
        system.deleteOnExit(path)
    return _FOLDERS[at]


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        system, where = _place(spark, p)
        system.delete(where, True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a table that is written once and read as often as needed."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
