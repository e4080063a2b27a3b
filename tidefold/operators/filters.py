"""Row filters by named columns. All are plain column conditions: they reach the scan, and rows with a null there go."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_length(df: DataFrame, samples: str, expected: float) -> DataFrame:
    """FIL1: clips of exactly so many samples."""
    return df.where(F.col(samples) == expected)


def at_least(df: DataFrame, **least: float) -> DataFrame:
    """FIL3, FIL12: rows whose named columns (a sample rate, a size) reach their bounds."""
    kept = df
    for name, bound in least.items():
        kept = kept.where(F.col(name) >= bound)
    return kept


def duration_between(df: DataFrame, duration: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """FIL4: durations from `low` to `high`, both included; a bound that isn't given holds for all but null."""
    kept = df.where(F.col(duration).isNotNull())
    kept = kept if low is None else kept.where(F.col(duration) >= low)
    return kept if high is None else kept.where(F.col(duration) <= high)


def proper_intervals(df: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """FIL8: intervals that end after they start."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return df.where(b > a)


def without_any(df: DataFrame, text: str, parts: Iterable[str]) -> DataFrame:
    """FIL6: texts that hold none of the parts."""
    kept = df
    for part in parts:
        kept = kept.where(~F.contains(F.col(text), F.lit(part)))
    return kept


def with_any(df: DataFrame, text: str, parts: Iterable[str]) -> DataFrame:
    """FIL13: texts that hold one of the parts."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(F.col(text), F.lit(part))
    return df.where(found)


def label_route(label: str, allowed: Iterable[str], denied: Iterable[str] = (), other: str = "background") -> Column:
    """FIL9: the label where it is allowed and not denied, else the other one."""
    kept = [x for x in allowed if x not in set(denied)]
    return F.when(F.col(label).isin(*kept), F.col(label)).otherwise(other) if kept else F.lit(other)


def labelled_enough(files: DataFrame, sizes: DataFrame, key: str, size: str, label_size: str, least: float, least_label: float = 0) -> DataFrame:
    """FIL12: files of a least size whose label file (key, label_size) is over a least size; a missing one counts as empty."""
    joined = files.where(F.col(size) >= least).join(sizes.select(key, label_size), key, "left")
    return joined.where(F.coalesce(label_size, F.lit(0)) > least_label).select(*files.columns)


def with_entries(df: DataFrame, array: str, keep) -> DataFrame:
    """FIL16: rows some of whose array's entries pass `keep`, with those only."""
    return df.withColumn(array, F.filter(array, keep)).where(F.size(array) > 0)


def of_individual(files: DataFrame, name: str, individual: str, lookup: DataFrame | None = None) -> DataFrame:
    """SO12: add `is_individual`. By the file's name without folder and suffix, in any case; with a lookup (RandomizedName,
    OriginalName) whether a name whose original holds `_individual` is part of the file's path.

    The lookup's names of one individual are few; they are matched by containment, after Spark's own size check.
    """
    if lookup is None:
        stem = F.regexp_extract(F.lower(name), r"([^/]*?)(\.[^./]*)?$", 1)
        return files.withColumn("is_individual", F.coalesce(F.contains(stem, F.lit(individual.lower())), F.lit(False)))
    mine = lookup.where(F.contains("OriginalName", F.lit(f"_{individual}"))).select("RandomizedName").distinct()
    hits = files.select(name).distinct().join(mine, F.contains(F.col(name), F.col("RandomizedName"))).select(name).distinct()
    return files.join(hits.withColumn("is_individual", F.lit(True)), name, "left").withColumn("is_individual", F.coalesce("is_individual", F.lit(False)))
