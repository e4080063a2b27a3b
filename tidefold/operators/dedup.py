"""Dedup with conflict counts, lookups in which the last writer wins, tolerant and rejecting filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def first_wins(df: DataFrame, key: str | list[str], order: list, value: str) -> DataFrame:
    """The first row of each key in the order, with how many duplicates it had and how many of them had another value.

    Aggregates with partial sums instead of a window, so a hot key isn't gathered: the first row is the least struct of order and row.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    # a conflict is a value that differs from the first; counting values needs no second pass over rows
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(F.struct(*order, F.struct(*rest).alias("__row"))).alias("__first"))
    whole = counts.groupBy(*keys).agg(F.min("__first").alias("__first"), F.sum("__n").alias("__all"), F.min_by("__n", "__first").alias("__same"))
    return whole.select(*keys, F.col("__first.__row.*"), (F.col("__all") - 1).alias("duplicates"), (F.col("__all") - F.col("__same")).alias("conflicts"))


def last_wins(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def anti_new(listing: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of a listing whose key isn't done yet. Null keys are kept: they match nothing."""
    return listing.join(done.select(key).distinct(), key, "left_anti")


def assert_one_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """Distinct (key, label); a key with two labels raises when rows are read."""
    pairs = df.select(key, label).groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("__other"))
    same = F.assert_true(F.col(label) == F.col("__other"), F.concat(F.lit("more than one label: "), F.col(key).cast("string")))
    return pairs.where(same.isNull()).select(key, label)


def assert_not_null(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows; a null in a named column raises when rows are read."""
    for c in columns:
        df = df.where(F.assert_true(F.col(c).isNotNull(), F.lit(f"null in {c}")).isNull())
    return df


def reject_reason(samples: str, frames: int, std_min: float, rms_min: float, peak_min: float) -> Column:
    """Why an array of samples is rejected, the first reason that holds, or null.

    Order: wrong_frame_count, non_finite, std_lt, rms_lt, peak_lt. The deviation is that of the population.
    """

    def judged(x: Column) -> Column:
        finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        rms = F.sqrt(F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v), F.size(x)))
        peak = F.greatest(F.array_max(x), -F.array_min(x))
        levels = F.when(rms < rms_min, "rms_lt").when(peak < peak_min, "peak_lt")
        spread = scalars.moments(x, lambda mean, std: F.when(std < std_min, "std_lt"))
        return F.when(F.size(x) != frames, "wrong_frame_count").when(~finite, "non_finite").otherwise(F.coalesce(spread, levels))

    return scalars.let(F.transform(F.col(samples), lambda v: v.cast("double")), judged)


def shifted_partner(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Pair each row with the next in hash order, the last with the first: a permutation without fixed points."""
    from .frames import running_totals
    from .sampling import hash_order

    ranked = running_totals(df.select(key, hash_order(seed, key).alias("__h")), ["__h", key], {"__r": F.lit(1)})
    total = ranked.agg(F.max("__r").alias("__n"))  # one row
    nxt = ranked.crossJoin(F.broadcast(total)).select(F.col(key).alias("partner"), F.when(F.col("__r") == 1, F.col("__n")).otherwise(F.col("__r") - 1).alias("__r"))
    return ranked.select(key, "__r").join(nxt, "__r").select(key, "partner")


def aligned(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """JN12: rows of two tables side by side by an explicit row number; tables of different lengths raise."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows beside {m}")
    return left.join(right, index)
