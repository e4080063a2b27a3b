"""What the clustering operators share: vectors on an integer grid, exact sums over a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(vector: str) -> Column:
    return F.transform(F.col(vector), lambda x: x.cast("double"))


def finite(values: Column) -> Column:
    """Whether a vector of doubles is there and all its components are finite numbers."""
    return F.coalesce(F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def on_grid(values: Column, scale: int) -> Column:
    """floor(scale * x) for each component as integers, or null if one is so large that the squared distance of two such vectors might not fit a long."""
    bound = F.least(F.floor(F.sqrt(F.lit(2.0**61) / F.greatest(F.size(values), F.lit(1)))) - 1, F.lit(1 << 29))
    scaled = F.transform(values, lambda x: F.floor(x * scale))
    return F.when(F.forall(values, lambda x: F.abs(x * scale) < bound), F.transform(scaled, lambda x: x.cast("int")))


def split_sums(slots) -> tuple[list[int], list[int]]:
    """Sums of any size as two longs each, of which sums over a table can't overflow."""
    return [int(x) >> 32 for x in slots], [int(x) & 0xFFFFFFFF for x in slots]


#: Columns of partial sums: which sum it is, and its two halves.
SUMS = "slot int, hi long, lo long"


def total(sums: DataFrame, slots: int) -> list[int]:
    """The sums of all partitions, a bounded number of them, on the driver."""
    out = [0] * slots
    for r in sums.groupBy("slot").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect():
        out[r["slot"]] = (r["hi"] << 32) + r["lo"]
    return out
