"""Reproducible samples, caps and splits: the order is md5(seed:key), the same in any engine and at any partitioning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import running_in_groups, running_totals


def hash_order(seed: int | str, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def ranked(df: DataFrame, group: str | list[str] | None, key: str, seed: int | str = 0, rank: str = "__rn", count: str = "__n") -> DataFrame:
    """Add each row's place in hash order within its group (or the table) and the group's size; large groups stand in many tasks."""
    if group is None:
        out = running_totals(df.withColumn("__h", hash_order(seed, key)), ["__h", key], {rank: F.lit(1)}).drop("__h")
        return out.crossJoin(F.broadcast(df.agg(F.count("*").alias(count))))  # one row
    return running_in_groups(df, [group] if isinstance(group, str) else group, [hash_order(seed, key), key], {rank: F.lit(1)}, counts=count)


def per_group(df: DataFrame, group: str | list[str], key: str, n: int | Column, seed: int | str = 0) -> DataFrame:
    """n rows of each group in hash order; a fixed n cuts each partition to n rows a group before the shuffle. As a column, n
    may use `__n`, the group's size."""
    if isinstance(n, int):
        over = W.partitionBy(group).orderBy(hash_order(seed, key), key)
        return df.withColumn("__rn", F.row_number().over(over)).where(F.col("__rn") <= n).drop("__rn")
    return ranked(df, group, key, seed).where(F.col("__rn") <= n).drop("__rn", "__n")


def ranked_split(df: DataFrame, stratum: str | None, key: str, fractions: tuple[float, float], seed: int | str = 0) -> DataFrame:
    """Add split: of each stratum round(n * f) rows (half to even) are test, then val, the rest train."""
    test = F.bround(F.col("__n") * fractions[0]).cast("long")
    val = F.bround(F.col("__n") * fractions[1]).cast("long")
    split = F.when(F.col("__rn") <= test, "test").when(F.col("__rn") <= test + val, "val").otherwise("train")
    return ranked(df, stratum, key, seed).withColumn("split", split).drop("__rn", "__n")


def fraction_sizes(n: Column, train: float, val: float) -> tuple[Column, Column, Column]:
    """Sizes of train, val and test: max(1, round(n f)), and from three rows on at least one row for val and for test."""
    big = n >= 3
    t = F.greatest(F.lit(1), F.bround(n * train)).cast("long")
    t = F.when(big, F.least(t, n - 2)).otherwise(n)
    v = F.when(big, F.least(F.greatest(F.lit(1), F.bround(n * val)).cast("long"), n - t - 1)).otherwise(F.lit(0))
    return t.cast("long"), v.cast("long"), (n - t - v).cast("long")


def keep_top_union(df: DataFrame, score: str, newest: str, key: str, n: int, pinned: Column | None = None) -> DataFrame:
    """The n best, the n newest and the pinned rows, if there are more than 2 n rows; else all. Ties go to the smaller key."""
    best = df.orderBy(F.desc(score), key).limit(n)
    new = df.orderBy(F.desc(newest), key).limit(n)
    kept = best.unionByName(new)
    if pinned is not None:
        kept = kept.unionByName(df.where(pinned))
    enough = df.limit(2 * n + 1).agg((F.count("*") > 2 * n).alias("__many"))  # a one-row side
    few = df.join(F.broadcast(enough.where(~F.col("__many"))), how="inner").drop("__many")
    many = kept.join(F.broadcast(enough.where("__many")), how="inner").drop("__many")
    return few.unionByName(many).dropDuplicates([key])


def fair_share(sources: DataFrame, source: str, cap: str, total: int) -> DataFrame:
    """Sources in order each get min(cap, ceil(remaining / remaining sources)).

    Each share depends on all before it, so one task goes over the sources, a row at a time.
    """
    n = sources.count()
    kind = sources.schema[source].dataType.simpleString()

    def run(batches):
        left, at = total, 0
        for pdf in batches:
            shares = []
            for limit in pdf["cap"]:
                got = min(int(limit), -(-left // (n - at)))
                left, at = left - got, at + 1
                shares.append(got)
            yield pd.DataFrame({source: pdf[source], "share": shares})

    placed = sources.select(source, F.col(cap).cast("long").alias("cap")).repartitionByRange(1, source).sortWithinPartitions(source)
    return placed.mapInPandas(run, f"`{source}` {kind}, share bigint")


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """Add fold by group: groups by size, dealt out in turns, so that folds are group-disjoint and even.

    Only the group sizes, one row a group, are ordered, over many tasks; the rows get their fold by a join.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__c"))
    dealt = running_totals(sizes, [F.desc("__c"), group], {"__r": F.lit(1)}).withColumn("__r", F.col("__r") - 1)
    turn, at = F.floor(F.col("__r") / folds), F.pmod(F.col("__r"), F.lit(folds))
    dealt = dealt.select(group, F.when(turn % 2 == 0, at).otherwise(folds - 1 - at).cast("long").alias("fold"))
    return df.join(dealt, group)
