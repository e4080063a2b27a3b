"""Texts joined with the patterns that they contain, without a nested loop over both tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

GRAM = 3


def _grams(text: Column, sizes: list[int]) -> Column:
    """The distinct pieces of 1 to 3 characters, a number for each."""

    def numbers(content: bytes) -> np.ndarray:
        c = np.frombuffer(content.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        of = {1: lambda: -1 - c, 2: lambda: -(1 << 42) - (c[:-1] << 21 | c[1:]), 3: lambda: c[:-2] << 42 | c[1:-1] << 21 | c[2:]}
        return np.unique(np.concatenate([of[n]() for n in sizes if len(c) >= n] or [np.empty(0, dtype=np.int64)]))

    return F.pandas_udf(lambda texts: texts.map(numbers), "array<long>")(text.cast("binary"))


def containing(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Pairs (key, text, pattern) of each row of `texts` and each distinct pattern that stands in its text, exactly.

    The pieces of three characters of all patterns are an inverted table. How many texts hold each piece is counted, each
    pattern goes under its rarest one, texts meet patterns on that alone, and what meets is verified on the whole text.
    Patterns of one or two characters go under themselves. An empty pattern stands in every text. Null texts and patterns
    match nothing; case counts. Texts of a repeated key are rows of their own. Empty tables give no rows.
    """
    spark = texts.sparkSession
    wanted = written(patterns.select(F.col(pattern).alias("pattern")).where("pattern is not null").distinct())
    rows = texts.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where("__text is not null")
    sizes = [r[0] for r in wanted.select(F.least(F.length("pattern"), F.lit(GRAM)).alias("n")).distinct().collect()]  # 0 to 3
    full = wanted.where("pattern <> ''")
    of_pattern = full.where(F.length("pattern") >= GRAM).select("pattern", F.explode(_grams(F.col("pattern"), [GRAM])).alias("gram"))
    for n in range(1, GRAM):
        if n in sizes:  # short patterns go under themselves
            of_pattern = of_pattern.unionByName(full.where(F.length("pattern") == n).select("pattern", F.explode(_grams(F.col("pattern"), [n])).alias("gram")))
    of_pattern = written(of_pattern)
    asked = written(of_pattern.select("gram").distinct())
    pieces = [n for n in sizes if n]
    of_text = rows.select("__key", F.explode(_grams(F.col("__text"), pieces)).alias("gram")) if pieces else rows.select("__key", F.lit(0).cast("long").alias("gram")).limit(0)
    of_text = written(of_text.join(asked, "gram"))  # of all pieces those that some pattern has
    counts = of_text.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = of_pattern.join(counts, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).where("least.n > 0")
    rarest = written(rarest.select("pattern", F.col("least.gram").alias("gram")))
    met = of_text.join(rarest, "gram").select("__key", "pattern").distinct()
    same = F.col("r.__key").eqNullSafe(F.col("m.__key"))
    found = rows.alias("r").join(met.alias("m"), same).where(F.contains("__text", "pattern")).select("r.__key", "__text", "pattern")
    if 0 in sizes:
        found = found.unionByName(rows.select("__key", "__text", F.lit("").alias("pattern")))
    return found.select(F.col("__key").alias(key), F.col("__text").alias(text), "pattern")
