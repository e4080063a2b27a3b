"""Classification, ranking and clustering metrics as aggregates over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import running_totals


def argmax(array: str | Column) -> Column:
    """Index of the largest value from 0; the lowest index on ties."""
    a = F.col(array) if isinstance(array, str) else array
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def group_vectors(df: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """Element-wise avg or max of each group's vectors, in long form (key, dim, value): no vector is gathered."""
    long = df.select(key, F.posexplode(vector).alias("dim", "v"))
    stat = F.avg(F.col("v").cast("double")) if kind == "avg" else F.max(F.col("v").cast("double"))
    return long.groupBy(key, "dim").agg(stat.alias("value"))


def confusion(df: DataFrame, truth: str, predicted: str, classes: DataFrame) -> DataFrame:
    """Counts of every pair of classes, zero-filled. `classes` has one column, class, and is a few rows."""
    grid = classes.select(F.col("class").alias("truth")).crossJoin(F.broadcast(classes.select(F.col("class").alias("predicted"))))
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def normalised(matrix: DataFrame) -> DataFrame:
    """Rows of a confusion matrix as shares; an empty row is all 0."""
    share = F.try_divide(F.col("n").cast("double"), F.sum("n").over(W.partitionBy("truth")))
    return matrix.select("truth", "predicted", F.coalesce(share, F.lit(0.0)).alias("share"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class from a confusion matrix; divisions by zero give 0."""
    by_t = matrix.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    by_p = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = by_t.join(by_p, "class").withColumns({"precision": div(F.col("tp"), F.col("predicted")), "recall": div(F.col("tp"), F.col("support"))})
    return out.select("class", "precision", "recall", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def summary(report: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted F1, balanced accuracy, and macro F1 over classes seen in truth or prediction."""
    seen = matrix.groupBy().agg(F.sum("n").alias("total"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    met = matrix.where("n > 0").select(F.explode(F.array("truth", "predicted")).alias("class")).distinct().withColumn("met", F.lit(True))
    joined = report.join(met, "class", "left")
    agg = joined.agg(
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg(F.when(F.col("met"), F.col("f1"))).alias("seen_macro_f1"),
    )
    return agg.crossJoin(F.broadcast(seen)).select(F.try_divide(F.col("right").cast("double"), F.col("total")).alias("accuracy"), "macro_f1", "weighted_f1", "balanced_accuracy", "seen_macro_f1")


def _steps(df: DataFrame, score: str, target: str, keys: list[str]) -> DataFrame:
    """Positives and rows at each distinct score."""
    return df.groupBy(*keys, score).agg(F.sum(F.col(target).cast("double")).alias("tp"), F.count("*").cast("double").alias("n"))


def precision_recall(df: DataFrame, score: str, target: str, group: str | None = None) -> DataFrame:
    """Precision and recall at each distinct score, from the highest down: ([group], score, tp, precision, recall).

    Running sums go over all groups in one order and a group's own start is taken off, so neither a group nor the whole
    table is gathered in one task.
    """
    keys = [group] if group else []
    steps = _steps(df, score, target, keys)
    cum = running_totals(steps, [*keys, F.desc(score)], {"ctp": F.col("tp"), "cn": F.col("n")})
    whole = cum.groupBy(*keys).agg(F.min(F.col("ctp") - F.col("tp")).alias("tp0"), F.min(F.col("cn") - F.col("n")).alias("n0"), F.sum("tp").alias("positives"))
    joined = cum.join(whole, keys) if keys else cum.crossJoin(F.broadcast(whole))  # without groups, one row
    found = F.col("ctp") - F.col("tp0")
    return joined.select(*keys, score, "tp", "positives", (found / (F.col("cn") - F.col("n0"))).alias("precision"), F.try_divide(found, "positives").alias("recall"))


def average_precision(df: DataFrame, score: str, target: str, group: str | None = None) -> DataFrame:
    """Step-wise average precision: sum over distinct scores of (R_n - R_n-1) P_n; tied scores are one step."""
    keys = [group] if group else []
    return precision_recall(df, score, target, group).groupBy(*keys).agg(F.sum(F.try_divide("tp", "positives") * F.col("precision")).alias("ap"))


def roc_auc(df: DataFrame, score: str, target: str) -> DataFrame:
    """Binary AUC by rank sums with average ranks for ties, over counts by score."""
    ranked = running_totals(_steps(df, score, target, []), [score], {"upto": F.col("n")}).withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    agg = ranked.agg(F.sum(F.col("rank") * F.col("tp")).alias("r"), F.sum("tp").alias("p"), F.sum(F.col("n") - F.col("tp")).alias("q"))
    return agg.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def otsu(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Threshold that minimises the variance within two classes of a histogram of `bins` equal bins: one row, threshold.

    One aggregate for the bounds, one for the counts; what is searched is `bins` rows.
    """
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = df.crossJoin(F.broadcast(bounds)).where("hi > lo").groupBy(at.alias("bin"), "lo", "hi").agg(F.count("*").cast("double").alias("n"))
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    run, whole = W.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(F.lit(0))
    s = counts.withColumn("mid", mid).withColumns({"w0": F.sum("n").over(run), "s0": F.sum(F.col("n") * F.col("mid")).over(run), "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("mid")).over(whole)})
    between = F.try_divide(F.pow(F.col("s") * F.col("w0") / F.col("w") - F.col("s0"), F.lit(2)), F.col("w0") * (F.col("w") - F.col("w0")))
    return s.where("w0 < w").withColumn("between", F.round(between, 6)).orderBy(F.desc("between"), "bin").limit(1).select(F.col("mid").alias("threshold"))
