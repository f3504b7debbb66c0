"""Metrics over a long table of predictions, all as SQL aggregates and windows.

A prediction table has the grouping columns ``by``, y_true (0 or 1) and y_pred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def auc(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rank-based area under the ROC curve, ties at their average rank; null if a class is missing.

    Scores are grouped first, so a window holds one row for each distinct score.
    """
    per_score = pred.groupBy(*by, "y_pred").agg(F.sum("y_true").cast("double").alias("pos"), F.sum(1 - F.col("y_true")).cast("double").alias("neg"))
    below = Window.partitionBy(*by).orderBy("y_pred").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0.0)) + F.col("neg") * F.lit(0.5))
    return per_score.withColumn("won", won).groupBy(*by).agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))


def curve(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, y_pred, tp, fp, dp, p, n): cumulative counts at each distinct score, descending."""
    per_score = pred.groupBy(*by, "y_pred").agg(F.sum("y_true").cast("double").alias("dp"), F.sum(1 - F.col("y_true")).cast("double").alias("dn"))
    down = Window.partitionBy(*by).orderBy(F.desc("y_pred")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    return per_score.select(*by, "y_pred", "dp", F.sum("dp").over(down).alias("tp"), F.sum("dn").over(down).alias("fp"), F.sum("dp").over(whole).alias("p"), F.sum("dn").over(whole).alias("n"))


def average_precision(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    step = F.try_divide("dp", "p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return curve(pred, by).groupBy(*by).agg(F.sum(step).alias("average_precision"))


def roc_points(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, y_pred, fpr, tpr) at each distinct score."""
    return curve(pred, by).select(*by, "y_pred", F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr"))


def trapezoid_auc(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("y_pred"))
    at = roc_points(pred, by).withColumn("f0", F.coalesce(F.lag("fpr").over(w), F.lit(0.0))).withColumn("t0", F.coalesce(F.lag("tpr").over(w), F.lit(0.0)))
    return at.groupBy(*by).agg(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) * F.lit(0.5)).alias("roc_auc"))


def mean_roc(pred: DataFrame, by: Sequence[str], points: int = 100) -> DataFrame:
    """(fpr, tpr, tpr_std, low, high): curves of the groups interpolated on a grid, averaged, within one deviation."""
    w = Window.partitionBy(*by).orderBy("fpr", "tpr")
    start = pred.select(*by).distinct().withColumn("fpr", F.lit(0.0)).withColumn("tpr", F.lit(0.0))
    pts = roc_points(pred, by).select(*by, "fpr", "tpr").union(start).groupBy(*by, "fpr").agg(F.max("tpr").alias("tpr"))
    seg = pts.withColumn("f1", F.lead("fpr").over(w)).withColumn("t1", F.lead("tpr").over(w))
    last = F.lit(points - 1)
    first_i = F.ceil(F.col("fpr") * last).cast("int")
    stop_i = F.when(F.col("f1").isNull(), last).otherwise(F.ceil(F.col("f1") * last).cast("int") - 1)
    on = seg.withColumn("i", F.explode(F.when(stop_i >= first_i, F.sequence(first_i, stop_i)).otherwise(F.array().cast("array<int>"))))
    x = F.col("i") / last
    value = F.when(F.col("f1").isNull() | (x == F.col("fpr")), F.col("tpr")).otherwise(F.col("tpr") + (x - F.col("fpr")) * (F.col("t1") - F.col("tpr")) / (F.col("f1") - F.col("fpr")))
    value = F.when(F.col("i") == 0, 0.0).when(F.col("i") == last, 1.0).otherwise(value)
    grid = on.select("i", value.alias("v")).groupBy("i").agg(F.avg("v").alias("tpr"), F.stddev_pop("v").alias("tpr_std"))
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return grid.select((F.col("i") / last).alias("fpr"), "tpr", "tpr_std", clip(F.col("tpr") - F.col("tpr_std")).alias("low"), clip(F.col("tpr") + F.col("tpr_std")).alias("high"))


def confusion(pred: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """(by, tn, fp, fn, tp, accuracy, f1) at a threshold."""
    hit = F.col("y_pred") >= F.lit(threshold)
    count = lambda cond, name: F.sum(cond.cast("long")).alias(name)
    counts = pred.groupBy(*by).agg(count(~hit & (F.col("y_true") == 0), "tn"), count(hit & (F.col("y_true") == 0), "fp"), count(~hit & (F.col("y_true") == 1), "fn"), count(hit & (F.col("y_true") == 1), "tp"))
    two = 2 * F.col("tp")
    f1 = F.coalesce(F.try_divide(two.cast("double"), (two + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0))
    accuracy = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return counts.withColumn("accuracy", accuracy).withColumn("f1", f1)


def threshold_sweep(pred: DataFrame, by: Sequence[str], steps: int = 17, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(by, threshold, f1) of the best of evenly spaced thresholds; the lowest wins ties.

    Scores are counted by the thresholds they pass before anything is summed, so
    the rows don't multiply with the thresholds.
    """
    width = (high - low) / (steps - 1)
    passed = F.least(F.greatest(F.floor((F.col("y_pred") - F.lit(low)) / F.lit(width) + F.lit(1e-9)) + 1, F.lit(0)), F.lit(steps)).cast("int")
    counts = pred.groupBy(*by, passed.alias("passed")).agg(F.sum("y_true").alias("p"), F.sum(1 - F.col("y_true")).alias("n"))
    total = Window.partitionBy(*by)
    counts = counts.withColumn("all_p", F.sum("p").over(total)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    at = counts.groupBy(*by, "k").agg(F.sum(F.when(F.col("passed") >= F.col("k"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("passed") >= F.col("k"), F.col("n")).otherwise(0)).alias("fp"), F.max("all_p").alias("all_p"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("tp") + F.col("fp") + F.col("all_p")).cast("double")), F.lit(0.0))
    best = at.withColumn("f1", f1).groupBy(*by).agg(F.max(F.struct("f1", (-F.col("k")).alias("k"))).alias("b"))
    return best.select(*by, F.round(F.lit(low) + (-F.col("b.k") - 1) * F.lit(width), 6).alias("threshold"), F.col("b.f1").alias("f1"))


def summarise(long: DataFrame, by: Sequence[str], iteration: str = "iteration") -> DataFrame:
    """(by, metric, mean, std): folds averaged to iterations, then mean and population deviation over these."""
    inner = long.groupBy(*by, "metric", iteration).agg(F.avg("value").alias("v"))
    return inner.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def selection_frequency(coefs: DataFrame, least: float = 0.05) -> DataFrame:
    """(feature_name, importance, importance_std, frequency) over fits; coefs has feature_name and coef."""
    size = F.abs("coef")
    return coefs.groupBy("feature_name").agg(F.avg(size).alias("importance"), F.stddev_pop(size).alias("importance_std"), F.avg((size > least).cast("double")).alias("frequency"))


def best_variant(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, candidate, score): the first candidate, by its number, of the greatest score; scores has candidate and score."""
    best = scores.groupBy(*by).agg(F.max(F.struct("score", (-F.col("candidate")).alias("c"))).alias("b"))
    return best.select(*by, (-F.col("b.c")).alias("candidate"), F.col("b.score").alias("score"))
