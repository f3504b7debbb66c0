"""Result tables over predictions: by fold, by iteration, by model, and what the models rely on.

Predictions have iteration, fold, y_true, y_pred and the columns ``by`` that name what
is compared, such as model and variant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as M

METRICS = ("auc", "average_precision", "accuracy", "f1")
CELLS = ("tn", "fp", "fn", "tp")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """(n, positives, share): rows with a label, those of label 1, and their share."""
    return df.agg(F.count(label).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.avg(F.col(label).cast("double")).alias("share"))


def by_fold(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row a fold: the metrics, the confusion counts and these in percent of the fold's rows."""
    cell = [*by, "iteration", "fold"]
    whole = sum((F.col(c) for c in CELLS), F.lit(0))
    counts = M.confusion(pred, cell).withColumns({f"{c}_percent": 100.0 * F.col(c) / whole for c in CELLS})
    return M.auc(pred, cell).join(M.average_precision(pred, cell), cell).join(counts, cell)


def detailed(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, iteration, fold, metric, value) of every fold."""
    return _long(by_fold(pred, by), [*by, "iteration", "fold"], METRICS)


def _long(wide: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
    return wide.select(*keys, pairs.alias("p")).select(*keys, "p.metric", "p.value")


def summary(pred: DataFrame, by: Sequence[str], primary: str = "auc") -> DataFrame:
    """One row for each of ``by``: mean and deviation of each metric, the best mean of ``primary`` first."""
    stats = M.summarise(detailed(pred, by), by)
    wide = stats.groupBy(*by).pivot("metric", list(METRICS)).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    return wide.orderBy(F.desc(f"{primary}_mean"), *by)


def confusion_summary(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, mean, std): confusion counts, and percents of a fold, averaged over folds and iterations."""
    names = [*CELLS, *[f"{c}_percent" for c in CELLS]]
    return M.summarise(_long(by_fold(pred, by), [*by, "iteration", "fold"], names), by)


def comprehensive(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, metric, mean, std, low, high): all metrics and confusion figures with their range over iterations."""
    names = [*METRICS, *CELLS, *[f"{c}_percent" for c in CELLS]]
    inner = _long(by_fold(pred, by), [*by, "iteration", "fold"], names).groupBy(*by, "metric", "iteration").agg(F.avg("value").alias("v"))
    return inner.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))


def chosen(pred: DataFrame, what: Sequence[str]) -> DataFrame:
    """(what, n, percent): in how many folds each candidate was chosen, the most frequent first."""
    folds = pred.select("iteration", "fold", *what).distinct()
    counts = folds.groupBy(*what).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row for each candidate
    return counts.withColumn("percent", 100.0 * F.col("n") / total).orderBy(F.desc("n"), *what)


def importances(coefs: DataFrame, least: float = 0.05) -> DataFrame:
    """(feature_name, importance, importance_std, frequency) over fits, the most important first."""
    return M.selection_frequency(coefs, least).orderBy(F.desc("importance"), "feature_name")


def most_selected(coefs: DataFrame, size: int = 5, least: float = 0.05) -> DataFrame:
    """The ``size`` features selected most often, ties by importance and name."""
    return M.selection_frequency(coefs, least).orderBy(F.desc("frequency"), F.desc("importance"), "feature_name").limit(size)
