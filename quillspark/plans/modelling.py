"""Model queries. They are beyond SQL and are tested against plain numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decompose as D
from ..operators import metrics as M
from ..operators import nested as V
from ..operators import reports as R
from ..sources import checkpoints as K
from .tables import read


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = (F.col("label") < 5).cast("int").alias("y")
    parts = [F.when((F.col("vec_id") + i) % 17 != 0, F.col("embedding")[i].cast("double")).alias(f"e{i}") for i in range(64)]
    return rows.select("vec_id", label, *parts)


_VARIANTS = {"5": [f"e{i}" for i in range(5)], "ALL": [f"e{i}" for i in range(64)]}


def nested_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = {"lr": {"C": [0.1, 1.0], "penalty": ["l1", "l2"]}, "random_features": {"features": [30], "alpha": [1.0]}}
    pred = V.nested_cv(_matrix(spark, sf_dir), "vec_id", "y", _VARIANTS, grids, 2, 3, 2)
    return M.auc(pred, ["iteration", "fold", "model", "variant"])


def lr_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nested_cv(_matrix(spark, sf_dir), "vec_id", "y", {"ALL": _VARIANTS["ALL"]}, {"lr": {"C": [1.0]}}, 1, 3, 2).select("sample_idx", "fold", "y_true", "y_pred")


def random_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nested_cv(_matrix(spark, sf_dir), "vec_id", "y", {"ALL": _VARIANTS["ALL"]}, {"random_features": {"features": [50]}}, 1, 3, 2).select("sample_idx", "fold", "y_true", "y_pred")


def svd_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nested_cv(_matrix(spark, sf_dir), "vec_id", "y", {"ALL": _VARIANTS["ALL"]}, {"lr": {"C": [1.0]}}, 1, 3, 2, imputer="svd").select("sample_idx", "fold", "y_true", "y_pred")


def mice_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells filled by chained regressions, a scan for each column and round."""
    return V.nested_cv(_matrix(spark, sf_dir), "vec_id", "y", {"5": _VARIANTS["5"]}, {"lr": {"C": [1.0]}}, 1, 3, 2, imputer="mice").select("sample_idx", "fold", "y_true", "y_pred")


def model_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chosen models rely on, the most important first: coefficients, or shares of the trees' gain."""
    grids = {"lr": {"C": [0.1, 1.0], "penalty": ["l1"]}, "forest": {"trees": [10]}, "boosting": {"trees": [10]}, "svm": {"C": [0.1]}}
    fits = V.nested_fits(_matrix(spark, sf_dir), "vec_id", "y", {"ALL": _VARIANTS["ALL"]}, grids, 1, 3, 2)
    return R.importances(V.weights(fits))


def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many folds each model and variant of two embeddings was chosen; one candidate can't be fitted."""
    grids = {"lr": {"C": [1.0], "penalty": ["l2"]}, "knn": {"k": [5, 0], "weights": ["distance"]}, "svm": {"C": [0.1]}, "rbf_svm": {"C": [1.0], "features": [64]}}
    return R.chosen(V.nested_cv(_matrix(spark, sf_dir), "vec_id", "y", _VARIANTS, grids, 2, 3, 2), ["model", "variant"])


def svd_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.vector_embeddings(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


def svd_embed_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are decomposed only if they are longer than the table."""
    return K.reduced_if_wide(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", D.vector_embeddings)


QUERIES = {f.__name__: f for f in (nested_cv, lr_predict, random_features, svd_impute, mice_impute, svd_embed, svd_embed_wide, model_weights, model_selection)}
