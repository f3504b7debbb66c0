"""Result tables over predictions, and what models rely on, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import permutation as P
from ..operators import reports as R
from ..sources import checkpoints as K
from ..sources import tables as T
from .evaluation import _AUC
from .tables import SCORED, read, scored, scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: Predictions of two models over three iterations, by arithmetic on the texts' lengths.
_RUNS = """preds AS (SELECT model, iteration, fold, y_true, ((n * (iteration + 3 + 4 * m)) % 101)::DOUBLE / 100.0::DOUBLE AS y_pred
 FROM (SELECT s.*, n_chars AS n FROM scored s JOIN documents USING (doc_id)), (SELECT unnest(range(3))::INT AS iteration), (VALUES ('a', 0), ('b', 1)) t(model, m))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scored(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    many = base.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(1))))
    y_pred = ((F.col("n_chars") * (F.col("iteration") + 3 + 4 * F.col("m"))) % 101).cast("double") / F.lit(100.0)
    return many.select(F.when(F.col("m") == 0, "a").otherwise("b").alias("model"), "iteration", "fold", "y_true", y_pred.alias("y_pred"))


_CELL = "model, iteration, fold"
_PRECISION = f"""(SELECT {_CELL}, sum(dp / p * tp / (tp + fp)) AS average_precision FROM (SELECT {_CELL}, dp, sum(dp) OVER w AS tp, sum(dn) OVER w AS fp, sum(dp) OVER (PARTITION BY {_CELL}) AS p
 FROM (SELECT {_CELL}, y_pred, sum(y_true)::DOUBLE AS dp, sum(1 - y_true)::DOUBLE AS dn FROM preds GROUP BY ALL) WINDOW w AS (PARTITION BY {_CELL} ORDER BY y_pred DESC)) GROUP BY ALL)"""
_COUNTS = f"""(SELECT {_CELL}, count(*) AS n, count(*) FILTER (y_pred < 0.5 AND y_true = 0) AS tn, count(*) FILTER (y_pred >= 0.5 AND y_true = 0) AS fp,
 count(*) FILTER (y_pred < 0.5 AND y_true = 1) AS fn, count(*) FILTER (y_pred >= 0.5 AND y_true = 1) AS tp FROM preds GROUP BY ALL)"""
_FOLDS = f"""folds AS (SELECT {_CELL}, auc, average_precision, (tp + tn)::DOUBLE / n AS accuracy, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1, tn::DOUBLE AS tn, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tp::DOUBLE AS tp,
 100.0::DOUBLE * tn / n AS tn_percent, 100.0::DOUBLE * fp / n AS fp_percent, 100.0::DOUBLE * fn / n AS fn_percent, 100.0::DOUBLE * tp / n AS tp_percent
 FROM {_AUC.format(by=_CELL, rows='preds')} JOIN {_PRECISION} USING ({_CELL}) JOIN {_COUNTS} USING ({_CELL}))"""
_WITH = f"WITH {SCORED}, {_RUNS}, {_FOLDS}"


def _rounded(df: DataFrame, names) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("SELECT count(quality) AS n, sum(quality)::BIGINT AS positives, round(avg(quality), 6) AS share FROM labels")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.class_balance(read(spark, sf_dir, "labels"), "quality"), ["share"])


def _unpivoted(names, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {_CELL}, '{n}' AS metric, {n} AS value FROM {source}" for n in names)


@query(f"{_WITH} SELECT {_CELL}, metric, round(value, 6) AS value FROM ({_unpivoted(R.METRICS, 'folds')})")
def detailed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.detailed(predictions(spark, sf_dir), ["model"]), ["value"])


_SPREAD = "SELECT model, metric, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS low, max(v) AS high FROM (SELECT model, metric, iteration, avg(value) AS v FROM ({long}) GROUP BY ALL) GROUP BY ALL"
_FIGURES = (*R.METRICS, *R.CELLS, *[f"{c}_percent" for c in R.CELLS])


@query(f"{_WITH} SELECT model, metric, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS low, round(high, 6) AS high FROM ({_SPREAD.format(long=_unpivoted(_FIGURES, 'folds'))})")
def comprehensive_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.comprehensive(predictions(spark, sf_dir), ["model"]), ["mean", "std", "low", "high"])


@query(f"{_WITH} SELECT model, metric, round(mean, 6) AS mean, round(std, 6) AS std FROM ({_SPREAD.format(long=_unpivoted(_FIGURES[4:], 'folds'))})")
def confusion_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts, and percents of a fold, averaged over folds and iterations."""
    return _rounded(R.confusion_summary(predictions(spark, sf_dir), ["model"]), ["mean", "std"])


_WIDE = ", ".join(f"round(max({w}) FILTER (metric = '{m}'), 6) AS {m}_{w}" for m in R.METRICS for w in ("mean", "std"))


@query(f"{_WITH} SELECT model, row_number() OVER (ORDER BY auc_mean DESC, model)::INT AS place, * EXCLUDE (model) FROM (SELECT model, {_WIDE} FROM ({_SPREAD.format(long=_unpivoted(R.METRICS, 'folds'))}) GROUP BY model)")
def summary_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each model, the best first; place says where it stands."""
    best = Window.orderBy(F.desc("auc_mean"), "model")  # a row for each model
    table = R.summary(predictions(spark, sf_dir), ["model"]).withColumn("place", F.row_number().over(best))
    return _rounded(table, [f"{m}_{w}" for m in R.METRICS for w in ("mean", "std")])


_COEFS = "(SELECT p_type AS feature_name, (p_partkey % 21 - 10)::DOUBLE / 100.0::DOUBLE AS c FROM part)"


@query(f"SELECT feature_name, round(importance, 6) AS importance, round(frequency, 6) AS frequency FROM (SELECT feature_name, avg(abs(c)) AS importance, avg((abs(c) > 0.05)::INT::DOUBLE) AS frequency FROM {_COEFS} GROUP BY 1) ORDER BY round(frequency, 9) DESC, round(importance, 9) DESC, feature_name LIMIT 5")
def most_selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    coefs = read(spark, sf_dir, "part").select(F.col("p_type").alias("feature_name"), ((F.col("p_partkey") % 21 - 10).cast("double") / F.lit(100.0)).alias("coef"))
    return _rounded(R.most_selected(coefs).select("feature_name", "importance", "frequency"), ["importance", "frequency"])


@query(f"""WITH {SCORED}, {_RUNS}, best AS (SELECT iteration, fold, model FROM (SELECT *, row_number() OVER (PARTITION BY iteration, fold ORDER BY round(auc, 9) DESC, model) AS rn FROM {_AUC.format(by=_CELL, rows='preds')}) WHERE rn = 1)
SELECT model, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM best), 6) AS percent FROM best GROUP BY 1""")
def chosen_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each model is the best of its fold."""
    area = M.auc(predictions(spark, sf_dir), ["model", "iteration", "fold"])
    best = area.groupBy("iteration", "fold").agg(F.min(F.struct((-F.round("auc", 9)).alias("less"), "model")).alias("b")).select("iteration", "fold", "b.model")
    return _rounded(R.chosen(best, ["model"]), ["percent"])


@query(f"{_WITH} SELECT * FROM preds")
def prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written once, and taken from the store the second time."""
    store = K.Checkpoints(spark, scratch(spark, "predictions"))
    P.stored(store, "predictions", lambda: predictions(spark, sf_dir))
    return P.stored(store, "predictions", lambda: predictions(spark, sf_dir).limit(0))


@query(f"{_WITH} SELECT model, metric, round(mean, 6) AS mean FROM ({_SPREAD.format(long=_unpivoted(R.METRICS, 'folds'))})")
def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table written as CSV with header, and read back."""
    path = scratch(spark, "results")
    T.write_results(R.comprehensive(predictions(spark, sf_dir), ["model"]).filter(F.col("metric").isin(*R.METRICS)), path)
    return T.read_csv(spark, path).select("model", "metric", F.round("mean", 6).alias("mean"))
