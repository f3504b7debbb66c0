"""Fold, imputation, metric and neighbour queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds as K
from ..operators import metrics as M
from ..operators import permutation as P
from ..operators import vectors as V
from .tables import SCORED, read, scored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {SCORED} SELECT doc_id, y_true, fold FROM scored")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "y_true", "fold")


@query("""SELECT doc_id, quality, repeat, ((row_number() OVER (PARTITION BY repeat, quality ORDER BY md5(doc_id::VARCHAR || '-' || repeat::VARCHAR), doc_id) - 1) % 5)::INT AS fold
FROM labels, (SELECT unnest(range(3))::INT AS repeat)""")
def repeated_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.repeated(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", 5, 3)


@query(f"""WITH {SCORED}, grid AS (SELECT doc_id, y_pred, fold, test_fold FROM scored, (SELECT unnest(range(3))::INT AS test_fold)),
stats AS (SELECT test_fold, avg(y_pred) AS m, stddev_pop(y_pred) AS d FROM grid WHERE fold <> test_fold GROUP BY 1)
SELECT doc_id, test_fold, round((y_pred - m) / d, 6) AS scaled FROM grid JOIN stats USING (test_fold)""")
def fold_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.standardise(scored(spark, sf_dir), "y_pred", 3).select("doc_id", "test_fold", F.round("scaled", 6).alias("scaled"))


_GAPS = "(SELECT event_id, event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events)"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))


@query(f"SELECT event_id, round(coalesce(value, avg(value) OVER (PARTITION BY event_type)), 6) AS value FROM {_GAPS}")
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.impute(_gaps(spark, sf_dir), ["value"], "mean", ["event_type"]).select("event_id", F.round("value", 6).alias("value"))


@query(f"SELECT event_id, round(coalesce(value, m), 6) AS value FROM {_GAPS}, (SELECT median(value) AS m FROM {_GAPS})")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.impute(_gaps(spark, sf_dir), ["value"], "median").select("event_id", F.round("value", 6).alias("value"))


_AUC = """(SELECT {by}, (sum(CASE WHEN y_true = 1 THEN r END) - sum(y_true) * (sum(y_true) + 1) / 2.0::DOUBLE) / (sum(y_true) * sum(1 - y_true)) AS auc
 FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY y_pred) + (count(*) OVER (PARTITION BY {by}, y_pred) - 1) / 2.0::DOUBLE AS r FROM {rows}) GROUP BY {by})"""


@query(f"WITH {SCORED} SELECT fold, round(auc, 6) AS auc FROM {_AUC.format(by='fold', rows='scored')}")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auc(scored(spark, sf_dir), ["fold"]).select("fold", F.round("auc", 6).alias("auc"))


_CURVE = """curve AS (SELECT fold, y_pred, dp, dn, sum(dp) OVER w AS tp, sum(dn) OVER w AS fp, sum(dp) OVER (PARTITION BY fold) AS p, sum(dn) OVER (PARTITION BY fold) AS n
 FROM (SELECT fold, y_pred, sum(y_true)::DOUBLE AS dp, sum(1 - y_true)::DOUBLE AS dn FROM scored GROUP BY 1, 2) WINDOW w AS (PARTITION BY fold ORDER BY y_pred DESC))"""


@query(f"WITH {SCORED}, {_CURVE} SELECT fold, round(sum(dp / p * tp / (tp + fp)), 6) AS average_precision FROM curve GROUP BY 1")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.average_precision(scored(spark, sf_dir), ["fold"]).select("fold", F.round("average_precision", 6).alias("average_precision"))


@query(f"WITH {SCORED}, {_CURVE} SELECT fold, y_pred, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM curve")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.roc_points(scored(spark, sf_dir), ["fold"]).select("fold", "y_pred", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"WITH {SCORED} SELECT fold, round(auc, 6) AS roc_auc FROM {_AUC.format(by='fold', rows='scored')}")
def roc_auc_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.trapezoid_auc(scored(spark, sf_dir), ["fold"]).select("fold", F.round("roc_auc", 6).alias("roc_auc"))


@query(f"""WITH {SCORED}, {_CURVE}, pts AS (SELECT fold, fpr, max(tpr) AS tpr FROM (SELECT fold, fp / n AS fpr, tp / p AS tpr FROM curve UNION ALL SELECT DISTINCT fold, 0, 0 FROM scored) GROUP BY 1, 2),
grid AS (SELECT fold, i, i / 99.0::DOUBLE AS x FROM (SELECT unnest(range(100)) AS i), (SELECT DISTINCT fold FROM scored)),
around AS (SELECT g.fold, g.i, g.x, max(fpr) FILTER (fpr <= x) AS f0, max(tpr) FILTER (fpr <= x) AS t0, min(fpr) FILTER (fpr > x) AS f1, min(tpr) FILTER (fpr > x) AS t1 FROM grid g JOIN pts USING (fold) GROUP BY 1, 2, 3),
v AS (SELECT i, x, CASE WHEN i = 0 THEN 0 WHEN i = 99 THEN 1 WHEN f1 IS NULL OR x = f0 THEN t0 ELSE t0 + (x - f0) * (t1 - t0) / (f1 - f0) END AS v FROM around)
SELECT round(x, 6) AS fpr, round(avg(v), 5) AS tpr, round(stddev_pop(v), 5) AS tpr_std FROM v GROUP BY x""")
def mean_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mean_roc(scored(spark, sf_dir), ["fold"]).select(F.round("fpr", 6).alias("fpr"), F.round("tpr", 5).alias("tpr"), F.round("tpr_std", 5).alias("tpr_std"))


_CONFUSION = """(SELECT fold, count(*) FILTER (y_pred < 0.5 AND y_true = 0) AS tn, count(*) FILTER (y_pred >= 0.5 AND y_true = 0) AS fp,
 count(*) FILTER (y_pred < 0.5 AND y_true = 1) AS fn, count(*) FILTER (y_pred >= 0.5 AND y_true = 1) AS tp FROM scored GROUP BY 1)"""


@query(f"WITH {SCORED} SELECT fold, tn, fp, fn, tp, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM {_CONFUSION}")
def f1_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(scored(spark, sf_dir), ["fold"]).withColumn("accuracy", F.round("accuracy", 6)).withColumn("f1", F.round("f1", 6))


@query(f"""WITH {SCORED}, swept AS (SELECT fold, k, sum(y_true) FILTER (y_pred >= t) AS tp, sum(1 - y_true) FILTER (y_pred >= t) AS fp, sum(y_true) AS p
 FROM scored, (SELECT k, round(0.1::DOUBLE + k * 0.05::DOUBLE, 6) AS t FROM (SELECT unnest(range(17)) AS k)) GROUP BY 1, 2),
f AS (SELECT fold, k, 2.0::DOUBLE * tp / (tp + fp + p) AS f1 FROM swept)
SELECT fold, round(0.1::DOUBLE + k * 0.05::DOUBLE, 6) AS threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, k) AS rn FROM f) WHERE rn = 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_sweep(scored(spark, sf_dir), ["fold"]).withColumn("f1", F.round("f1", 6))


_RUNS = "runs AS (SELECT doc_id, y_true, fold, it, ((n * (it + 3)) % 101)::DOUBLE / 100.0::DOUBLE AS y_pred FROM (SELECT s.*, n_chars AS n FROM scored s JOIN documents USING (doc_id)), (SELECT unnest(range(4))::INT AS it))"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scored(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    many = base.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return many.select("doc_id", "y_true", "fold", "it", (((F.col("n_chars") * (F.col("it") + 3)) % 101).cast("double") / F.lit(100.0)).alias("y_pred"))


@query(f"WITH {SCORED}, {_RUNS}, a AS (SELECT it, avg(auc) AS v FROM (SELECT * FROM {_AUC.format(by='it, fold', rows='runs')}) GROUP BY 1) SELECT 'auc' AS metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM a")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = M.auc(_runs(spark, sf_dir), ["it", "fold"]).select(F.col("it").alias("iteration"), F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    return M.summarise(long, []).select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {SCORED}, {_RUNS}, s AS (SELECT fold, it AS candidate, round(auc, 9) AS score FROM {_AUC.format(by='it, fold', rows='runs')}) SELECT fold, candidate, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, candidate) AS rn FROM s) WHERE rn = 1")
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = M.auc(_runs(spark, sf_dir), ["it", "fold"]).select("fold", F.col("it").alias("candidate"), F.round("auc", 9).alias("score"))
    return M.best_variant(scores, ["fold"]).withColumn("score", F.round("score", 6))


@query("""SELECT p_type AS feature_name, round(avg(abs(c)), 6) AS importance, round(stddev_pop(abs(c)), 6) AS importance_std, round(avg((abs(c) > 0.05)::INT::DOUBLE), 6) AS frequency
FROM (SELECT p_type, (p_partkey % 21 - 10)::DOUBLE / 100.0::DOUBLE AS c FROM part) GROUP BY 1""")
def selection_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    coefs = read(spark, sf_dir, "part").select(F.col("p_type").alias("feature_name"), ((F.col("p_partkey") % 21 - 10).cast("double") / F.lit(100.0)).alias("coef"))
    return M.selection_frequency(coefs).select("feature_name", *[F.round(c, 6).alias(c) for c in ("importance", "importance_std", "frequency")])


@query("SELECT p_type AS winner, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM part), 6) AS percent FROM part GROUP BY 1 ORDER BY n DESC, winner LIMIT 5")
def top_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    total = part.agg(F.count("*").alias("total"))
    counts = part.groupBy(F.col("p_type").alias("winner")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    return counts.select("winner", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 6).alias("percent")).orderBy(F.desc("n"), "winner").limit(5)


@query("SELECT vec_id, (unnest(range(len(t))))::INT AS pos, unnest(t) AS value FROM (SELECT vec_id, embedding[1:5] AS t FROM embeddings)")
def embedding_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.trimmed(F.col("embedding"), 5)).alias("pos", "value"))


_KNN = """SELECT q, v, label, d, rank FROM (SELECT a.vec_id AS q, b.vec_id AS v, b.label, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id)::INT AS rank
 FROM embeddings a, embeddings b WHERE {asked}b.vec_id <> a.vec_id) WHERE rank <= 5"""


@query(f"SELECT q, v, round(d, 6) AS d, rank FROM ({_KNN.format(asked='')})")
def knn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's neighbours among all others."""
    rows = read(spark, sf_dir, "embeddings")
    return V.nearest(rows, rows, "vec_id", "embedding", 5).select("q", "v", F.round("d", 6).alias("d"), "rank")


@query(f"SELECT q, label AS vote FROM (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, label) AS rn FROM ({_KNN.format(asked='a.vec_id % 10 = 0 AND ')}) GROUP BY q, label) WHERE rn = 1")
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return V.vote(V.nearest(rows.filter("vec_id % 10 = 0"), rows, "vec_id", "embedding", 5, keep=["label"]), "label")


_B = 20
_MODELS = "m AS (SELECT doc_id, y_true, fold, y_pred AS s1, ((y_pred * 100)::INT * 37 % 101)::DOUBLE / 100.0::DOUBLE AS s2 FROM scored)"


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "y_true", "fold", F.col("y_pred").alias("s1"), ((F.round(F.col("y_pred") * 100).cast("int") * 37 % 101).cast("double") / F.lit(100.0)).alias("s2"))


@query(f"""WITH {SCORED}, {_MODELS}, r1 AS (SELECT *, s1 AS y_pred FROM m), r2 AS (SELECT *, s2 AS y_pred FROM m)
SELECT a.fold, round(b.auc - a.auc, 6) AS difference FROM {_AUC.format(by='fold', rows='r1')} a JOIN {_AUC.format(by='fold', rows='r2')} b USING (fold)""")
def cell_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.differences(_two(spark, sf_dir), ["fold"]).select("fold", F.round("difference", 6).alias("difference"))


_WORD = 1 << 64


def _mixed(x: str, shift: int, factor: int) -> str:
    """A step of the hash in SQL, modulo 2 to the 64."""
    return f"((xor({x}, {x} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {_WORD}::UHUGEINT)::UBIGINT"


_START = f"((doc_id::UHUGEINT * {P.FACTORS[0]}::UHUGEINT + b::UHUGEINT * {P.FACTORS[1]}::UHUGEINT + fold::UHUGEINT * {P.FACTORS[2]}::UHUGEINT) % {_WORD}::UHUGEINT)::UBIGINT"
_SWAP = f"""drawn AS (SELECT *, (xor(z, z >> 31) >> 63) = 1 AND b > 0 AS sw FROM (SELECT *, {_mixed('y', *P.FINAL[1])} AS z FROM (SELECT *, {_mixed('x', *P.FINAL[0])} AS y FROM (SELECT *, {_START} AS x FROM m, b))))"""


@query(f"""WITH {SCORED}, {_MODELS}, b AS (SELECT unnest(range({_B + 1}))::INT AS b), {_SWAP},
r1 AS (SELECT *, CASE WHEN sw THEN s2 ELSE s1 END AS y_pred FROM drawn), r2 AS (SELECT *, CASE WHEN sw THEN s1 ELSE s2 END AS y_pred FROM drawn),
delta AS (SELECT b, round(avg(y.auc - x.auc), 9) AS d FROM {_AUC.format(by='b, fold', rows='r1')} x JOIN {_AUC.format(by='b, fold', rows='r2')} y USING (b, fold) GROUP BY 1)
SELECT round(observed, 6) AS observed, (1.0::DOUBLE + count(*) FILTER (d >= observed)) / ({_B} + 1) AS p_value, round(avg(d), 6) AS null_mean, round(stddev_pop(d), 6) AS null_std,
 round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM delta, (SELECT d AS observed FROM delta WHERE b = 0) WHERE b > 0 GROUP BY observed""")
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.test(_two(spark, sf_dir), "doc_id", ["fold"], _B)
    return found.select(*[F.round(c, 6).alias(c) if c != "p_value" else F.col(c) for c in found.columns])


def permutation_test_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test with the 10,000 permutations that it is meant for; the SQL above has fewer."""
    return P.test(_two(spark, sf_dir), "doc_id", ["fold"])


QUERIES["permutation_test_full"] = permutation_test_full
