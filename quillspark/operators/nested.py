"""Nested cross-validation over any number of rows: no matrix leaves its tasks.

Every candidate of every split is a fit that advances by sums over all rows
(``scans``): Newton steps by gradients and Gram matrices for logistic regression and
the linear and kernel machines, one pass of moments for random features, histograms of
the nodes of a level for trees. All fits advance in the same scans. Candidates are
judged by exact areas over scores that are sorted across tasks. What the driver holds
are the sums and the models, whose size doesn't depend on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import held
from . import fits, numbers, scans, vectors
from .folds import derived_seed
from .scans import Split

FITS = "iteration int, fold int, model string, variant string, params string, inner_score double, sample_idx long, y_true int, y_pred double, feature_name string, coef double"


def design(df: DataFrame, key: str, label: str, columns: Sequence[str], iterations: int, outer: int, inner: int, seed: int) -> DataFrame:
    """A held table of row, y, x, outer, inner and sample_idx, the key; rows are dealt to folds by label.

    In each iteration, the rows of a label are dealt in turn in the order of a hash,
    and those outside an outer fold anew to inner ones.
    """
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])
    rows = held(df.select(F.monotonically_increasing_id().alias("row"), F.col(label).cast("int").alias("y"), values.alias("x"), F.col(key).cast("long").alias("sample_idx")), "design-rows")

    def dealt(named: DataFrame, by: list[str], role: str, folds: int) -> DataFrame:
        order = F.md5(F.concat_ws("-", F.lit(f"{seed}-{role}"), *by[:-1], F.col("sample_idx").cast("string")))
        numbered = numbers.by_hash(named, by, order, ["sample_idx", "row"], "n")
        return numbered.withColumn("n", ((F.col("n") - 1) % folds).cast("int"))

    each = rows.select("row", "y", "sample_idx", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("it"))
    outside = held(dealt(each, ["it", "y"], "outer", outer), "design-outer")
    others = outside.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).filter("fold <> n").drop("n")
    inside = dealt(others, ["it", "fold", "y"], "inner", inner).select("row", (F.col("it") * outer + F.col("fold")).alias("place"), "n")
    both = outside.select("row", (F.col("it") - iterations).alias("place"), "n").union(inside)
    # A fold for each iteration, then one for each iteration and other outer fold.
    by_row = both.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("m"))
    picked = {"outer": (-iterations, -1), "inner": (0, iterations * outer - 1)}
    arrays = [F.transform(F.sequence(F.lit(a), F.lit(b)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(-1))).alias(name) for name, (a, b) in picked.items()]
    return held(rows.join(by_row.select("row", *arrays), "row").select("row", "y", "x", "outer", "inner", "sample_idx"), "design")


def prepared(rows: DataFrame, splits: Sequence[Split], folds: int, columns: int, imputer: str) -> dict[Split, fits.Scale]:
    """What fills and scales the columns in each split, by its training rows alone: mean or median, mean and population deviation."""
    known, total = scans.totals(rows, [scans.Centre(columns)])[0].reshape(2, columns)
    centre = total / np.maximum(known, 1)
    found = scans.totals(rows, [scans.Spread(tuple(splits), folds, centre)])[0]
    n, positive = found[-2 * len(splits) :].reshape(2, -1)
    count, off, square = found[: -2 * len(splits)].reshape(3, len(splits), columns)
    fill = centre + off / np.maximum(count, 1)
    fill = np.where(count > 0, fill, 0.0)
    holes = np.flatnonzero((count < n[:, None]).any(axis=0))
    if imputer == "median" and len(holes):
        fill[:, holes] = np.nan_to_num(scans.medians(rows, splits, folds, holes.tolist()))
    # With the missing cells at their fill.
    gone = n[:, None] - count
    mean_off = (off + gone * (fill - centre)) / np.maximum(n[:, None], 1)
    spread = (square + gone * (fill - centre) ** 2) / np.maximum(n[:, None], 1) - mean_off**2
    scale = np.sqrt(np.maximum(spread, 0.0))
    scale[scale <= 1e-12 * np.maximum(np.abs(centre), 1.0)] = 1.0
    return {s: fits.Scale(fill[i], centre + mean_off[i], scale[i], int(n[i]), int(positive[i]), count[i]) for i, s in enumerate(splits)}


def fitted(rows: DataFrame, made: Sequence[fits.Fit]) -> None:
    """Advances all fits to their end; those that fail say so."""
    while True:
        asking = [(f, r) for f in made if not f.failed and (r := f.request()) is not None]
        if not asking:
            return
        for (f, _), total in zip(asking, scans.totals(rows, [r for _, r in asking]), strict=True):
            f.take(total)


def scores(rows: DataFrame, made: Sequence[fits.Fit], folds: int) -> DataFrame:
    """(fit, row, sample_idx, y_true, y_pred) of the rows that each fit is judged by; fit is its place."""
    able = [(i, f.model()) for i, f in enumerate(made) if not f.failed and not isinstance(f, fits.Neighbours)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(5).to_numpy()
            for batch in scans.batches_of([b]):
                for i, model in able:
                    own = np.flatnonzero(batch.judged(model.split, folds))
                    if len(own):
                        p = model.predict(batch.x[own])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), pa.array(batch.row[own]), pa.array(keys[own]), pa.array(batch.y[own]), pa.array(p)], ["fit", "row", "sample_idx", "y_true", "y_pred"])

    out = rows.mapInArrow(run, "fit int, row long, sample_idx long, y_true int, y_pred double")
    voting = {i: f for i, f in enumerate(made) if isinstance(f, fits.Neighbours) and not f.failed}
    return out.union(_neighbours(rows, voting, folds)) if voting else out


def _neighbours(rows: DataFrame, made: Mapping[int, fits.Neighbours], folds: int) -> DataFrame:
    """(fit, row, sample_idx, y_true, y_pred): the votes of the training rows nearest to each judged row, in the split's scale.

    Packs of all rows meet each other once, and serve all fits then; a row is looked at
    by each fit that it is judged by, and emitted with its k nearest of a part of the rows.
    """
    n = rows.count()
    parts = vectors.parts_of(n, n)
    cells = rows.select("row", "y", "x", "outer", "inner", "sample_idx")
    schema = "fit int, row long, sample_idx long, y_true int, near array<struct<d double, v long, y int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, dict[int, tuple[vectors.Nearest, np.ndarray, np.ndarray]]] = {}
        last, training = None, {}
        for b in batches:
            for rn, r, qn, q in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
                if rn != last:
                    last, training = rn, {}
                    for batch in scans.batches_of(iter([vectors.opened(r)])):
                        for i, f in made.items():
                            own = batch.training(f.split, folds)
                            training[i] = f.inputs.of(batch.x[own]), batch.row[own], batch.y[own].astype(np.int64)
                if qn not in asked:
                    asked[qn], pack = {}, vectors.opened(q)
                    for batch in scans.batches_of(iter([pack])):
                        for i, f in made.items():
                            own = np.flatnonzero(batch.judged(f.split, folds))
                            near = vectors.Nearest(f.inputs.of(batch.x[own]), batch.row[own], f.k, f.metric)
                            asked[qn][i] = near, pack.column(5).to_numpy()[own], batch.y[own]
                for i, (near, *_) in asked[qn].items():
                    near.meet(*training[i])
        for found in asked.values():
            for i, (near, key, y) in found.items():
                at = near.found()
                n = np.bincount(at[0], minlength=len(key))
                values = pa.StructArray.from_arrays([pa.array(near.d[at]), pa.array(near.v[at]), pa.array(near.carried[at], pa.int32())], ["d", "v", "y"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), values)
                out = pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32)), pa.array(near.queries), pa.array(key), pa.array(y), lists], ["fit", "row", "sample_idx", "y_true", "near"])
                yield out.filter(pa.array(n > 0))

    found = vectors.meetings(cells, cells, parts).mapInArrow(run, schema)
    if parts[1] > 1:
        k = F.element_at(F.create_map(*[F.lit(v) for i, f in made.items() for v in (i, f.k)]), F.col("fit"))
        found = found.groupBy("fit", "row", "sample_idx", "y_true").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near")).withColumn("near", F.slice("near", F.lit(1), k))
    by_distance = F.col("fit").isin([i for i, f in made.items() if f.weights == "distance"])
    zero = F.get("near", F.lit(0))["d"] == 0  # where a neighbour is at no distance, only such ones vote
    votes = F.transform("near", lambda e: F.struct(e["y"].alias("y"), F.when(~by_distance, 1.0).when(zero, (e["d"] == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), e["d"])).alias("w")))
    won, of = (F.aggregate(F.transform("votes", part), F.lit(0.0), lambda a, b: a + b) for part in (lambda e: e["w"] * e["y"], lambda e: e["w"]))
    return found.withColumn("votes", votes).select("fit", "row", "sample_idx", "y_true", (won / of).alias("y_pred"))


def areas(pred: DataFrame) -> dict[int, float]:
    """The exact area under the ROC curve of each fit (fit, y_true, y_pred), ties at half; NaN without both classes.

    Scores are counted, sorted across tasks by fit and score, and summed there; from
    each task's counts, one row a fit in it, follows what lies below.
    """
    counts = pred.groupBy("fit", "y_pred").agg(F.sum("y_true").alias("p"), F.sum(1 - F.col("y_true")).alias("n"))
    dealt = counts.repartitionByRange("fit", "y_pred").sortWithinPartitions("fit", "y_pred")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = TaskContext.get().partitionId(), {}
        for b in batches:
            fit, p, n = (b.column(i).to_numpy() for i in (0, 2, 3))
            for i in np.unique(fit).tolist():
                own = fit == i
                before = sums.get(i, (0, 0, 0.0))
                below = before[1] + np.cumsum(n[own]) - n[own]
                sums[i] = before[0] + int(p[own].sum()), before[1] + int(n[own].sum()), before[2] + float((p[own] * (below + n[own] / 2)).sum())
        for i, (p, n, won) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i], pa.int32()), pa.array([p], pa.int64()), pa.array([n], pa.int64()), pa.array([won])], ["part", "fit", "p", "n", "won"])

    found: dict[int, tuple[int, int, float]] = {}
    for r in dealt.mapInArrow(run, "part int, fit int, p long, n long, won double").orderBy("part", "fit").collect():
        p, n, won = found.get(r["fit"], (0, 0, 0.0))
        found[r["fit"]] = p + r["p"], n + r["n"], won + r["won"] + r["p"] * n
    return {i: won / (p * n) if p and n else float("nan") for i, (p, n, won) in found.items()}


def nested_fits(df: DataFrame, key: str, label: str, variants: Mapping[str, Sequence[str]], grids: Mapping[str, Mapping[str, Sequence]], iterations: int, outer: int, inner: int, imputer: str = "median", seed: int = 2048) -> DataFrame:
    """Rows of predictions (sample_idx, y_true, y_pred) and of weights (feature_name, coef) by nested cross-validation.

    ``variants`` names sets of numeric columns, ``grids`` the models and their
    parameters; ``imputer`` is mean, median, svd, mice or mice_bayesian. In each iteration and outer fold the candidate of the best mean inner
    area wins, the first on ties; one that can't be fitted counts as the worst. It is
    fitted again on all rows outside the fold, whose rows it then predicts.
    """
    spark = df.sparkSession
    columns = list(dict.fromkeys(c for cols in variants.values() for c in cols))
    place = {v: np.array([columns.index(c) for c in cols]) for v, cols in variants.items()}
    candidates = [(m, v, dict(zip(g, p, strict=True))) for m, g in grids.items() for v in variants for p in product(*g.values())]
    rows = design(df, key, label, columns, iterations, outer, inner, seed)
    finals = [Split(i, f) for i in range(iterations) for f in range(outer)]
    splits = finals + [Split(i, f, k) for i, f, _ in finals for k in range(inner)]
    plain = prepared(rows, splits, outer, len(columns), "median" if imputer == "median" else "mean")
    if imputer == "svd":
        scales = {v: fits.completed(rows, plain, outer, place[v]) for v in variants}
    elif imputer in ("mice", "mice_bayesian"):
        scales = {v: fits.chained(rows, plain, outer, place[v], bayesian=imputer == "mice_bayesian") for v in variants}
    elif imputer in ("mean", "median"):
        scales = dict.fromkeys(variants, plain)
    else:
        raise ValueError(f"not an imputer of nested cross-validation: {imputer}")
    bins = fits.cuts(rows, len(columns)) if any(m in fits.BINNED for m, _, _ in candidates) else None

    def make(split: Split, cand: tuple) -> fits.Fit:
        m, v, p = cand
        own = derived_seed(seed, split.iteration, split.fold, "model")
        return fits.MODELS[m](split, outer, place[v], scales[v][split], own, bins, p)

    tried = [(split, c) for split in splits[len(finals) :] for c in range(len(candidates))]
    made = [make(split, candidates[c]) for split, c in tried]
    score = dict.fromkeys(product(finals, range(len(candidates))), -2.0)
    fitted(rows, made)
    found = areas(scores(rows, made, outer))
    for final, c in score:
        own = [(found.get(i, float("nan")), made[i].failed) for i, (s, k) in enumerate(tried) if k == c and s[:2] == final[:2]]
        known = [a for a, _ in own if not np.isnan(a)]
        score[final, c] = -2.0 if any(bad for _, bad in own) else float(np.mean(known)) if known else -1.0
    chosen = {final: max(range(len(candidates)), key=lambda c: (score[final, c], -c)) for final in finals}
    last = [make(final, candidates[chosen[final]]) for final in finals]
    fitted(rows, last)
    if any(f.failed for f in last):
        raise ValueError("no candidate can be fitted")
    names = [(i, s.iteration, s.fold, candidates[chosen[s]][0], candidates[chosen[s]][1], str(sorted(candidates[chosen[s]][2].items())), score[s, chosen[s]]) for i, s in enumerate(finals)]
    # A row for each iteration and fold.
    about = F.broadcast(spark.createDataFrame(names, "fit int, iteration int, fold int, model string, variant string, params string, inner_score double"))
    pred = scores(rows, last, outer).join(about, "fit").withColumns({"feature_name": F.lit(None).cast("string"), "coef": F.lit(float("nan"))})
    weighed = [(i, c, float(w)) for i, s in enumerate(finals) if not last[i].failed and (ws := last[i].importance()) is not None for c, w in zip(variants[candidates[chosen[s]][1]], ws, strict=True)]
    weights_ = spark.createDataFrame(weighed, "fit int, feature_name string, coef double").join(about, "fit")
    weights_ = weights_.withColumns({"sample_idx": F.lit(None).cast("long"), "y_true": F.lit(None).cast("int"), "y_pred": F.lit(float("nan"))})
    wanted = [c.split()[0] for c in FITS.split(", ")]
    return pred.select(*wanted).union(weights_.select(*wanted))


def predictions(found: DataFrame) -> DataFrame:
    """(iteration, fold, model, variant, params, sample_idx, y_true, y_pred) of ``nested_fits``."""
    return found.filter("feature_name IS NULL").drop("feature_name", "coef", "inner_score")


def weights(found: DataFrame) -> DataFrame:
    """(iteration, fold, model, variant, feature_name, coef) of ``nested_fits``."""
    return found.filter("feature_name IS NOT NULL").select("iteration", "fold", "model", "variant", "feature_name", "coef")


def nested_cv(df: DataFrame, key: str, label: str, variants: Mapping[str, Sequence[str]], grids: Mapping[str, Mapping[str, Sequence]], iterations: int, outer: int, inner: int, imputer: str = "median", seed: int = 2048) -> DataFrame:
    """The predictions alone."""
    return predictions(nested_fits(df, key, label, variants, grids, iterations, outer, inner, imputer, seed))
