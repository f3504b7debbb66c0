"""Nested cross-validation by scans against plain numpy."""

import inspect

import numpy as np
import pytest

from quillspark.operators import fits, models, nested, scans
from quillspark.operators.scans import Split

COLUMNS = [f"c{j}" for j in range(5)]
FINALS = [Split(i, f) for i in range(2) for f in range(3)]
SPLITS = FINALS + [Split(i, f, k) for i, f, _ in FINALS for k in range(2)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((160, 5)) * [1, 10, 0.1, 1, 1] + [0, 1000, 0, 0, 0]
    y = (x[:, 0] - (x[:, 1] - 1000) / 10 + 0.7 * rng.standard_normal(160) > 0).astype(int)
    x[rng.random(x.shape) < 0.1] = np.nan
    return x, y


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y = data
    rows = [(i, int(c), *[None if np.isnan(v) else float(v) for v in r]) for i, (c, r) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "id long, y int, " + ", ".join(f"{c} double" for c in COLUMNS)).repartition(4)


@pytest.fixture(scope="module")
def rows(frame):
    return nested.design(frame, "id", "y", COLUMNS, 2, 3, 2, 7)


@pytest.fixture(scope="module")
def member(rows):
    """The training rows of each split, by id."""
    found = rows.orderBy("sample_idx").collect()
    outer, inner = np.array([r.outer for r in found]), np.array([r.inner for r in found])

    def of(s):
        out = outer[:, s.iteration] != s.fold
        return out if s.part < 0 else out & (inner[:, s.iteration * 3 + s.fold] != s.part)

    return {s: of(s) for s in SPLITS}


def test_folds_are_stratified(data, member):
    y = data[1]
    for f in FINALS:
        assert abs((~member[f] & (y == 1)).sum() - (y == 1).sum() / 3) < 1 and abs((~member[f] & (y == 0)).sum() - (y == 0).sum() / 3) < 1
        parts = [member[f] & ~member[Split(*f[:2], k)] for k in range(2)]
        assert not (parts[0] & parts[1]).any() and (parts[0] | parts[1]).tolist() == member[f].tolist()
        assert abs((parts[0] & (y == 1)).sum() - (parts[1] & (y == 1)).sum()) <= 1
    assert any((member[Split(0, f)] != member[Split(1, f)]).any() for f in range(3))


@pytest.mark.parametrize(("imputer", "middle"), [("mean", np.nanmean), ("median", np.nanmedian)])
def test_scales_equal_numpy(spark, data, rows, member, imputer, middle):
    x, y = data
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, False)  # values lie in several tasks
    got = nested.prepared(rows, SPLITS, 3, 5, imputer)
    spark.conf.unset(key)
    for s in SPLITS:
        own = x[member[s]]
        fill = middle(own, axis=0)
        full = np.where(np.isnan(own), fill, own)
        assert np.allclose(got[s].fill, fill) and np.allclose(got[s].mean, full.mean(axis=0)) and np.allclose(got[s].deviation, full.std(axis=0), rtol=1e-6)
        assert (got[s].rows, got[s].positive) == (len(own), y[member[s]].sum())


def made(rows, scales, name, splits, bins=None, seed=3, **params):
    out = [fits.MODELS[name](s, 3, np.arange(5), scales[s], seed, bins, params) for s in splits]
    nested.fitted(rows, out)
    return out


PLAIN = {
    "l2": ("lr", {"C": 0.5, "penalty": "l2"}, lambda: models.LogisticRegression(0.5, "l2", 30_000)),
    "l1": ("lr", {"C": 0.1, "penalty": "l1"}, lambda: models.LogisticRegression(0.1, "l1", 30_000)),
    "svm": ("svm", {"C": 0.3}, lambda: models.LinearSVM(0.3, 30_000)),
    "random_features": ("random_features", {"features": 20, "alpha": 2.0}, lambda: models.RandomFeatures(20, 2.0, 3)),
}


@pytest.mark.parametrize("kind", PLAIN)
def test_fits_equal_those_of_a_matrix(data, rows, member, kind):
    x, y = data
    scales = nested.prepared(rows, SPLITS, 3, 5, "mean")
    name, params, plain = PLAIN[kind]
    for f in made(rows, scales, name, SPLITS[5:8], **params):
        own, scale = member[f.split], scales[f.split]
        want = plain().fit(scale.apply(x[own]), y[own])
        assert np.allclose(f.model().predict(x), want.predict(scale.apply(x)), atol=1e-5)
        if kind == "l1":
            assert ((np.abs(f.importance()) < 1e-7) == (np.abs(want.coef) < 1e-7)).all() and (np.abs(want.coef) < 1e-7).any()


def check_tree(tree, bins, target, weight, curve=None, depth=3, leaf=2):
    """Every node has a split of the best gain, or none is allowed, and the value of its rows."""
    total = 0.0

    def best(rows):
        found = 0.0
        for j in range(bins.shape[1]):
            for cut in np.unique(bins[rows, j])[:-1]:
                low, high = rows[bins[rows, j] <= cut], rows[bins[rows, j] > cut]
                n, m = weight[low].sum(), weight[high].sum()
                if n >= leaf and m >= leaf:
                    parts = [(weight[r] * target[r]).sum() for r in (low, high)]
                    found = max(found, parts[0] ** 2 / n + parts[1] ** 2 / m - sum(parts) ** 2 / (n + m))
        return found

    def walk(node, rows, level):
        nonlocal total
        s, n = (weight[rows] * target[rows]).sum(), weight[rows].sum()
        assert abs(tree.value[node] - (s / n if curve is None else s / (weight[rows] * curve[rows]).sum())) < 1e-9
        gain = best(rows) if level < depth and n >= 2 * leaf else 0.0
        if tree.column[node] < 0:
            assert gain < 1e-9
            return
        low = bins[rows, tree.column[node]] <= tree.cut[node]
        parts = [(weight[r] * target[r]).sum() ** 2 / weight[r].sum() for r in (rows[low], rows[~low])]
        assert abs(sum(parts) - s**2 / n - gain) < 1e-9
        total += gain
        walk(tree.left[node], rows[low], level + 1)
        walk(tree.right[node], rows[~low], level + 1)

    walk(0, np.flatnonzero(weight > 0), 0)
    return total


def test_trees_split_best(data, rows, member, monkeypatch):
    x, y = data
    monkeypatch.setattr(fits, "BINS", 16)
    scales, bins = nested.prepared(rows, SPLITS, 3, 5, "median"), fits.cuts(rows, 5)
    assert all(0 < len(b) < 16 for b in bins)
    for f in made(rows, scales, "boosting", FINALS[:2], bins, trees=4, depth=3, rate=0.3):
        own, gain = f.binned.of(x), 0.0
        z = np.full(len(x), np.log(y[member[f.split]].mean() / (1 - y[member[f.split]].mean())))
        for tree in f.grown:
            r = y - models.sigmoid(z)
            gain += check_tree(tree, own, r, member[f.split].astype(float), np.abs(r) * (1 - np.abs(r)))
            z = z + 0.3 * tree.predict(own)
        assert len(f.grown) == 4 and np.allclose(f.model().predict(x), models.sigmoid(z)) and abs(f.gain.sum() - gain) < 1e-9
    monkeypatch.setattr(fits.Forest, "tried", lambda self, number, node: np.arange(5))
    numbers = np.array([r.row for r in rows.orderBy("sample_idx").collect()])
    f = made(rows, scales, "forest", FINALS[:1], bins, trees=3, depth=4)[0]
    for i, tree in enumerate(f.grown):
        check_tree(tree, f.binned.of(x), y, member[f.split] * fits.drawn(numbers, f.draw(i)), depth=4)
    assert np.allclose(f.model().predict(x), np.mean([t.predict(f.binned.of(x)) for t in f.grown], axis=0))


def test_a_tree_equals_that_of_binned_columns():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((160, 5))
    y = (x[:, 0] + 0.7 * rng.standard_normal(160) > 0).astype(int)
    scale, borders = fits.Scale(np.zeros(5), np.zeros(5), np.ones(5), 160, int(y.sum())), [np.quantile(x[:, j], np.arange(1, 16) / 16) for j in range(5)]
    f = fits.Boosting(Split(0, 0), 3, np.arange(5), scale, 3, borders, {"trees": 2, "depth": 3, "rate": 0.3})
    batch = scans.Batch(np.arange(160), y, x, np.full((160, 1), 1), np.zeros((160, 3)))
    while (asked := f.request()) is not None:
        total = np.zeros(asked.size)
        asked.add(total, batch)
        f.take(total)
    own = f.binned.of(x).astype(float)
    plain = models.GradientBoosting(2, 3, 0.3).fit(own, y)
    assert np.allclose(f.model().predict(x), plain.predict(own)) and np.allclose(f.importance(), plain.importance)


def test_rows_are_drawn_about_once():
    n = fits.drawn(np.arange(200_000), 5)
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02 and (n != fits.drawn(np.arange(200_000), 6)).any()


def test_a_kernel_machine_learns_a_circle(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 2))
    y = ((x**2).sum(axis=1) < 1.4).astype(int)
    df = spark.createDataFrame([(i, int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(y, x, strict=True))], "id long, y int, a double, b double")
    pred = nested.nested_cv(df, "id", "y", {"ALL": ["a", "b"]}, {"rbf_svm": {"C": [10.0]}, "svm": {"C": [10.0]}}, 1, 2, 2).collect()
    assert {r.model for r in pred} == {"rbf_svm"}
    assert models.rank_auc(np.array([r.y_true for r in pred]), np.array([r.y_pred for r in pred])) > 0.97
    # Products of the waves against the kernel that they stand for.
    scale = fits.Scale(np.zeros(2), np.zeros(2), np.ones(2), 400)
    waves = fits.KernelMachine(Split(0, 0), 2, np.arange(2), scale, 1, None, {"features": 4096, "gamma": 0.5}).projection(x)
    exact = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(waves @ waves.T - exact).mean() < 0.02


def test_directions_fill_cells_as_a_whole_decomposition_does(spark):
    rng = np.random.default_rng(6)
    whole = rng.standard_normal((150, 3)) @ rng.standard_normal((3, 6)) + 0.01 * rng.standard_normal((150, 6))
    x = whole.copy()
    x[rng.random(x.shape) < 0.08] = np.nan
    df = spark.createDataFrame([(i, i % 2, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, y int, " + ", ".join(f"d{j} double" for j in range(6)))
    rows = nested.design(df, "id", "y", [f"d{j}" for j in range(6)], 1, 2, 2, 5)
    s = Split(0, 0)
    got = fits.completed(rows, nested.prepared(rows, [s], 2, 6, "mean"), 2, np.arange(6), tolerance=1e-7)[s]
    own = np.array([r.outer[0] != 0 for r in rows.orderBy("sample_idx").collect()])
    want = models.SVDImputer(3, 20_000, 1e-9).fit(x[own]).transform(x[own])
    assert np.allclose(got.filled(x[own]), want, atol=1e-3)
    assert np.abs(got.filled(x) - whole)[np.isnan(x)].mean() < 0.05
    assert np.allclose(got.mean, got.filled(x[own]).mean(axis=0)) and np.allclose(got.deviation, got.filled(x[own]).std(axis=0), atol=1e-4)


@pytest.mark.parametrize("how", [{}, {"bayesian": True}, {"nearest": 2}])
def test_chained_regressions_equal_those_of_a_matrix(data, rows, member, how):
    x = data[0]
    got = fits.chained(rows, nested.prepared(rows, SPLITS[5:7], 3, 5, "mean"), 3, np.arange(5), rounds=2, **how)
    for s in SPLITS[5:7]:
        plain = models.IterativeImputer(rounds=2, **how).fit(x[member[s]])
        want = plain.transform(x)
        assert np.allclose(got[s].filled(x), want, rtol=1e-5, atol=1e-6)
        assert np.allclose(got[s].mean, want[member[s]].mean(axis=0)) and np.allclose(got[s].deviation, want[member[s]].std(axis=0), rtol=1e-4)


def test_areas_over_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(f), int(y), float(s)) for f in range(3) for y, s in zip(rng.integers(0, 2, 500), rng.integers(0, 40, 500), strict=True)] + [(3, 1, 0.5), (3, 1, 0.7)]
    df = spark.createDataFrame(rows, "fit int, y_true int, y_pred double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    got = nested.areas(df)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for f in range(3):
        own = np.array([r[1:] for r in rows if r[0] == f])
        assert abs(got[f] - models.rank_auc(own[:, 0], own[:, 1])) < 1e-12
    assert np.isnan(got[3])


def test_the_best_mean_area_wins(data, frame, rows, member):
    x, y = data
    grids = {"lr": {"C": [0.01, 1.0], "penalty": ["l1"]}, "knn": {"k": [0, 7], "weights": ["distance"], "metric": ["manhattan"]}}
    variants = {"A": COLUMNS, "B": ["c3", "c4"]}
    got = nested.nested_fits(frame, "id", "y", variants, grids, 1, 3, 2, imputer="mean", seed=7).collect()
    scales = nested.prepared(rows, SPLITS, 3, 5, "mean")
    place = {v: [COLUMNS.index(c) for c in cs] for v, cs in variants.items()}

    def predict(m, p, v, s, rows_):
        scale = scales[s].of(np.array(place[v]))
        a, own = scale.apply(x[:, place[v]]), member[s]
        plain = models.LogisticRegression(p["C"], p["penalty"], 5_000) if m == "lr" else models.KNNClassifier(7, "distance", "manhattan")
        return plain.fit(a[own], y[own]).predict(a[rows_])

    candidates = [("lr", v, {"C": c, "penalty": p}) for v in variants for c in (0.01, 1.0) for p in ("l1",)] + [("knn", v, {}) for v in variants]
    for final in FINALS[:3]:  # the folds of one iteration are those of the first of two
        best = -1.0
        for m, v, p in candidates:
            parts = [member[final] & ~member[Split(*final[:2], k)] for k in range(2)]
            area = np.mean([models.rank_auc(y[part], predict(m, p, v, Split(*final[:2], k), part)) for k, part in enumerate(parts)])
            if area > best + 1e-9:
                best, chosen = area, (m, v, p)
        own = [r for r in got if (r.iteration, r.fold) == final[:2] and r.feature_name is None]
        assert {(r.model, r.variant) for r in own} == {chosen[:2]} and abs(own[0].inner_score - best) < 1e-6
        assert sorted(r.sample_idx for r in own) == np.flatnonzero(~member[final]).tolist()
        assert np.allclose([r.y_pred for r in sorted(own, key=lambda r: r.sample_idx)], predict(*(chosen[0], chosen[2], chosen[1]), final, ~member[final]), atol=1e-5)
        named = [r.feature_name for r in got if (r.iteration, r.fold) == final[:2] and r.feature_name]
        assert named == (variants[chosen[1]] if chosen[0] == "lr" else [])


def test_no_matrix_reaches_the_driver():
    for module in (nested, scans, fits):
        assert "toPandas" not in inspect.getsource(module) and "MAX_CELLS" not in inspect.getsource(module)


def test_requests_over_the_bound_take_more_scans(rows, monkeypatch):
    asked = [scans.Centre(5)] * 4
    whole = scans.totals(rows, asked)
    monkeypatch.setattr(scans, "SCAN_BYTES", 100)
    assert all(np.array_equal(a, b) for a, b in zip(whole, scans.totals(rows, asked), strict=True))


def test_what_cannot_be_fitted(frame):
    for grids in ({"knn": {"k": [0]}}, {"lr": {"C": [-1.0]}}):
        with pytest.raises(ValueError, match="no candidate"):
            nested.nested_cv(frame, "id", "y", {"A": COLUMNS}, grids, 1, 2, 2)
    with pytest.raises(ValueError, match="imputer"):
        nested.nested_cv(frame, "id", "y", {"A": COLUMNS}, {"lr": {"C": [1.0]}}, 1, 2, 2, imputer="nothing")
