"""Imputers and models of one matrix, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class MeanImputer:
    def fit(self, x: np.ndarray) -> MeanImputer:
        self.fill = np.nan_to_num(np.nanmean(np.where(np.isfinite(x), x, np.nan), axis=0)) if len(x) else np.zeros(x.shape[1])
        return self

    def transform(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), self.fill, x)


class MedianImputer(MeanImputer):
    def fit(self, x: np.ndarray) -> MedianImputer:
        self.fill = np.nan_to_num(np.nanmedian(x, axis=0))
        return self


class SVDImputer(MeanImputer):
    """Missing cells from a truncated decomposition, repeated until they hardly change."""

    def __init__(self, components: int = 3, rounds: int = 500, tolerance: float = 1e-4):
        self.components, self.rounds, self.tolerance = components, rounds, tolerance

    def transform(self, x: np.ndarray) -> np.ndarray:
        gone, out = np.isnan(x), super().transform(x)
        for _ in range(self.rounds if gone.any() else 0):
            u, s, v = np.linalg.svd(out, full_matrices=False)
            k = min(self.components, len(s))
            new = ((u[:, :k] * s[:k]) @ v[:k])[gone]
            change = np.linalg.norm(new - out[gone])
            out[gone] = new
            if change < self.tolerance:
                break
        return out


class IterativeImputer(MeanImputer):
    """Each incomplete column is regressed on the others, in turn, a few rounds.

    The regression is a ridge of given strength, or one whose strength follows from
    the data (``bayesian``); ``nearest`` keeps the columns that correlate most.
    """

    def __init__(self, rounds: int = 5, ridge: float = 1e-3, bayesian: bool = False, nearest: int | None = None):
        self.rounds, self.ridge, self.bayesian, self.nearest = rounds, ridge, bayesian, nearest

    def _others(self, full: np.ndarray, j: int) -> np.ndarray:
        others = np.delete(np.arange(full.shape[1]), j)
        if self.nearest is None or self.nearest >= len(others):
            return others
        centred = full - full.mean(axis=0)
        scale = np.sqrt((centred**2).sum(axis=0))
        near = np.abs(centred[:, others].T @ centred[:, j]) / np.where(scale[others] > 0, scale[others], np.inf)
        return np.sort(others[np.argsort(-near, kind="stable")[: self.nearest]])

    def _weights(self, a: np.ndarray, y: np.ndarray) -> np.ndarray:
        gram, moment = a.T @ a, a.T @ y
        if not self.bayesian:
            return np.linalg.solve(gram + self.ridge * np.eye(a.shape[1]), moment)
        value, vector = np.linalg.eigh(gram)
        value, noise, prior = np.maximum(value, 0), 1.0 / max(y.var(), 1e-12), 1.0
        for _ in range(30):
            w = vector @ ((noise / (prior + noise * value)) * (vector.T @ moment))
            known = (noise * value / (prior + noise * value)).sum()
            before = prior, noise
            prior = known / max(w @ w, 1e-12)
            noise = max(len(y) - known, 1e-9) / max(((y - a @ w) ** 2).sum(), 1e-12)
            if np.allclose(before, (prior, noise), rtol=1e-4):
                break
        return w

    def fit(self, x: np.ndarray) -> IterativeImputer:
        super().fit(x)
        gone, full = np.isnan(x), super().transform(x)
        self.steps: list[tuple[int, np.ndarray, np.ndarray]] = []
        columns = np.flatnonzero(gone.any(axis=0) & ~gone.all(axis=0))
        others = {j: self._others(full, j) for j in columns}
        for _ in range(self.rounds):
            for j in columns:
                known = ~gone[:, j]
                a = np.c_[full[:, others[j]], np.ones(len(full))]
                w = self._weights(a[known], full[known, j])
                full[gone[:, j], j] = a[gone[:, j]] @ w
                self.steps.append((int(j), others[j], w))
        return self

    def transform(self, x: np.ndarray) -> np.ndarray:
        gone, full = np.isnan(x), super().transform(x)
        for j, others, w in self.steps:
            full[gone[:, j], j] = np.c_[full[:, others], np.ones(len(full))][gone[:, j]] @ w
        return full


class KNNImputer(MeanImputer):
    """Mean of the k nearest training rows that know the cell, by distance over the cells both know."""

    def __init__(self, k: int = 5):
        self.k = k

    def fit(self, x: np.ndarray) -> KNNImputer:
        super().fit(x)
        self.x = x
        return self

    def transform(self, x: np.ndarray) -> np.ndarray:
        out = super().transform(x)
        for i in np.flatnonzero(np.isnan(x).any(axis=1)):
            both = ~np.isnan(self.x) & ~np.isnan(x[i])
            share = both.sum(axis=1)
            d = np.where(both, self.x - x[i], 0.0)
            d = np.where(share > 0, (d**2).sum(axis=1) * x.shape[1] / np.maximum(share, 1), np.inf)
            for j in np.flatnonzero(np.isnan(x[i])):
                known = np.flatnonzero(~np.isnan(self.x[:, j]) & np.isfinite(d))
                if len(known):
                    out[i, j] = self.x[known[np.argsort(d[known], kind="stable")[: self.k]], j].mean()
        return out


class LogisticRegression:
    """Proximal gradient steps on the mean log loss with an l1 or l2 penalty 1 / (C n); the bias is free."""

    def __init__(self, C: float = 1.0, penalty: str = "l2", steps: int = 300):  # noqa: N803
        self.C, self.penalty, self.steps = C, penalty, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> LogisticRegression:
        n = len(x)
        a = np.c_[x, np.ones(n)]
        reg = 1.0 / (self.C * n)
        rate = 1.0 / (0.25 * np.linalg.norm(a, 2) ** 2 / n + (reg if self.penalty == "l2" else 0.0) + 1e-12)
        w = np.zeros(a.shape[1])
        look, t = w.copy(), 1.0
        for _ in range(self.steps):
            g = a.T @ (sigmoid(a @ look) - y) / n
            if self.penalty == "l2":
                g[:-1] += reg * look[:-1]
            new = look - rate * g
            if self.penalty == "l1":
                new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * reg, 0)
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            look, w, t = new + (t - 1) / t_new * (new - w), new, t_new
        self.coef, self.bias = w[:-1], w[-1]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.coef + self.bias)


class RandomFeatures:
    """Unit random directions, rectified, then ridge on labels of -1 and 1; scores by a sigmoid."""

    def __init__(self, features: int = 100, alpha: float = 1.0, seed: int = 0):
        self.features, self.alpha, self.seed = features, alpha, seed

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.w)

    def fit(self, x: np.ndarray, y: np.ndarray) -> RandomFeatures:
        w = np.random.default_rng(self.seed).standard_normal((x.shape[1], self.features))
        self.w = w / np.linalg.norm(w, axis=0)
        h = self._hidden(x)
        self.mean = h.mean(axis=0)
        t = 2.0 * y - 1
        self.bias = t.mean()
        c = h - self.mean
        self.coef = np.linalg.solve(c.T @ c + self.alpha * np.eye(self.features), c.T @ (t - self.bias))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((self._hidden(x) - self.mean) @ self.coef + self.bias)


class KNNClassifier:
    def __init__(self, k: int = 5, weights: str = "uniform", metric: str = "euclidean"):
        self.k, self.weights, self.metric = k, weights, metric

    def fit(self, x: np.ndarray, y: np.ndarray) -> KNNClassifier:
        self.x, self.y = x, y
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for i, row in enumerate(x):
            d = np.abs(self.x - row).sum(axis=1) if self.metric == "manhattan" else np.sqrt(((self.x - row) ** 2).sum(axis=1))
            near = np.argsort(d, kind="stable")[: self.k]
            w = np.ones(len(near)) if self.weights == "uniform" else (1 / d[near] if (d[near] > 0).all() else (d[near] == 0).astype(float))
            out[i] = (w * self.y[near]).sum() / w.sum()
        return out


class Tree:
    """A regression tree: each split lowers the squared error most, among some of the columns."""

    def __init__(self, depth: int = 6, leaf: int = 2, columns: int | None = None, rng: np.random.Generator | None = None):
        self.depth, self.leaf, self.columns, self.rng = depth, leaf, columns, rng or np.random.default_rng(0)

    def fit(self, x: np.ndarray, y: np.ndarray, of=np.mean) -> Tree:
        """``of`` makes a leaf's value from the numbers of its rows' targets."""
        self.gain, self.nodes = np.zeros(x.shape[1]), []
        self._grow(x, y, np.arange(len(x)), 0, of)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, of) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0, float(of(y[rows]))))
        best = self._split(x[rows], y[rows]) if depth < self.depth and len(rows) >= 2 * self.leaf else None
        if best:
            gain, j, cut = best
            self.gain[j] += gain
            low = x[rows, j] <= cut
            left, right = self._grow(x, y, rows[low], depth + 1, of), self._grow(x, y, rows[~low], depth + 1, of)
            self.nodes[at] = (j, cut, left, right, self.nodes[at][4])
        return at

    def _split(self, x: np.ndarray, y: np.ndarray) -> tuple[float, int, float] | None:
        n, best = len(y), None
        picked = np.arange(x.shape[1]) if self.columns is None else np.sort(self.rng.choice(x.shape[1], min(self.columns, x.shape[1]), replace=False))
        for j in picked.tolist():
            order = np.argsort(x[:, j], kind="stable")
            v, total = x[order, j], np.cumsum(y[order])
            k = np.arange(1, n)
            ok = (v[1:] > v[:-1]) & (k >= self.leaf) & (n - k >= self.leaf)
            if not ok.any():
                continue
            gain = np.where(ok, total[:-1] ** 2 / k + (total[-1] - total[:-1]) ** 2 / (n - k), -np.inf) - total[-1] ** 2 / n
            i = int(gain.argmax())
            if gain[i] > 1e-12 and (best is None or gain[i] > best[0]):
                best = float(gain[i]), j, float((v[i] + v[i + 1]) / 2)
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.empty(len(x)), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            j, cut, left, right, value = self.nodes[at]
            if j < 0:
                out[rows] = value
            elif len(rows):
                low = x[rows, j] <= cut
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


class RandomForest:
    """Trees on rows drawn with repetition, each split among the root of the number of columns."""

    def __init__(self, trees: int = 50, depth: int = 6, seed: int = 0):
        self.trees, self.depth, self.seed = trees, depth, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> RandomForest:
        rng = np.random.default_rng(self.seed)
        columns = max(1, int(np.sqrt(x.shape[1])))
        self.grown = []
        for _ in range(self.trees):
            rows = rng.integers(0, len(x), len(x))
            self.grown.append(Tree(self.depth, columns=columns, rng=rng).fit(x[rows], y[rows].astype(float)))
        return self

    @property
    def importance(self) -> np.ndarray:
        gain = np.sum([t.gain for t in self.grown], axis=0)
        return gain / max(gain.sum(), 1e-12)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.grown], axis=0)


class GradientBoosting:
    """Small trees one after another, each a step on the log loss of those before."""

    def __init__(self, trees: int = 50, depth: int = 3, rate: float = 0.1):
        self.trees, self.depth, self.rate = trees, depth, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> GradientBoosting:
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(p / (1 - p)))
        z, self.grown = np.full(len(y), self.start), []
        for _ in range(self.trees):
            left = y - sigmoid(z)
            # Newton's step of a leaf: of labels 0 and 1 the curvature is |r| (1 - |r|).
            tree = Tree(self.depth).fit(x, left, lambda r: r.sum() / max((np.abs(r) * (1 - np.abs(r))).sum(), 1e-9))
            z = z + self.rate * tree.predict(x)
            self.grown.append(tree)
        return self

    importance = RandomForest.importance

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.start + self.rate * np.sum([t.predict(x) for t in self.grown], axis=0))


class LinearSVM:
    """Squared hinge loss with an l2 penalty, by accelerated gradient steps; scores by a sigmoid of the margin."""

    def __init__(self, C: float = 1.0, steps: int = 300):  # noqa: N803
        self.C, self.steps = C, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> LinearSVM:
        a, t = np.c_[x, np.ones(len(x))], 2.0 * y - 1
        free = np.r_[np.ones(x.shape[1]), 0.0]
        rate = 1.0 / (1.0 + 2 * self.C * np.linalg.norm(a, 2) ** 2)
        w, look, k = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0
        for _ in range(self.steps):
            short = np.maximum(0, 1 - t * (a @ look))
            new = look - rate * (free * look - 2 * self.C * (a.T @ (t * short)))
            after = (1 + np.sqrt(1 + 4 * k * k)) / 2
            look, w, k = new + (k - 1) / after * (new - w), new, after
        self.coef, self.bias = w[:-1], w[-1]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.coef + self.bias)


IMPUTERS = {"mean": MeanImputer, "median": MedianImputer, "svd": SVDImputer, "mice": IterativeImputer, "knn": KNNImputer}
MODELS = {"lr": LogisticRegression, "random_features": RandomFeatures, "knn": KNNClassifier, "forest": RandomForest, "boosting": GradientBoosting, "svm": LinearSVM}


def importance_of(model) -> np.ndarray | None:
    """A fitted model's weight of each column: coefficients, or shares of the gain; None if it has neither."""
    if isinstance(model, RandomFeatures):
        return None
    return getattr(model, "coef", getattr(model, "importance", None))


def rank_auc(y: np.ndarray, s: np.ndarray) -> float:
    """Area under the ROC curve, ties at average rank; NaN without both classes."""
    order = np.sort(s)
    rank = (np.searchsorted(order, s, "left") + np.searchsorted(order, s, "right") + 1) / 2
    pos, neg = (y == 1).sum(), (y == 0).sum()
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)) if pos and neg else float("nan")
