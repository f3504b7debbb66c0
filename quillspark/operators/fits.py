"""Models that are fitted by sums over all rows: each fit asks for one, takes it, and asks for the next.

``request`` gives what a fit needs next from its training rows (``scans.Request``), or
None once it is done, ``take`` receives the total, ``model`` predicts. A fit that can't
go on is ``failed``. What a fit holds depends on the columns, never on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scans
from .folds import derived_seed
from .models import sigmoid
from .scans import Batch, Split

#: Bins of a column that trees split at, at most; the sketch's accuracy for their borders.
BINS, ACCURACY = 64, 10_000
#: Scans of Newton steps at most, and the step that ends them.
ROUNDS, TOLERANCE = 60, 1e-9


@dataclass(frozen=True)
class Scale:
    """What fills missing cells and scales columns, and the training rows and positive ones it was made from, and how many of the rows know each column."""

    fill: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    rows: int
    positive: int = 0
    known: np.ndarray | None = None

    def of(self, columns: np.ndarray) -> Scale:
        known = None if self.known is None else self.known[columns]
        return replace(self, fill=self.fill[columns], mean=self.mean[columns], deviation=self.deviation[columns], known=known)

    def filled(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), self.fill, x)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.filled(x) - self.mean) / self.deviation


@dataclass(frozen=True)
class Completed(Scale):
    """Missing cells from the known ones of their row, by few directions that the training rows follow."""

    directions: np.ndarray | None = None

    def of(self, columns: np.ndarray) -> Completed:
        return self  # made of a variant's own columns

    def filled(self, x: np.ndarray) -> np.ndarray:
        if self.directions is None:
            return super().filled(x)
        known, k = ~np.isnan(x), self.directions.shape[1]
        products = (self.directions[:, :, None] * self.directions[:, None, :]).reshape(len(x.T), k * k)
        gram = (known.astype(float) @ products).reshape(-1, k, k) + 1e-9 * np.eye(k)
        weights = np.linalg.solve(gram, (np.where(known, x, 0.0) @ self.directions)[:, :, None])[:, :, 0]
        return np.where(known, x, np.where(known.any(axis=1)[:, None], weights @ self.directions.T, self.fill))


@dataclass(frozen=True)
class Products:
    """Sums of the filled columns of a split's training rows, and of their products."""

    split: Split
    folds: int
    columns: np.ndarray
    scale: Scale

    @property
    def size(self) -> int:
        return len(self.columns) * (len(self.columns) + 1)

    def add(self, total: np.ndarray, batch: Batch) -> None:
        x = self.scale.filled(batch.x[batch.training(self.split, self.folds)][:, self.columns])
        p = len(self.columns)
        total[:p] += x.sum(axis=0)
        total[p:] += (x.T @ x).ravel()


def completed(rows: DataFrame, scales: dict[Split, Scale], folds: int, columns: np.ndarray, components: int = 3, rounds: int = 500, tolerance: float = 1e-4) -> dict[Split, Completed]:
    """Scales that fill cells by the main directions of the filled rows, which are found again until they hardly turn.

    What a row's missing cells should be follows from its known ones and the
    directions alone, so a round is one scan, for all splits; nothing is kept by row.
    """
    found = {s: Completed(**vars(scale.of(columns))) for s, scale in scales.items()}
    moving = list(found)
    for _ in range(rounds + 1):
        sums = scans.totals(rows, [Products(s, folds, columns, found[s]) for s in moving])
        still = []
        for s, total in zip(moving, sums, strict=True):
            p, n, old = len(columns), max(found[s].rows, 1), found[s].directions
            mean, gram = total[:p] / n, total[p:].reshape(p, p)
            deviation = np.sqrt(np.maximum(np.diag(gram) / n - mean**2, 0.0))
            deviation[deviation <= 1e-9 * np.maximum(np.abs(mean), 1.0)] = 1.0
            new = np.linalg.eigh(gram)[1][:, ::-1][:, : min(components, p)]
            turned = np.inf if old is None else np.linalg.norm(new @ new.T - old @ old.T)
            found[s] = replace(found[s], mean=mean, deviation=deviation, directions=old if turned < tolerance else new)
            if turned >= tolerance:
                still.append(s)
        moving = still
        if not moving:
            break
    return found


@dataclass(frozen=True)
class Chained(Scale):
    """Missing cells by regressions on the other columns, one after another."""

    steps: tuple[tuple[int, np.ndarray, np.ndarray], ...] = ()

    def of(self, columns: np.ndarray) -> Chained:
        return self  # made of a variant's own columns

    def filled(self, x: np.ndarray) -> np.ndarray:
        gone, full = np.isnan(x), super().filled(x)
        for j, others, w in self.steps:
            rows = np.flatnonzero(gone[:, j])
            full[rows, j] = full[rows][:, others] @ w[:-1] + w[-1]
        return full


@dataclass(frozen=True)
class KnownProducts:
    """Products of the filled columns and one more of ones, over a split's training rows that know column ``j``."""

    split: Split
    folds: int
    columns: np.ndarray
    scale: Scale
    j: int

    @property
    def size(self) -> int:
        return (len(self.columns) + 1) ** 2

    def add(self, total: np.ndarray, batch: Batch) -> None:
        x = batch.x[batch.training(self.split, self.folds)][:, self.columns]
        x = x[~np.isnan(x[:, self.j])]
        a = np.c_[self.scale.filled(x), np.ones(len(x))]
        total += (a.T @ a).ravel()


def regressed(products: np.ndarray, j: int, others: np.ndarray, ridge: float, bayesian: bool) -> np.ndarray:
    """Weights of column j on the others and a bias, by a ridge of given strength or of one that follows from the data."""
    at = np.r_[others, len(products) - 1]
    gram, moment, square, n = products[np.ix_(at, at)], products[at, j], products[j, j], products[-1, -1]
    if not bayesian:
        return np.linalg.solve(gram + ridge * np.eye(len(at)), moment)
    value, vector = np.linalg.eigh(gram)
    value, noise, prior = np.maximum(value, 0), 1.0 / max(square / n - (products[-1, j] / n) ** 2, 1e-12), 1.0
    for _ in range(30):
        w = vector @ ((noise / (prior + noise * value)) * (vector.T @ moment))
        known = (noise * value / (prior + noise * value)).sum()
        before = prior, noise
        prior = known / max(w @ w, 1e-12)
        noise = max(n - known, 1e-9) / max(square - 2 * w @ moment + w @ gram @ w, 1e-12)
        if np.allclose(before, (prior, noise), rtol=1e-4):
            break
    return w


def chained(rows: DataFrame, scales: dict[Split, Scale], folds: int, columns: np.ndarray, rounds: int = 5, ridge: float = 1e-3, bayesian: bool = False, nearest: int | None = None) -> dict[Split, Chained]:
    """Scales that fill cells by chained regressions: a few rounds over the columns that lack cells, a scan for each, for all splits at once.

    With ``nearest``, a column is regressed on those alone that correlate most with it
    once missing cells are at their means.
    """
    found = {s: Chained(**vars(scale.of(columns))) for s, scale in scales.items()}
    p = len(columns)
    others = {(s, j): np.delete(np.arange(p), j) for s in found for j in range(p)}
    if nearest is not None and nearest < p - 1:
        for s, total in zip(found, scans.totals(rows, [Products(s, folds, columns, found[s]) for s in found]), strict=True):
            n = max(found[s].rows, 1)
            around = total[p:].reshape(p, p) - np.outer(total[:p], total[:p]) / n
            size = np.sqrt(np.maximum(np.diag(around), 0.0))
            for j in range(p):
                own = others[s, j]
                near = np.abs(around[own, j]) / np.where(size[own] > 0, size[own], np.inf)
                others[s, j] = np.sort(own[np.argsort(-near, kind="stable")[:nearest]])
    for _ in range(rounds):
        for j in range(p):
            open_ = [s for s in found if 0 < found[s].known[j] < found[s].rows]
            for s, total in zip(open_, scans.totals(rows, [KnownProducts(s, folds, columns, found[s], j) for s in open_]), strict=True):
                w = regressed(total.reshape(p + 1, p + 1), j, others[s, j], ridge, bayesian)
                found[s] = replace(found[s], steps=(*found[s].steps, (j, others[s, j], w)))
    for s, total in zip(list(found), scans.totals(rows, [Products(s, folds, columns, found[s]) for s in found]), strict=True):
        n = max(found[s].rows, 1)
        mean = total[:p] / n
        deviation = np.sqrt(np.maximum(np.diag(total[p:].reshape(p, p)) / n - mean**2, 0.0))
        deviation[deviation <= 1e-9 * np.maximum(np.abs(mean), 1.0)] = 1.0
        found[s] = replace(found[s], mean=mean, deviation=deviation)
    return found


@dataclass(frozen=True)
class Projection:
    """Columns made of the scaled ones: rectified ("relu") or waves ("cos") along fixed directions."""

    kind: str
    directions: np.ndarray
    shift: np.ndarray | float = 0.0

    def __call__(self, a: np.ndarray) -> np.ndarray:
        z = a @ self.directions + self.shift
        return np.maximum(z, 0) if self.kind == "relu" else np.sqrt(2 / z.shape[1]) * np.cos(z)


@dataclass(frozen=True)
class Inputs:
    """The columns of a fit, from a batch's rows."""

    split: Split
    folds: int
    columns: np.ndarray
    scale: Scale
    projection: Projection | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        a = self.scale.apply(x[:, self.columns])
        return self.projection(a) if self.projection else a

    def training(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        own = batch.training(self.split, self.folds)
        return self.of(batch.x[own]), batch.y[own]

    @property
    def width(self) -> int:
        return len(self.columns) if self.projection is None else self.projection.directions.shape[1]


@dataclass(frozen=True)
class LinearModel:
    inputs: Inputs
    coef: np.ndarray
    bias: float

    @property
    def split(self) -> Split:
        return self.inputs.split

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.inputs.of(x) @ self.coef + self.bias)


class Fit:
    """What all fits share; one constructed with values that it can't work with has failed."""

    failed = False

    def __init__(self, split: Split, folds: int, columns: np.ndarray, scale: Scale, seed: int, bins: list[np.ndarray] | None, params: dict):
        self.split, self.folds, self.columns, self.scale, self.seed, self.bins = split, folds, columns, scale, seed, bins
        try:
            self.start(**params)
        except ValueError:
            self.failed = True

    def start(self, **params) -> None:
        raise NotImplementedError

    def request(self):
        return None

    def take(self, total: np.ndarray) -> None:
        raise NotImplementedError

    def importance(self) -> np.ndarray | None:
        return None

    @property
    def inputs(self) -> Inputs:
        return Inputs(self.split, self.folds, self.columns, self.scale.of(self.columns))


# -- by gradients and Gram matrices ---------------------------------------------------


@dataclass(frozen=True)
class Slopes:
    """Loss, gradient and curvature at weights, the bias last: of the log loss, or of half the squared hinge."""

    inputs: Inputs
    loss: str
    w: np.ndarray

    @property
    def size(self) -> int:
        q = len(self.w)
        return 1 + q + q * q

    def add(self, total: np.ndarray, batch: Batch) -> None:
        a, y = self.inputs.training(batch)
        a = np.c_[a, np.ones(len(a))]
        z = a @ self.w
        if self.loss == "log":
            p = sigmoid(z)
            value, slope, curve = np.logaddexp(0, z) - y * z, p - y, p * (1 - p)
        else:
            t = 2.0 * y - 1
            short = np.maximum(0, 1 - t * z)
            value, slope, curve = short**2 / 2, -t * short, (short > 0).astype(float)
        q = len(self.w)
        total[0] += value.sum()
        total[1 : 1 + q] += a.T @ slope
        total[1 + q :] += ((a * curve[:, None]).T @ a).ravel()


class _Newton(Fit):
    """Newton steps, proximal ones under an l1 penalty, halved until the objective doesn't rise."""

    loss, projection = "log", None

    def begin(self, weight: float, l1: float, l2: float) -> None:
        """The objective is ``weight`` times the summed loss, and the penalties of all weights but the bias."""
        self.weight, self.l1, self.l2 = weight, l1, l2
        self.inputs_ = replace(self.inputs, projection=self.projection)
        q = self.inputs_.width + 1
        self.free = np.r_[np.ones(q - 1), 0.0]
        self.w, self.good, self.value, self.rounds, self.done = np.zeros(q), None, np.inf, 0, False

    def request(self) -> Slopes | None:
        return None if self.done else Slopes(self.inputs_, self.loss, self.w)

    def take(self, total: np.ndarray) -> None:
        q, w = len(self.w), self.w
        value = self.weight * total[0] + (self.free * (self.l1 * np.abs(w) + self.l2 / 2 * w * w)).sum()
        self.rounds += 1
        if not np.isfinite(value):
            self.failed = True
        elif self.good is not None and value > self.value + 1e-13 * max(abs(self.value), 1.0):
            self.w = (w + self.good) / 2
            self.done = bool(np.abs(self.w - self.good).max() < TOLERANCE)
        else:
            self.good, self.value = w, value
            g = self.weight * total[1 : 1 + q] + self.l2 * self.free * w
            h = self.weight * total[1 + q :].reshape(q, q) + np.diag(self.l2 * self.free + 1e-12)
            step = self._proximal(w, g, h) if self.l1 else np.linalg.lstsq(h, -g, rcond=None)[0]
            self.w = w + step
            self.done = bool(np.abs(step).max() < TOLERANCE)
        self.done = self.done or self.rounds >= ROUNDS

    def _proximal(self, w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The step to the least of the quadratic and the l1 penalty, coordinate by coordinate."""
        new, slope = w.copy(), g.copy()  # slope: the quadratic's at new
        for _ in range(500):
            most = 0.0
            for j in range(len(w)):
                u = new[j] - slope[j] / h[j, j]
                bound = self.l1 * self.free[j] / h[j, j]
                moved = np.sign(u) * max(abs(u) - bound, 0.0) - new[j]
                if moved:
                    new[j] += moved
                    slope += moved * h[:, j]
                    most = max(most, abs(moved))
            if most < TOLERANCE / 10:
                break
        return new - w

    def model(self) -> LinearModel:
        return LinearModel(self.inputs_, self.good[:-1], float(self.good[-1]))

    def importance(self) -> np.ndarray | None:
        return self.good[:-1] if self.projection is None else None


class Logistic(_Newton):
    """Mean log loss with an l1 or l2 penalty of 1 / (C n); the bias is free."""

    def start(self, C: float = 1.0, penalty: str = "l2") -> None:  # noqa: N803
        if C <= 0 or penalty not in ("l1", "l2") or not self.scale.rows:
            raise ValueError
        n = self.scale.rows
        reg = 1.0 / (C * n)
        self.begin(1.0 / n, reg if penalty == "l1" else 0.0, reg if penalty == "l2" else 0.0)


class LinearMachine(_Newton):
    """Squared hinge loss, C times, with an l2 penalty; scores by a sigmoid of the margin."""

    loss = "hinge"

    def start(self, C: float = 1.0) -> None:  # noqa: N803
        if C <= 0:
            raise ValueError
        self.begin(2.0 * C, 0.0, 1.0)


class KernelMachine(LinearMachine):
    """The same over random waves, whose products approach the kernel exp(-gamma |a - b|^2).

    The error of a product falls with the root of ``features``. gamma is one over the
    number of columns if not given, as these are scaled.
    """

    def start(self, C: float = 1.0, gamma: float | None = None, features: int = 256) -> None:  # noqa: N803
        gamma = 1.0 / max(len(self.columns), 1) if gamma is None else gamma
        if gamma <= 0 or features < 1:
            raise ValueError
        rng = np.random.default_rng(self.seed)
        w = rng.standard_normal((len(self.columns), features)) * np.sqrt(2 * gamma)
        self.projection = Projection("cos", w, rng.uniform(0, 2 * np.pi, features))
        super().start(C)


@dataclass(frozen=True)
class Moments:
    """Sums of the inputs, of their products, and of both with labels of -1 and 1."""

    inputs: Inputs

    @property
    def size(self) -> int:
        q = self.inputs.width
        return 2 + 2 * q + q * q

    def add(self, total: np.ndarray, batch: Batch) -> None:
        a, y = self.inputs.training(batch)
        t, q = 2.0 * y - 1, self.inputs.width
        total[0] += len(a)
        total[1] += t.sum()
        total[2 : 2 + q] += a.sum(axis=0)
        total[2 + q : 2 + 2 * q] += a.T @ t
        total[2 + 2 * q :] += (a.T @ a).ravel()


class RandomFeatures(Fit):
    """Unit random directions, rectified, then ridge on labels of -1 and 1; scores by a sigmoid."""

    def start(self, features: int = 100, alpha: float = 1.0, seed: int | None = None) -> None:
        if features < 1 or alpha < 0:
            raise ValueError
        w = np.random.default_rng(self.seed if seed is None else seed).standard_normal((len(self.columns), features))
        self.inputs_, self.alpha, self.found = replace(self.inputs, projection=Projection("relu", w / np.linalg.norm(w, axis=0))), alpha, None

    def request(self) -> Moments | None:
        return Moments(self.inputs_) if self.found is None else None

    def take(self, total: np.ndarray) -> None:
        n, t, q = total[0], total[1], self.inputs_.width
        if not n:
            self.failed = True
            return
        mean, bias = total[2 : 2 + q] / n, t / n
        gram = total[2 + 2 * q :].reshape(q, q) - n * np.outer(mean, mean)
        coef = np.linalg.lstsq(gram + self.alpha * np.eye(q), total[2 + q : 2 + 2 * q] - mean * t, rcond=None)[0]
        self.found = LinearModel(self.inputs_, coef, float(bias - mean @ coef))

    def model(self) -> LinearModel:
        return self.found


class Neighbours(Fit):
    """Votes of the nearest training rows: nothing is fitted, the rows themselves are met when it is judged."""

    def start(self, k: int = 5, weights: str = "uniform", metric: str = "euclidean") -> None:
        if k < 1 or weights not in ("uniform", "distance") or metric not in ("euclidean", "manhattan"):
            raise ValueError
        self.k, self.weights, self.metric = k, weights, metric


# -- trees, by histograms ---------------------------------------------------------------


def cuts(rows: DataFrame, columns: int) -> list[np.ndarray]:
    """Borders of each column's bins: its quantiles, a sketch of all rows."""
    shares = [k / BINS for k in range(1, BINS)]
    values = [F.get("x", F.lit(j)) for j in range(columns)]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(v), v), shares, ACCURACY).alias(f"c{j}") for j, v in enumerate(values)]).first()
    return [np.unique(np.array(c if c is not None else [], float)) for c in found]


@dataclass
class GrownTree:
    """Nodes in the order of their making; a leaf's column is -1, and bins up to the cut go left."""

    column: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        for side, v in ((self.column, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, value)):
            side.append(v)
        return len(self.value) - 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        at = np.zeros(len(bins), np.int64)
        column, cut, left, right = map(np.array, (self.column, self.cut, self.left, self.right))
        while (inner := np.flatnonzero(column[at] >= 0)).size:
            here = at[inner]
            at[inner] = np.where(bins[inner, column[here]] <= cut[here], left[here], right[here])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass(frozen=True)
class Binned:
    """Bins of a fit's columns, missing cells at their fill."""

    split: Split
    folds: int
    columns: np.ndarray
    scale: Scale
    borders: list[np.ndarray]

    def of(self, x: np.ndarray) -> np.ndarray:
        full = self.scale.filled(x[:, self.columns])
        return np.stack([np.searchsorted(b, full[:, k], "left") for k, b in enumerate(self.borders)], axis=1)


#: Shares of a Poisson distribution of mean 1 below 1, 2, ...: how often a row is drawn.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 16)]))


def drawn(row: np.ndarray, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: a Poisson number from a hash of both, so that every scan agrees."""
    with np.errstate(over="ignore"):
        h = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD6E8FEB86659FD93)
        for _ in range(2):
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.searchsorted(POISSON, (h >> np.uint64(11)) / 2.0**53, "right").astype(float)


@dataclass(frozen=True)
class Histograms:
    """Weights, weighted targets and curvatures by bin, of the columns tried at each open node of each tree."""

    binned: Binned
    trees: list[GrownTree]
    open: list[list[tuple[int, np.ndarray]]]
    draws: list[int | None]
    margin: Callable[[np.ndarray], np.ndarray] | None
    width: int

    @property
    def size(self) -> int:
        return 3 * self.width * sum(len(c) for nodes in self.open for _, c in nodes)

    def add(self, total: np.ndarray, batch: Batch) -> None:
        own = batch.training(self.binned.split, self.binned.folds)
        bins, y = self.binned.of(batch.x[own]), batch.y[own].astype(float)
        target = y - sigmoid(self.margin(bins)) if self.margin else y
        # Newton's step of a leaf: of labels 0 and 1 the curvature is |r| (1 - |r|).
        curve = np.abs(target) * (1 - np.abs(target))
        at = 0
        for tree, nodes, seed in zip(self.trees, self.open, self.draws, strict=True):
            weight = np.ones(len(y)) if seed is None else drawn(batch.row[own], seed)
            reached = tree.nodes(bins)
            for node, columns in nodes:
                rows = np.flatnonzero(reached == node)
                place = (bins[rows][:, columns] + np.arange(len(columns)) * self.width).ravel()
                for channel in (weight, weight * target, weight * curve):
                    size = len(columns) * self.width
                    total[at : at + size] += np.bincount(place, np.repeat(channel[rows], len(columns)), size)
                    at += size


def split_of(hist: np.ndarray, columns: Sequence[int], leaf: int) -> tuple[float, int, int, np.ndarray] | None:
    """(gain, column, cut, sums of the left side) of the cut that lowers the squared error most, the first on ties.

    ``hist`` has three sums by column and bin. The cut lies midway between two bins
    that hold rows.
    """
    best = None
    for k, j in enumerate(columns):
        n, s = hist[0, k], hist[1, k]
        held = np.flatnonzero(n > 0)
        if len(held) < 2:
            continue
        left_n, left_s = np.cumsum(n[held])[:-1], np.cumsum(s[held])[:-1]
        all_n, all_s = n.sum(), s.sum()
        ok = (left_n >= leaf) & (all_n - left_n >= leaf)
        if not ok.any():
            continue
        gain = np.where(ok, left_s**2 / left_n + (all_s - left_s) ** 2 / (all_n - left_n), -np.inf) - all_s**2 / all_n
        i = int(gain.argmax())
        if gain[i] > 1e-12 and (best is None or gain[i] > best[0] * (1 + 1e-12)):
            cut = int(held[i] + held[i + 1]) // 2
            best = float(gain[i]), int(j), cut, hist[:, k, : held[i] + 1].sum(axis=1)
    return best


@dataclass(frozen=True)
class TreeModel:
    binned: Binned
    trees: list[GrownTree]
    base: float | None
    rate: float

    @property
    def split(self) -> Split:
        return self.binned.split

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(bins) for t in self.trees), np.zeros(len(bins)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned.of(x)
        return sigmoid(self.margin(bins)) if self.base is not None else np.mean([t.predict(bins) for t in self.trees], axis=0)


class _Trees(Fit):
    """Trees that grow level by level, each level of all growing trees by one sum."""

    leaf = 2

    def begin(self, trees: int, depth: int) -> None:
        if trees < 1 or depth < 1 or not self.scale.rows:
            raise ValueError
        self.wanted, self.depth, self.gain = trees, depth, np.zeros(len(self.columns))
        self.binned = Binned(self.split, self.folds, self.columns, self.scale.of(self.columns), [self.bins[j] for j in self.columns.tolist()])
        self.grown: list[GrownTree] = []
        self.sow()

    def sow(self) -> None:
        """Begins the next trees."""
        self.growing = [self.sprout(len(self.grown) + i) for i in range(self.at_once())]
        self.level, self.open = 0, [[(0, self.tried(len(self.grown) + i, 0))] for i in range(len(self.growing))]

    def sprout(self, number: int) -> GrownTree:
        tree = GrownTree()
        tree.leaf(0.0)
        return tree

    def request(self) -> Histograms | None:
        if len(self.grown) >= self.wanted:
            return None
        return Histograms(self.binned, self.growing, self.open, [self.draw(len(self.grown) + i) for i in range(len(self.growing))], self.margin(), BINS + 1)

    def take(self, total: np.ndarray) -> None:
        at, after = 0, []
        for i, (tree, nodes) in enumerate(zip(self.growing, self.open, strict=True)):
            fresh = []
            for node, columns in nodes:
                size = 3 * (BINS + 1) * len(columns)
                hist = total[at : at + size].reshape(3, len(columns), BINS + 1)
                at += size
                whole = hist[:, 0].sum(axis=1)
                if node == 0:
                    tree.value[0] = self.value(whole)
                best = split_of(hist, columns, self.leaf) if whole[0] >= 2 * self.leaf else None
                if best is None:
                    continue
                gain, j, cut, low = best
                self.gain[j] += gain
                children = [tree.leaf(self.value(side)) for side in (low, whole - low)]
                tree.column[node], tree.cut[node], (tree.left[node], tree.right[node]) = j, cut, children
                fresh += [(c, self.tried(len(self.grown) + i, c)) for c in children]
            after.append(fresh)
        self.level, self.open = self.level + 1, after
        if self.level >= self.depth or not any(after):
            self.grown += self.growing
            if len(self.grown) < self.wanted:
                self.sow()

    def importance(self) -> np.ndarray:
        return self.gain / max(self.gain.sum(), 1e-12)


class Forest(_Trees):
    """Trees on rows drawn with repetition, each node split among the root of the number of columns."""

    def start(self, trees: int = 50, depth: int = 6, seed: int | None = None) -> None:
        self.seed = self.seed if seed is None else seed
        self.begin(trees, depth)

    def at_once(self) -> int:
        return self.wanted

    def draw(self, number: int) -> int:
        return derived_seed(self.seed, number, "rows")

    def tried(self, number: int, node: int) -> np.ndarray:
        p = len(self.columns)
        return np.sort(np.random.default_rng(derived_seed(self.seed, number, node, "columns")).choice(p, max(1, int(np.sqrt(p))), replace=False))

    def margin(self) -> None:
        return None

    def value(self, sums: np.ndarray) -> float:
        return float(sums[1] / sums[0]) if sums[0] else 0.0

    def model(self) -> TreeModel:
        return TreeModel(self.binned, self.grown, None, 1.0)


class Boosting(_Trees):
    """Small trees one after another, each a step on the log loss of those before."""

    def start(self, trees: int = 50, depth: int = 3, rate: float = 0.1) -> None:
        p = np.clip(self.scale.positive / max(self.scale.rows, 1), 1e-6, 1 - 1e-6)
        self.base, self.rate = float(np.log(p / (1 - p))), rate
        self.begin(trees, depth)

    def at_once(self) -> int:
        return 1

    def draw(self, number: int) -> None:
        return None

    def tried(self, number: int, node: int) -> np.ndarray:
        return np.arange(len(self.columns))

    def margin(self) -> Callable[[np.ndarray], np.ndarray]:
        return self.model().margin

    def value(self, sums: np.ndarray) -> float:
        return float(sums[1] / max(sums[2], 1e-9))

    def model(self) -> TreeModel:
        return TreeModel(self.binned, list(self.grown), self.base, self.rate)


MODELS = {"lr": Logistic, "random_features": RandomFeatures, "knn": Neighbours, "forest": Forest, "boosting": Boosting, "svm": LinearMachine, "rbf_svm": KernelMachine}
#: Those that split at bins.
BINNED = ("forest", "boosting")
