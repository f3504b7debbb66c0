"""Neighbours that queries meet in packs of rows."""

import numpy as np
import pytest

from quillspark.operators import fits, nested, scans, vectors
from quillspark.plans import evaluation

SF = "/root/testdata/sf0.001"


def odd_vectors(rng, n=300):
    for p in (1, 5, 64):
        plain = rng.standard_normal((n, p))
        copies = plain.copy()
        copies[::3] = copies[0]
        odd = plain.copy()
        odd[5], odd[9] = np.nan, np.inf
        yield from (plain, plain * 1e-3 + 1e6, plain * 1e30, plain * 1e-30, plain * 10.0 ** rng.integers(-8, 8, (n, 1)), copies, np.ones((n, p)), np.round(plain), odd)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_neighbours_over_packs_equal_those_of_all_pairs(monkeypatch, metric):
    monkeypatch.setattr(vectors, "ENTRIES", 3000)
    rng = np.random.default_rng(4)
    with np.errstate(all="ignore"):
        for y in odd_vectors(rng):
            ids = rng.permutation(len(y)).astype(np.int64)
            for k in (1, 5, len(y) + 1):
                near = vectors.Nearest(y[:20], ids[:20], k, metric)
                for a, b in ((0, 3), (3, 4), (4, 150), (150, 150), (150, len(y))):
                    near.meet(y[a:b], ids[a:b], np.arange(a, b))
                for i in range(20):
                    off = np.abs(y - y[i])
                    d = off.sum(axis=1) if metric == "manhattan" else np.sqrt((off**2).sum(axis=1))
                    want = [j for j in np.lexsort((ids, d)) if j != i][:k]
                    assert near.carried[i, : len(want)].tolist() == want and np.array_equal(near.d[i, : len(want)], d[want], equal_nan=True)


def test_all_neighbour_fits_are_served_by_one_meeting(spark, monkeypatch):
    """Rows that leave a meeting are k a query at most, not k for each few thousand rows; parts of the rows are put together."""
    rng = np.random.default_rng(3)
    table = [(i, int(i % 3 == 0), *map(float, rng.standard_normal(4))) for i in range(240)]
    rows = nested.design(spark.createDataFrame(table, "id long, y int, a double, b double, c double, d double"), "id", "y", list("abcd"), 2, 3, 2, 7)
    splits = [scans.Split(i, f, p) for i in range(2) for f in range(3) for p in (-1, 0, 1)]
    scales = nested.prepared(rows, splits, 3, 4, "median")
    made = [fits.Neighbours(s, 3, np.arange(4), scales[s], 0, None, {"k": k, "weights": w, "metric": m}) for s in splits[:4] for k, w, m in ((3, "distance", "euclidean"), (1, "uniform", "manhattan"))]
    meetings, met = vectors.meetings, []
    monkeypatch.setattr(vectors, "meetings", lambda *a: met.append(a[2]) or meetings(*a))
    whole = nested.scores(rows, made, 3).collect()
    monkeypatch.setattr(vectors, "PACK", 32)
    monkeypatch.setattr(vectors, "PART", 64)
    parts = nested.scores(rows, made, 3).collect()
    assert met == [(1, 1), (15, 4)]
    key = lambda r: (r.fit, r.row)
    assert [(*key(r), r.sample_idx, r.y_true, pytest.approx(r.y_pred)) for r in sorted(whole, key=key)] == [(*key(r), r.sample_idx, r.y_true, r.y_pred) for r in sorted(parts, key=key)]
    held = {r.row: r for r in rows.collect()}
    for r in whole[:: len(whole) // 40]:
        f = made[r.fit]
        s, x = f.split, f.inputs.of(np.array([held[i].x for i in sorted(held)]))
        own, at = x[sorted(held).index(r.row)], s.iteration * 3 + s.fold
        training = [i for i in held if held[i].outer[s.iteration] != s.fold and (s.part < 0 or held[i].inner[at] != s.part)]
        d = {i: (np.abs(x[sorted(held).index(i)] - own).sum() if f.metric == "manhattan" else np.sqrt(((x[sorted(held).index(i)] - own) ** 2).sum())) for i in training}
        first = sorted(training, key=lambda i: (d[i], i))[: f.k]
        w = [1.0 if f.weights == "uniform" else 1 / d[i] for i in first]
        assert r.y_pred == pytest.approx(sum(a * held[i].y for a, i in zip(w, first, strict=True)) / sum(w)) and r.row not in training


def test_every_row_asks_for_its_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = evaluation.knn_neighbours(spark, SF).groupBy("q").count().collect()
    assert {r.q for r in found} == {r.vec_id for r in rows.select("vec_id").collect()} and {r["count"] for r in found} == {5}
