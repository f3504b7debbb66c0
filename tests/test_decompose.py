"""The decomposition of sparse rows against numpy's of the whole matrix."""

import numpy as np
import pytest

from quillspark.operators import decompose as D
from quillspark.plans import textual

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(1)
    a = np.where(rng.random((120, 40)) < 0.15, rng.integers(1, 9, (120, 40)), 0).astype(float)
    a += np.outer(rng.random(120) > 0.5, rng.random(40) > 0.5) * 3.0 * (rng.random((120, 40)) < 0.9)
    a[7] = 0
    a[:, 3] = 0
    return a


@pytest.fixture(scope="module")
def frames(spark, matrix):
    cells = [(int(i), f"t{j:02d}", float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix), strict=True)]
    weights = spark.createDataFrame(cells, "k long, term string, w double").repartition(5)
    return weights, spark.createDataFrame([(i,) for i in range(len(matrix))], "k long")


def rows_of(df):
    return np.array([r.embedding for r in df.orderBy("k").collect()])


@pytest.mark.parametrize("entries", [1 << 22, 300])
def test_vectors_equal_those_of_the_whole(matrix, frames, monkeypatch, entries):
    monkeypatch.setattr(D, "ENTRIES", entries)
    got = rows_of(D.term_embeddings(*[frames[0], "k", "w", frames[1]], 6))
    u = np.linalg.svd(matrix, full_matrices=False)[0][:, :6]
    assert np.allclose(got @ got.T, u @ u.T, atol=1e-6) and np.allclose(np.abs((got * u).sum(axis=0)), 1, atol=1e-6)
    assert (got[7] == 0).all()


def test_values_equal_those_of_the_whole(matrix, frames):
    terms = D.numbered_terms(frames[0])
    n = terms.count()
    assert n == 39
    s, v = D.truncated_svd(D.sparse_rows(frames[0], "k", "w", terms, frames[1]), n, 5)
    assert np.allclose(s, np.linalg.svd(matrix)[1][:5]) and np.allclose(v.T @ v, np.eye(5)) and (v[np.abs(v).argmax(axis=0), range(5)] > 0).all()


def test_more_components_than_there_are(spark):
    cells = spark.createDataFrame([(0, "a", 2.0), (1, "a", 1.0), (1, "b", 0.0), (2, "a", 1.0)], "k long, term string, w double")
    got = rows_of(D.term_embeddings(cells, "k", "w", spark.range(4).withColumnRenamed("id", "k"), 9))
    assert got.shape == (4, 2) and np.allclose(np.abs(got[:, 0]), np.array([2, 1, 1, 0]) / 6**0.5) and np.allclose(got[:, 1], 0)
    none = cells.limit(0)
    assert rows_of(D.term_embeddings(none, "k", "w", spark.range(2).withColumnRenamed("id", "k"), 3)).shape == (2, 0)
    assert D.term_embeddings(none, "k", "w", none.select("k"), 3).count() == 0


def test_rows_stay_where_the_vocabulary_is_small(matrix, frames):
    got = rows_of(D.term_embeddings(*[frames[0], "k", "w", frames[1]], 6, only_if_wide=True))
    assert np.array_equal(got, np.delete(matrix, 3, axis=1))


def test_a_vocabulary_is_bounded(frames, monkeypatch):
    monkeypatch.setattr(D, "MOST_TERMS", 10)
    with pytest.raises(ValueError, match="at most"):
        D.numbered_terms(frames[0])


def test_from_notes_to_embeddings(spark):
    """The query against numpy over the counts that it is made of."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").orderBy("doc_id").collect()
    counts = textual._vocabulary_counts(spark, SF).collect()
    row, col = {r.doc_id: i for i, r in enumerate(docs)}, {t: i for i, t in enumerate(sorted({r.term for r in counts}))}
    a = np.zeros((len(row), len(col)))
    for r in counts:
        a[row[r.doc_id], col[r.term]] = r.n
    got = textual.bow_embedding(spark, SF).withColumnRenamed("doc_id", "k")
    s = np.linalg.svd(a, compute_uv=False)
    k = next(i for i in range(textual.COMPONENTS, 0, -1) if s[i - 1] > 1.02 * s[i])  # a gap, so that the space is one
    u = np.linalg.svd(a, full_matrices=False)[0][:, :k]
    found = rows_of(got)[:, :k]
    assert len(col) == textual.VOCABULARY and np.allclose(found @ found.T, u @ u.T, atol=1e-3)


@pytest.mark.parametrize("terms", [30, 400])
def test_weights_are_decomposed_whatever_the_size(spark, monkeypatch, terms):
    """With fewer terms than documents, and with more."""
    monkeypatch.setattr(textual, "VOCABULARY", terms)
    docs = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").orderBy("doc_id").collect()]
    cells = textual.tfidf_weights_all(spark, SF).collect()
    col = {t: i for i, t in enumerate(sorted({r.term for r in cells}))}
    a = np.zeros((len(docs), len(col)))
    for r in cells:
        a[docs.index(r.doc_id), col[r.term]] = r.weight
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    k = next(i for i in range(textual.COMPONENTS, 0, -1) if s[i - 1] > 1.02 * s[i])  # a gap, so that the space is one
    got = rows_of(textual.tfidf_embedding(spark, SF).withColumnRenamed("doc_id", "k"))
    assert len(docs) == 200 and len(col) == terms and got.shape == (200, textual.COMPONENTS)
    assert np.allclose(got[:, :k] @ got[:, :k].T, u[:, :k] @ u[:, :k].T, atol=1e-3)
