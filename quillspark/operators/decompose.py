"""Left singular vectors of a sparse matrix of rows and terms, which no task holds as a whole.

Right directions are found from random ones, in a space that grows by a block a scan:
a scan multiplies each row with the block and sums the products by term, in blocks of
terms that are merged across tasks. Rows times directions are then reduced to one small triangle
by QR of stacked triangles, within tasks and over them, so nothing is squared. The
driver holds terms by directions, whose number the vocabulary bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import held

#: Directions beyond those asked for, blocks of a basis, scans at most, and the error, over the largest squared value, that ends them.
OVERSAMPLE, BLOCKS, ROUNDS, TOLERANCE = 10, 8, 60, 1e-9
#: Entries of a product made at once, terms of a block, and terms that a vocabulary may have.
ENTRIES, BLOCK, MOST_TERMS = 1 << 22, 1024, 1_000_000


def numbered_terms(vocabulary: DataFrame) -> DataFrame:
    """(term, at): the terms of a vocabulary, of MOST_TERMS at most, numbered from 0 in their order."""
    rows = vocabulary.select("term").distinct()
    if (n := rows.count()) > MOST_TERMS:
        raise ValueError(f"{n} terms; a vocabulary has {MOST_TERMS} at most")
    return rows.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("at"))


def sparse_rows(weights: DataFrame, key: str, value: str, terms: DataFrame, keys: DataFrame) -> DataFrame:
    """A held table (key, at, w) of each of the ``keys``: numbers and weights of its terms; without any, empty arrays."""
    found = weights.join(F.broadcast(terms), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.col(value).cast("double").alias("w")))).alias("e"))
    both = keys.select(key).join(found, key, "left")
    cells = [F.coalesce(F.col(f"e.{c}"), F.array().cast(f"array<{kind}>")).alias(c) for c, kind in (("at", "int"), ("w", "double"))]
    return held(both.select(key, *cells), "sparse-rows")


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of batches (key, at, w), small enough for a product of ``width`` columns, with their entries: row, term, weight."""
    most = max(ENTRIES // width, 1)
    for b in batches:
        sizes = np.diff(b.column(1).offsets.to_numpy()).astype(np.int64)
        start = 0
        while start < b.num_rows:
            stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), most, "right")))
            part = b.slice(start, stop - start)
            own = sizes[start:stop]
            yield part, np.repeat(np.arange(len(own)), own), part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
            start = stop


def _times(n: int, row: np.ndarray, at: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows times directions."""
    out = np.zeros((n, v.shape[1]))
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.add.reduceat(w[:, None] * v[at], first, axis=0)
    return out


def _back(rows: DataFrame, v: np.ndarray) -> np.ndarray:
    """The transposed matrix times the matrix times directions, in one scan."""
    shape = v.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for part, row, at, w in _parts(batches, shape[1]):
            y = _times(part.num_rows, row, at, w, v)
            order = np.argsort(at, kind="stable")
            if len(order):
                first = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
                total[at[order][first]] += np.add.reduceat(w[order, None] * y[row[order]], first, axis=0)
        for i in range(0, shape[0], BLOCK):
            if total[i : i + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i : i + BLOCK].tobytes()], pa.binary())], ["i", "total"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = np.frombuffer(block.as_buffer())
                sums[i] = sums[i] + found if i in sums else found.copy()
        for i, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "total"])

    kind, out = "i int, total binary", np.zeros(shape)
    for r in rows.mapInArrow(partial, kind).repartition("i").mapInArrow(merged, kind).collect():  # a row a block of terms
        out[r["i"] : r["i"] + BLOCK] = np.frombuffer(bytes(r["total"])).reshape(-1, shape[1])
    return out


def _triangle(rows: DataFrame, v: np.ndarray) -> np.ndarray:
    """R of a QR decomposition of rows times directions: triangles are stacked and reduced in tasks, then over a few, then here."""
    width = v.shape[1]

    def reduced(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for block in blocks:
            r = np.linalg.qr(np.vstack([r, block]), "r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def tall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return reduced(_times(part.num_rows, row, at, w, v) for part, row, at, w in _parts(batches, width))

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return reduced(np.frombuffer(r.as_buffer()).reshape(-1, width) for b in batches for r in b.column(0))

    few = rows.mapInArrow(tall, "r binary").repartition(8).mapInArrow(stacked, "r binary").collect()
    return np.linalg.qr(np.vstack([np.zeros((width, width)), *[np.frombuffer(bytes(r["r"])).reshape(-1, width) for r in few]]), "r")


def truncated_svd(rows: DataFrame, terms: int, dims: int, seed: int = 0, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(values, directions): the largest singular values and their right vectors, the largest component of each positive.

    Each scan adds a block of directions to those before it; the best within all of
    them are found without another scan. A basis that is full starts again from its best.
    """
    width = min(dims + OVERSAMPLE, terms)
    q, z = [np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]], []
    for _ in range(rounds):
        z.append(_back(rows, q[-1]))
        basis, image = np.hstack(q), np.hstack(z)
        t = basis.T @ image
        value, y = np.linalg.eigh((t + t.T) / 2)
        value, y = value[::-1], y[:, ::-1]
        best = basis @ y[:, :dims]
        off = np.linalg.norm(image @ y[:, :dims] - best * value[:dims], axis=0)
        if off.max(initial=0.0) <= TOLERANCE * max(value[0], 1e-300):
            break
        fresh = z[-1]
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        u, size, _ = np.linalg.svd(fresh, full_matrices=False)
        fresh = u[:, size > 1e-12 * max(value[0], 1e-300)]
        if not fresh.shape[1]:
            break
        if basis.shape[1] + fresh.shape[1] > BLOCKS * width:
            q, z = [basis @ y[:, :width]], [image @ y[:, :width]]
        q.append(fresh)
    _, s, w = np.linalg.svd(_triangle(rows, best))
    v = best @ w.T
    return s, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)


def embeddings(rows: DataFrame, key: str, terms: int, dims: int, seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """(key, embedding): left singular vectors of ``sparse_rows``, not scaled; components beyond the rank are 0."""
    s, v = truncated_svd(rows, terms, min(dims, terms), seed, rounds) if terms else (np.zeros(0), np.zeros((0, 0)))
    able = s > 1e-10 * s.max(initial=1e-300)
    back = np.where(able, v / np.where(able, s, 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, at, w in _parts(batches, max(back.shape[1], 1)):
            y = _times(part.num_rows, row, at, w, back)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(y), pa.list_(pa.float64()))], [key, "embedding"])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<double>")


def vector_embeddings(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key, embedding): the same of vectors of one length, as rows over their components; a null vector counts as zeros."""
    cells = F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>"))
    size = df.agg(F.max(F.size(vector))).first()[0] or 0
    places = F.when(F.size(cells) > 0, F.sequence(F.lit(0), F.size(cells) - 1)).otherwise(F.array().cast("array<int>"))
    return embeddings(held(df.select(key, places.alias("at"), cells.alias("w")), "vector-rows"), key, max(size, 0), dims)


def term_embeddings(weights: DataFrame, key: str, value: str, keys: DataFrame, dims: int, seed: int = 0, only_if_wide: bool = False) -> DataFrame:
    """(key, embedding) of rows (key, term, value) for each of the ``keys``.

    With ``only_if_wide``, a vocabulary no larger than the number of keys isn't
    decomposed: the embedding is then the row itself, over the terms in their order.
    """
    terms = held(numbered_terms(weights), "terms")
    return row_embeddings(sparse_rows(weights, key, value, terms, keys), key, terms.count(), dims, seed, only_if_wide)


def row_embeddings(rows: DataFrame, key: str, n: int, dims: int, seed: int = 0, only_if_wide: bool = False) -> DataFrame:
    """The same of ``sparse_rows`` over ``n`` terms."""
    if only_if_wide and n <= rows.count():

        def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, row, at, w in _parts(batches, n):
                for i in range(part.num_rows):
                    x, own = np.zeros(n), row == i
                    x[at[own]] = w[own]
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(i, 1), pa.array([x], pa.list_(pa.float64()))], [key, "embedding"])

        return rows.mapInArrow(dense, f"{key} {dict(rows.dtypes)[key]}, embedding array<double>")
    return embeddings(rows, key, n, dims, seed)
