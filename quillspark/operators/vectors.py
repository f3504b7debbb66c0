"""Embedding variants and exact neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes of a pack at most, rows of a part that queries meet in one task, entries of a product made at once.
PACK, PACK_BYTES, PART, ENTRIES = 8192, 8 << 20, 1 << 18, 1 << 20
#: Pairs measured at once.
MEASURED = 1 << 14
#: Stands for the id of no row.
NONE = np.iinfo(np.int64).max


def trimmed(embedding: Column, dims: int) -> Column:
    """The first ``dims`` components; all of them if there are no more, or for -1."""
    return embedding if dims < 0 else F.when(F.size(embedding) > dims, F.slice(embedding, 1, dims)).otherwise(embedding)


class Nearest:
    """The k nearest rows that queries have met so far: distances, ids, and what the rows carry; without one, infinite distance and no id."""

    def __init__(self, x: np.ndarray, queries: np.ndarray, k: int, metric: str):
        self.x, self.queries, self.k, self.metric, self.products = x, queries, k, metric, None
        self.d, self.v, self.carried = np.full((len(x), k), np.inf), np.full((len(x), k), NONE), np.zeros((len(x), k), np.int64)

    def meet(self, y: np.ndarray, ids: np.ndarray, carried: np.ndarray) -> None:
        """Takes along the rows that are nearer than those known, ties by id."""
        if not len(y) or not len(self.x):
            return
        if self.metric == "manhattan":
            rough = _sums
        else:
            rough = self.products = self.products or _Products(self.x, y)
            rough.of(y)
        for start in range(0, len(self.x), step := max(ENTRIES // len(y), 1)):
            own = slice(start, start + step)
            full = self.v[own, -1] != NONE
            reach = np.where(full, self.d[own, -1], np.inf)
            i, j = np.divmod(rough(self, own, y, ids, reach, ~full), len(y))
            other = ids[j] != self.queries[i + start]
            i, j = i[other], j[other]
            d = np.concatenate([self._distance(y, i[c : c + MEASURED] + start, j[c : c + MEASURED]) for c in range(0, max(len(i), 1), MEASURED)])
            close = ~(d > reach[i])
            if close.any():
                self._merge(i[close] + start, d[close], ids[j[close]], carried[j[close]])

    def _distance(self, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        off = y[j] - self.x[i]
        return np.abs(off).sum(axis=1) if self.metric == "manhattan" else np.sqrt((off**2).sum(axis=1))

    def edge(self, rough: np.ndarray, own: slice, ids: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """The k-th least of ``rough`` for queries that are ``fresh``, without their own rows."""
        part = rough[fresh]
        part[self.queries[own][fresh][:, None] == ids[None]] = np.inf
        return np.partition(part, self.k - 1, axis=1)[:, self.k - 1]

    def _merge(self, i: np.ndarray, d: np.ndarray, v: np.ndarray, carried: np.ndarray) -> None:
        rows = np.unique(i)
        row = np.r_[np.repeat(rows, self.k), i]
        d, v, carried = np.r_[self.d[rows].ravel(), d], np.r_[self.v[rows].ravel(), v], np.r_[self.carried[rows].ravel(), carried]
        order = np.lexsort((v, d, v == NONE, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        kept = order[rank < self.k].reshape(-1, self.k)
        self.d[rows], self.v[rows], self.carried[rows] = d[kept], v[kept], carried[kept]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``d`` that hold a row, by query and rank."""
        return np.nonzero(self.v != NONE)


def _sums(near: Nearest, own: slice, y: np.ndarray, ids: np.ndarray, reach: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Flat places of pairs no farther than ``reach``, or than the k-th nearest of queries that have none as they are ``fresh``."""
    rough = np.stack([np.abs(y - q).sum(axis=1) for q in near.x[own]])
    if fresh.any() and len(ids) > near.k:
        reach = reach.copy()
        reach[fresh] = near.edge(rough, own, ids, fresh)
    return np.flatnonzero(~(rough > reach[:, None]))


class _Products:
    """The same by squared distances of one product of matrices, in single precision.

    They leave out what is surely farther, with a margin above their rounding. All are
    moved and scaled so that the queries, and the rows met first, have lengths of 1 at most.
    """

    scratch = np.empty(0, np.float32), np.empty(0, bool)  # a process works on one product at a time

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.middle = y.mean(axis=0)
        a, b = x - self.middle, y - self.middle
        own = np.einsum("ij,ij->i", a, a)
        most = np.sqrt(max(own.max(), np.einsum("ij,ij->i", b, b).max()))
        self.scale = most if most > 0 and np.isfinite(most) else 1.0
        self.own = own / self.scale**2
        self.left = np.c_[a * (-2 / self.scale), np.ones(len(a))].astype(np.float32)

    def of(self, y: np.ndarray) -> None:
        """The rows that come next."""
        b = (y - self.middle) / self.scale
        others = np.einsum("ij,ij->i", b, b)
        self.right = np.c_[b, others].astype(np.float32).T
        # A product has a term for each component and one for the square; a rounding is 2 to the -24 at most.
        self.margin = (y.shape[1] + 8) * 2.0**-23 * (np.sqrt(self.own) + np.sqrt(others.max())) ** 2 + 1e-30
        size = min(max(ENTRIES // len(y), 1), len(self.own)) * len(y)
        if size > len(self.scratch[0]):
            _Products.scratch = np.empty(size, np.float32), np.empty(size, bool)

    def __call__(self, near: Nearest, own: slice, y: np.ndarray, ids: np.ndarray, reach: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        left = self.left[own]
        rough, far = (a[: len(left) * len(y)].reshape(len(left), len(y)) for a in self.scratch)
        np.matmul(left, self.right, out=rough)
        edge = (reach / self.scale) ** 2 - self.own[own]
        if fresh.any() and len(ids) > near.k:
            edge[fresh] = near.edge(rough, own, ids, fresh) + self.margin[own][fresh]
        edge = np.nextafter((edge + self.margin[own]).astype(np.float32), np.float32(np.inf))
        np.greater(rough, edge[:, None], out=far)
        return _places(np.logical_not(far, out=far).ravel())


def _places(flags: np.ndarray) -> np.ndarray:
    """Places of the few that are set: first words of eight of them, then these one by one."""
    n = len(flags) // 8 * 8
    at = (np.flatnonzero(flags[:n].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.r_[at[flags[at]], n + np.flatnonzero(flags[n:])]


def _chosen(x: np.ndarray, y: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int, metric: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and the places and distances of its k nearest rows, ties by id."""
    near = Nearest(x, queries, k, metric)
    near.meet(y, ids, np.arange(len(ids)))
    for i in range(len(x)):
        own = near.v[i] != NONE
        yield i, near.carried[i, own], near.d[i, own]


def _packs(df: DataFrame) -> DataFrame:
    """(n, pack): the rows in packs, as Arrow writes them, of PACK rows and PACK_BYTES at most, with a number for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for b in batches:
            many = max(-(-b.num_rows // PACK), -(-b.nbytes // PACK_BYTES), 1)
            for start in range(0, b.num_rows, size := max(-(-b.num_rows // many), 1)):
                part, out = b.slice(start, size), pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["n", "pack"])
                n += 1

    return df.mapInArrow(run, "n long, pack binary")


def parts_of(queries: int, rows: int) -> tuple[int, int]:
    """In how many parts queries and rows meet each other."""
    return max(-(-queries // PACK), min(16, -(-queries // (PACK // 2))), 1), max(-(-rows // PART), 1)


def meetings(queries: DataFrame, rows: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """(rn, r, qn, q): numbers and packs of rows and queries, each of these with each of those.

    A task has a part of either. It reads the packs of its rows one after another, and
    all its queries meet a pack before the next, so what it holds are these queries.
    """
    asked = _packs(queries).repartitionByRange(parts[0], "n").select(F.col("n").alias("qn"), F.col("pack").alias("q"))
    met = _packs(rows).repartitionByRange(parts[1], "n").select(F.col("n").alias("rn"), F.col("pack").alias("r"))
    return met.hint("shuffle_replicate_nl").crossJoin(asked)  # packs by packs


def opened(pack: pa.Scalar) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(pack.as_buffer())))


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, keep: Sequence[str] = (), metric: str = "euclidean") -> DataFrame:
    """(q, v, keep…, d, rank): each query's k nearest other rows by Euclidean (or Manhattan) distance, ties by key.

    A task's queries meet packs of rows and take along k rows a query, so no pair is a
    row of its own; a query has k rows for each part of the rows, of PART rows.
    """
    cells = [F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")]
    parts = parts_of(queries.count(), rows.count())
    pairs = meetings(queries.select(*cells), rows.select(*cells, *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]), parts)
    types = dict(rows.dtypes)
    schema = "q long, v long, " + "".join(f"{c} {types[c]}, " for c in keep) + "d double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, Nearest] = {}
        carried, places, seen = [], {}, 0
        last, y, ids = None, None, None
        for b in batches:
            for rn, r, qn, q in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
                if rn != last:
                    pack = opened(r)
                    last, ids, y = rn, pack.column(0).to_numpy(), matrix(pack.column(1))
                    if rn not in places:
                        places[rn] = seen
                        seen += pack.num_rows
                        carried.append(pack.select(range(2, pack.num_columns)) if keep else None)
                if qn not in asked:
                    pack = opened(q)
                    asked[qn] = Nearest(matrix(pack.column(1)), pack.column(0).to_numpy(), k, metric)
                asked[qn].meet(y, ids, places[rn] + np.arange(len(ids)))
        kept = pa.Table.from_batches(carried) if keep and carried else None
        for near in asked.values():
            at = near.found()
            others = [c.combine_chunks() for c in kept.take(pa.array(near.carried[at])).columns] if keep else []
            yield pa.RecordBatch.from_arrays([pa.array(near.queries[at[0]]), pa.array(near.v[at]), *others, pa.array(near.d[at])], ["q", "v", *keep, "d"])

    w = Window.partitionBy("q").orderBy("d", "v")
    return pairs.mapInArrow(run, schema).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vote(neighbours: DataFrame, label: str) -> DataFrame:
    """(q, vote): the most frequent label, of any type, among the neighbours, ties by label."""
    counts = neighbours.groupBy("q", label).agg(F.count("*").alias("n"))
    best = counts.groupBy("q").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(label).alias("label"))).alias("b"))
    return best.select("q", F.col("b.label").alias("vote"))
