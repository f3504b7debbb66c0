"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then placed in the leaf
that descending by nearest centre leads to. A query visits leaves best bin first:
a priority queue holds the branches not taken, by the distance of their centres.
How many leaves a query visits is calibrated: queries of a sample are answered by
brute force over all vectors, and visits widen until their recall is reached.
Distances are Euclidean, in double precision, on the vectors as they are.

Defined results: vectors that are null, empty or zero, or that hold null or
non-finite components take no part, nor do rows without id; vectors of each length
are indexed on their own, and a query's neighbours are those of its length; rows that
share a query's id are its own, and the least of their vectors of a length is asked;
other repeated rows are candidates each; with fewer candidates than ``k`` a query gets
all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Vectors that the tree is fitted on, at most; children of a node; vectors of a
#: leaf, at most, in the sample.
SAMPLE, BRANCHES, LEAF = 20_000, 32, 16
#: Queries that visits are calibrated on, and the recall that they must reach. It is
#: above the 0.9 that all queries are to reach, as a margin for those not sampled.
CALIBRATION, RECALL = 200, 0.94
#: Vectors in a packed block of a leaf, and of a leaf that meet queries in one place.
BLOCK, PLACE = 2_000, 20_000
#: Components of differences that are held at once.
AT_ONCE = 1 << 21
#: Answers that a task holds before it cuts them to each query's nearest.
HELD_ANSWERS = 200_000


class Tree(NamedTuple):
    """Nodes in arrays; a leaf has no children and a number of its own."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.zeros(len(vectors), np.int64)
        moving = np.arange(len(vectors))
        while len(moving):
            stay = []
            for node in np.unique(at[moving]).tolist():
                below = self.children[node]
                if below:
                    own = moving[at[moving] == node]
                    at[own] = np.array(below)[_nearest(vectors[own], self.centres[below])]
                    stay.append(own)
            moving = np.concatenate(stay) if stay else np.empty(0, np.int64)
        return np.array(self.leaf)[at]

    def visits(self, query: np.ndarray, counts: dict[int, int], leaves: int, enough: int) -> list[int]:
        """Leaves, best bin first: ``leaves`` of them, and more until they hold ``enough`` vectors."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < leaves or held < enough):
            _, node = heapq.heappop(queue)
            while below := self.children[node]:
                d = ((self.centres[below] - query) ** 2).sum(axis=1)
                first = int(d.argmin())
                for i, b in enumerate(below):
                    if i != first:
                        heapq.heappush(queue, (float(d[i]), b))
                node = below[first]
            if counts.get(self.leaf[node]):
                out.append(self.leaf[node])
                held += counts[self.leaf[node]]
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)


def grow(sample: np.ndarray, seed: int = 7) -> Tree:
    """A tree over the distinct vectors of a sample, each node split by k-means."""
    sample = np.unique(sample, axis=0) if len(sample) else sample
    rng = np.random.default_rng(seed)
    centres, children, leaf = [sample.mean(axis=0) if len(sample) else np.zeros(1)], [[]], [-1]
    open_nodes = [(0, sample)]
    while open_nodes:
        node, own = open_nodes.pop()
        if len(own) <= LEAF:
            leaf[node] = node
            continue
        k = min(BRANCHES, -(-len(own) // LEAF))
        c = own[rng.choice(len(own), k, replace=False)]
        for _ in range(8):
            near = _nearest(own, c)
            c = np.stack([own[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
        near = _nearest(own, c)
        groups = [own[near == j] for j in range(k) if (near == j).any()]
        if len(groups) < 2:
            leaf[node] = node
            continue
        for g in groups:
            children[node].append(len(centres))
            open_nodes.append((len(centres), g))
            centres.append(g.mean(axis=0))
            children.append([])
            leaf.append(-1)
    return Tree(np.array(centres), children, leaf)


def valid(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _index(tree: Tree, dim: int):
    """Packs a task's vectors into blocks by leaf, each with a place by a hash of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            if not len(ids):
                continue
            leaf = tree.place(x)
            order = np.argsort(leaf, kind="stable")
            starts = np.flatnonzero(np.r_[True, leaf[order][1:] != leaf[order][:-1]])
            rows = []
            for own in np.split(order, starts[1:]):
                for a in range(0, len(own), BLOCK):
                    part = own[a : a + BLOCK]
                    raw = ids[part].astype("<i8").tobytes()
                    rows.append((int(leaf[part[0]]), zlib.crc32(raw) >> 1, len(part), raw, x[part].astype("<f8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["leaf", "place", "n", "ids", "vectors"])

    return run


class _Answers:
    """What a task's blocks answer, cut to each query's k nearest again and again."""

    def __init__(self, dim: int, k: int):
        self.dim, self.k, self.held, self.n = dim, k, [], 0

    def add(self, queries: np.ndarray, places: np.ndarray, leaf: int, ids: bytes, vectors: bytes) -> None:
        own, x = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, self.dim)
        step = max(1, AT_ONCE // max(1, x.size))
        for a in range(0, len(queries), step):
            q = queries[a : a + step]
            d = np.sqrt(((x[None] - places[a : a + step, None]) ** 2).sum(axis=2))
            d[q[:, None] == own[None]] = np.inf
            edge = np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k] if len(own) > self.k else np.inf
            row, col = np.nonzero((d <= edge) & (d < np.inf))
            self.held.append((q[row], own[col], d[row, col], np.full(len(row), leaf)))
            self.n += len(row)
            if self.n > HELD_ANSWERS:
                self._cut()

    def _cut(self) -> None:
        query, ids, d, leaf = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, d, query))
        query, ids, d, leaf = query[order], ids[order], d[order], leaf[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        keep = rank < self.k
        self.held = [(query[keep], ids[keep], d[keep], leaf[keep])]
        self.n = int(keep.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            self._cut()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.held[0], (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["query_id", "vec_id", "score", "leaf"])


def _top(answers: DataFrame, k: int) -> DataFrame:
    """Each query's k nearest of what the blocks found, ranked; partial results are cut first."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(df: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``queries`` selects."""
    rows = df.filter(F.col(vec_id).isNotNull() & valid(vector)).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("is_query"))
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    if not lengths:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, [_search(rows.filter(F.size("v") == dim), dim, k) for dim in lengths])


def _search(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """What ``search`` gives, over rows (id, v, is_query) with vectors of one length."""
    # Rows are drawn at random, so a vector of very many rows is drawn in proportion.
    drawn = rows.select("v").sample(min(1.0, 0.95 * SAMPLE / max(rows.count(), 1)), 20240229).limit(SAMPLE).toArrow()
    tree = grow(_matrix(drawn.column(0).combine_chunks(), dim))
    del drawn
    index = materialise(rows.select("id", "v").mapInArrow(_index(tree, dim), "leaf long, place int, n long, ids binary, vectors binary"), "ann-index")
    counts = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    # A leaf of very many vectors lies in several places, all of which its queries visit.
    places = {leaf: n // PLACE + 1 for leaf, n in counts.items()}
    # The number of tasks is given: a query is little data, and much work.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.filter("is_query").repartition(tasks, "id").groupBy("id").agg(F.min("v").alias("v"))
    sample = [(r["id"], np.array(r["v"])) for r in asked.orderBy(F.xxhash64("id")).limit(CALIBRATION).collect()]
    leaves = _calibrated(index, tree, sample, counts, dim, k)
    enough = 2 * k + 2

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list[tuple[int, bytes]]] = {}
            for q, v in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), dim), strict=True):
                for leaf in tree.visits(v, counts, leaves, enough):
                    found.setdefault(leaf, []).append((q, v.tobytes()))
            for leaf, own in found.items():
                q, v = np.array([q for q, _ in own], "<i8").tobytes(), b"".join(v for _, v in own)
                n = places[leaf]
                yield pa.RecordBatch.from_arrays([pa.array([leaf] * n), pa.array(range(n), pa.int32()), pa.array([q] * n, pa.binary()), pa.array([v] * n, pa.binary())], ["leaf", "place", "queries", "places"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Answers(dim, k)
        for batch in batches:
            for leaf, q, p, ids, x in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                held.add(np.frombuffer(q, "<i8"), np.frombuffer(p, "<f8").reshape(-1, dim), leaf, ids, x)
        yield from held.rows()

    plan = asked.mapInArrow(visit, "leaf long, place int, queries binary, places binary")
    # A query's row becomes one for each leaf that it visits, which Spark's estimate of
    # the plan's size leaves out: without the hint it is broadcast through the driver.
    joined = plan.hint("merge").join(_placed(index, places).hint("merge"), ["leaf", "place"]).select("leaf", "queries", "places", "ids", "vectors")
    answers = joined.mapInArrow(answer, "query_id long, vec_id long, score double, leaf long")
    return _top(answers, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _placed(index: DataFrame, places: dict[int, int]) -> DataFrame:
    """The index, its blocks' random places taken within those of their leaves (few of which have several)."""
    several = {leaf: n for leaf, n in places.items() if n > 1}
    if not several:
        return index.withColumn("place", F.lit(0))
    number = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in several.items() for x in pair]), F.col("leaf")), F.lit(1))
    return index.withColumn("place", F.pmod(F.col("place"), number).cast("int"))


def _calibrated(index: DataFrame, tree: Tree, sample: list[tuple[int, np.ndarray]], counts: dict[int, int], dim: int, k: int) -> int:
    """The number of leaves to visit for the recall, from the sample's true neighbours."""

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Answers(dim, k)
        for batch in batches:
            for leaf, ids, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.add(queries, vectors, leaf, ids, x)
        yield from held.rows()

    if not sample:
        return 1
    queries, vectors = np.array([q for q, _ in sample]), np.array([v for _, v in sample])
    answers = index.select("leaf", "ids", "vectors").mapInArrow(brute, "query_id long, vec_id long, score double, leaf long")
    needed = []
    order = {q: {leaf: i for i, leaf in enumerate(tree.visits(v, counts, len(counts), 0))} for q, v in sample}
    for r in _top(answers, k).collect():  # k rows for each of at most CALIBRATION queries
        needed.append(order[r["query_id"]][r["leaf"]] + 1)
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))] if needed else 1
