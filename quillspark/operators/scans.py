"""Sums over all rows of a design for many fits at once: one scan, partial sums a task, merged by key.

A design is a table of row (long), y (0 or 1), x (array of numbers, missing ones NaN)
and, for each iteration of cross-validation, the row's outer and inner folds. A
split names the training rows of a fit; its columns are filled and scaled by what
these rows say. A fit asks for a sum by a request, an object whose ``add`` adds a
batch of training rows to an array; tasks hold one array a request, the driver
receives their totals, and SCAN_BYTES bounds both: more requests take more scans.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import held

SCAN_BYTES = 64 << 20


class Split(NamedTuple):
    """An iteration's training rows outside an outer fold and, from 0, outside an inner one too."""

    iteration: int
    fold: int
    part: int = -1


class Batch(NamedTuple):
    row: np.ndarray
    y: np.ndarray
    x: np.ndarray
    outer: np.ndarray
    inner: np.ndarray

    def training(self, s: Split, folds: int) -> np.ndarray:
        rows = self.outer[:, s.iteration] != s.fold
        return rows if s.part < 0 else rows & (self.inner[:, s.iteration * folds + s.fold] != s.part)

    def judged(self, s: Split, folds: int) -> np.ndarray:
        """Rows that a fit of the split is judged by: its inner fold, or the outer one."""
        if s.part < 0:
            return self.outer[:, s.iteration] == s.fold
        return (self.outer[:, s.iteration] != s.fold) & (self.inner[:, s.iteration * folds + s.fold] == s.part)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    """Arrays of a design's columns row, y, x, outer, inner."""
    for b in batches:
        if b.num_rows:
            wide = [b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for i in (2, 3, 4)]
            yield Batch(b.column(0).to_numpy(), b.column(1).to_numpy(), *wide)


class Request(Protocol):
    size: int

    def add(self, total: np.ndarray, batch: Batch) -> None: ...


def totals(design: DataFrame, requests: Sequence[Request]) -> list[np.ndarray]:
    """The sum that each request asks for, in as many scans as SCAN_BYTES needs."""
    out, start = [], 0
    while start < len(requests):
        stop, size = start + 1, requests[start].size
        while stop < len(requests) and 8 * (size + requests[stop].size) <= SCAN_BYTES:
            size += requests[stop].size
            stop += 1
        out += _scan(design, requests[start:stop])
        start = stop
    return out


def _scan(design: DataFrame, requests: Sequence[Request]) -> list[np.ndarray]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.zeros(r.size) for r in requests]
        for batch in batches_of(batches):
            for r, total in zip(requests, own, strict=True):
                r.add(total, batch)
        for i, total in enumerate(own):
            if total.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "total"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = np.frombuffer(part.as_buffer())
                sums[i] = sums[i] + found if i in sums else found.copy()
        for i, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "total"])

    kind = "i int, total binary"
    found = design.mapInArrow(partial, kind).repartition("i").mapInArrow(merged, kind).collect()  # a row a request, SCAN_BYTES in all
    out = [np.zeros(r.size) for r in requests]
    for r in found:
        out[r["i"]] = np.frombuffer(bytes(r["total"]))
    return out


# -- filling and scaling, by training rows -----------------------------------------


@dataclass(frozen=True)
class Spread:
    """Of the known values of every column in each split's training rows: number, sum and sum of squares about a point; and the rows, and those of label 1."""

    splits: tuple[Split, ...]
    folds: int
    centre: np.ndarray

    @property
    def size(self) -> int:
        return len(self.splits) * (3 * len(self.centre) + 2)

    def add(self, total: np.ndarray, batch: Batch) -> None:
        member = np.stack([batch.training(s, self.folds) for s in self.splits]).astype(float)
        known = ~np.isnan(batch.x)
        off = np.where(known, batch.x - self.centre, 0.0)
        view, p = total[: len(self.splits) * 3 * len(self.centre)].reshape(3, len(self.splits), -1), len(self.splits)
        for i, part in enumerate((known.astype(float), off, off * off)):
            view[i] += member @ part
        total[-2 * p : -p] += member.sum(axis=1)
        total[-p:] += member @ batch.y


@dataclass(frozen=True)
class Centre:
    """Number and sum of the known values of every column, over all rows."""

    columns: int

    @property
    def size(self) -> int:
        return 2 * self.columns

    def add(self, total: np.ndarray, batch: Batch) -> None:
        known = ~np.isnan(batch.x)
        total[: self.columns] += known.sum(axis=0)
        total[self.columns :] += np.where(known, batch.x, 0.0).sum(axis=0)


def medians(design: DataFrame, splits: Sequence[Split], folds: int, columns: Sequence[int]) -> np.ndarray:
    """Exact medians of the known values of ``columns`` in each split's training rows (NaN where none is known).

    The values are sorted once over all tasks, each with the splits it belongs to.
    Every task's counts of a split say in which task its middle values lie, and a
    second reading picks these; no group of values is brought together.
    """
    splits, columns = list(splits), list(columns)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            bits = np.packbits(np.stack([b.training(s, folds) for s in splits], axis=1), axis=1)
            for j in columns:
                known = np.flatnonzero(~np.isnan(b.x[:, j]))
                ends = np.arange(len(known) + 1, dtype=np.int32) * bits.shape[1]
                member = pa.Array.from_buffers(pa.binary(), len(known), [None, pa.py_buffer(ends), pa.py_buffer(bits[known])])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), j, np.int32)), pa.array(b.x[known, j]), member], ["c", "v", "m"])

    def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, ends, data = b.column(2).buffers()
        start = np.frombuffer(ends, np.int32)[b.column(2).offset]
        width = -(-len(splits) // 8)
        m = np.frombuffer(data, np.uint8)[start : start + b.num_rows * width].reshape(b.num_rows, width)
        return b.column(0).to_numpy(), b.column(1).to_numpy(), np.unpackbits(m, axis=1, count=len(splits))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part), pa.int32())], ["c", "v", "m", "part"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            c, _, member = unpacked(b)
            part = b.column(3).to_numpy()
            for key in sorted(set(zip(part.tolist(), c.tolist(), strict=True))):
                own = member[(part == key[0]) & (c == key[1])].sum(axis=0, dtype=np.int64)
                counts[key] = counts.get(key, 0) + own
        for (part, c), n in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([c], pa.int32()), pa.array([n.tobytes()], pa.binary())], ["part", "c", "n"])

    order = ["c", "v"]
    ranged = design.mapInArrow(values, "c int, v double, m binary").repartitionByRange(*order).sortWithinPartitions(*order)
    kept = held(ranged.mapInArrow(placed, "c int, v double, m binary, part int"), "medians")
    found: dict[tuple[int, int], np.ndarray] = {}
    for r in kept.mapInArrow(counted, "part int, c int, n binary").collect():  # one for each task and column in it
        found[r["c"], r["part"]] = found.get((r["c"], r["part"]), 0) + np.frombuffer(bytes(r["n"]), np.int64)
    out = np.full((2, len(splits), len(columns)), np.nan)
    wanted: dict[int, list[tuple[int, int, int, int]]] = {}  # by task: column, split, which of the two middle values, rank
    for k, j in enumerate(columns):
        parts = sorted(p for c, p in found if c == j)
        ends = np.cumsum([found[j, p] for p in parts], axis=0) if parts else np.zeros((1, len(splits)), np.int64)
        for s in range(len(splits)):
            n = int(ends[-1, s])
            for which, rank in enumerate(((n - 1) // 2, n // 2) if n else ()):
                at = int(np.searchsorted(ends[:, s], rank, "right"))
                wanted.setdefault(parts[at], []).append((j, s, which, rank - (int(ends[at - 1, s]) if at else 0)))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], np.ndarray] = {}
        rows: list[tuple[int, int, int, float]] = []
        for b in batches:
            c, v, member = unpacked(b)
            part = b.column(3).to_numpy()
            for key in sorted(set(zip(part.tolist(), c.tolist(), strict=True))):
                own = np.flatnonzero((part == key[0]) & (c == key[1]))
                before = seen.get(key, np.zeros(len(splits), np.int64))
                ends = before + np.cumsum(member[own], axis=0, dtype=np.int64)
                for col, s, which, rank in wanted.get(key[0], ()):
                    if col == key[1] and before[s] <= rank < ends[-1, s]:
                        rows.append((col, s, which, float(v[own[np.searchsorted(ends[:, s], rank, "right")]])))
                seen[key] = ends[-1]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["c", "s", "which", "v"])

    again = kept.filter(F.col("part").isin(*wanted)).repartition("part").sortWithinPartitions("part", *order)
    for r in again.mapInArrow(picked, "c long, s long, which long, v double").collect():  # two a split and column
        out[r["which"], r["s"], columns.index(r["c"])] = r["v"]
    return out.mean(axis=0)
