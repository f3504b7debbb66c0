"""Permutation test of two models' predictions on the same samples.

Rows have y_true and the two scores s1 and s2, a whole-numbered sample, and the
whole-numbered cell columns ``by``, such as iteration and fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import auc

#: Scores, and permutations, that are worked on at once.
ENTRIES, CHUNK = 512, 1024
#: Odd factors of sample, permutation and cell columns, and the steps of a
#: published 64-bit finaliser.
FACTORS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9, 0xF1357AEA2E62A9C5)
FINAL = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def swapped(sample: np.ndarray, b: int | np.ndarray, cell: Sequence[int]) -> np.ndarray:
    """Whether each sample's scores are swapped in a permutation and cell: the top bit of a hash of all three."""
    fixed = sum(int(c) * f for c, f in zip(cell, FACTORS[2:], strict=False)) & 0xFFFFFFFFFFFFFFFF
    with np.errstate(over="ignore"):
        x = sample.astype(np.uint64) * np.uint64(FACTORS[0]) + np.asarray(b).astype(np.uint64) * np.uint64(FACTORS[1]) + np.uint64(fixed)
        for shift, factor in FINAL:
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(63) == 1


class Sweep:
    """What a run of a cell's scores, in ascending order, gives for every permutation.

    Each sample has two scores, of which a permutation gives one to the first model
    and the other to the second. For the first: pairs won, u1, and positive and
    negative scores, p1 and n1; for the second: pairs won, u2; and of both together
    the scores of either label, p and n. Equal scores share their wins, over blocks too.
    """

    def __init__(self, permutations: int, cell: Sequence[int]):
        self.cell, self.size = cell, permutations + 1
        self.u1, self.u2, self.p1, self.n1 = np.zeros((4, self.size))
        self.p = self.n = 0.0
        self.score, self.open, self.open_all = None, np.zeros((2, self.size)), np.zeros(2)

    def add(self, score: np.ndarray, positive: np.ndarray, second: np.ndarray, sample: np.ndarray) -> None:
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        label = np.stack([positive, ~positive])
        every = np.add.reduceat(label, starts, axis=1, dtype=float)
        same = score[0] == self.score
        every = self._joined(self.open_all[:, None], every, same)
        below = self.n + np.cumsum(every[1]) - every[1]
        for c in range(0, self.size, CHUNK):
            cut = slice(c, min(c + CHUNK, self.size))
            b = np.arange(cut.start, cut.stop)
            first = (swapped(sample[:, None], b[None, :], self.cell) & (b > 0)) ^ ~second[:, None]
            own = np.stack([np.add.reduceat(first & x[:, None], starts, axis=0, dtype=float) for x in label])
            own = self._joined(self.open[:, None, cut], own, same)
            self._close(own[:, :-1], every[:, :-1], below[:-1], cut)
            self.open[:, cut] = own[:, -1]
        self.p, self.n = self.p + every[0, :-1].sum(), self.n + every[1, :-1].sum()
        self.score, self.open_all = score[-1], every[:, -1]

    def _joined(self, opened: np.ndarray, groups: np.ndarray, same: bool) -> np.ndarray:
        """The groups of equal scores, behind the one that is still open, or into which this goes on."""
        if same:
            groups[:, :1] += opened
            return groups
        return np.concatenate([opened, groups], axis=1)

    def _close(self, own: np.ndarray, every: np.ndarray, below: np.ndarray, cut: slice) -> None:
        p, n = own
        before = self.n1[cut] + np.cumsum(n, axis=0) - n
        self.u1[cut] += (p * (before + n / 2)).sum(axis=0)
        self.u2[cut] += ((every[0][:, None] - p) * (below[:, None] - before + (every[1][:, None] - n) / 2)).sum(axis=0)
        self.p1[cut] += p.sum(axis=0)
        self.n1[cut] += n.sum(axis=0)

    def total(self) -> np.ndarray:
        """Rows u1, u2, p1, n1, and one that begins with p and n."""
        self._close(self.open[:, None], self.open_all[:, None], np.array([self.n]), slice(0, self.size))
        last = np.zeros(max(self.size, 2))
        last[:2] = self.p + self.open_all[0], self.n + self.open_all[1]
        return np.stack([*(np.resize(x, len(last)) for x in (self.u1, self.u2, self.p1, self.n1)), last])


def after(done: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The totals of two runs of which the second has the higher scores."""
    out = done + more
    out[0] += more[2] * done[3]
    out[1] += (more[4, 0] - more[2]) * (done[4, 1] - done[3])
    return out


def differences(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, difference) of every cell: area of s2 less that of s1, both ranked in one pass."""
    pairs = F.explode(F.array(F.struct(F.lit(1).alias("model"), F.col("s1").alias("y_pred")), F.struct(F.lit(2).alias("model"), F.col("s2").alias("y_pred"))))
    long = rows.withColumn("p", pairs).select(*by, "y_true", "p.model", "p.y_pred")
    area = auc(long, [*by, "model"])
    sign = F.when(F.col("model") == 2, F.col("auc")).otherwise(-F.col("auc"))
    return area.groupBy(*by).agg(F.sum(sign).alias("difference"))


def null_differences(rows: DataFrame, sample: str, by: Sequence[str], permutations: int) -> DataFrame:
    """(b, d): the mean over cells of each permutation's difference, b from 1; 0 is the observed one.

    All scores are sorted once, by cell and score, over tasks. A task sweeps its runs
    for all permutations at once, and the totals of a cell's runs are put together in
    order, so no cell comes to one task and nothing is sorted for a permutation. A
    swap is drawn anew in every cell.
    """
    spark = rows.sparkSession
    cells = [F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(by)]
    entry = F.explode(F.array(F.struct(F.col("s1").alias("score"), F.lit(False).alias("second")), F.struct(F.col("s2").alias("score"), F.lit(True).alias("second"))))
    entries = rows.select(*cells, (F.col("y_true") == 1).alias("positive"), F.col(sample).cast("long").alias("sample"), entry.alias("e")).select(*[f"c{i}" for i in range(len(by))], "positive", "sample", "e.*")
    order, width = [*[f"c{i}" for i in range(len(by))], "score"], len(by)
    # As many tasks as the session has, however few the bytes are: the work is in the permutations.
    dealt = entries.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    names = ["cell", "part", "total"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current = TaskContext.get().partitionId(), None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([list(current.cell)], pa.list_(pa.int64())), pa.array([part], pa.int32()), pa.array([current.total().tobytes()], pa.binary())], names)

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width + 4)]
            cell, (positive, ids, score, second) = np.stack(columns[:width], axis=1) if width else np.zeros((batch.num_rows, 0), np.int64), columns[width:]
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])[: batch.num_rows]
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                if current is None or current.cell != tuple(cell[a].tolist()):
                    if current:
                        yield out()
                    current = Sweep(permutations, tuple(cell[a].tolist()))
                for i in range(a, z, ENTRIES):
                    cut = slice(i, min(i + ENTRIES, z))
                    current.add(score[cut], positive[cut], second[cut], ids[cut])
        if current:
            yield out()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, None

        def out() -> pa.RecordBatch:
            u1, u2, p1, n1, (p, n, *_) = done
            with np.errstate(invalid="ignore", divide="ignore"):
                d = (u2 / ((p - p1) * (n - n1)) - u1 / (p1 * n1))[: permutations + 1]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(d), dtype=np.int32)), pa.array(d)], ["b", "difference"])

        for batch in batches:
            for cell, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                total = np.frombuffer(blob.as_buffer()).reshape(5, -1)
                if cell != current:
                    if current is not None:
                        yield out()
                    current, done = cell, total
                else:
                    done = after(done, total)
        if current is not None:
            yield out()

    totals = dealt.mapInArrow(sweep, "cell array<long>, part int, total binary").repartition("cell").sortWithinPartitions("cell", "part")
    return totals.mapInArrow(whole, "b int, difference double").groupBy("b").agg(F.round(F.avg("difference"), 9).alias("d"))


def test(rows: DataFrame, sample: str, by: Sequence[str], permutations: int = 10_000) -> DataFrame:
    """One row: observed mean difference, one-sided p, and mean, deviation and 95 % range under the null."""
    delta = null_differences(rows, sample, by, permutations)
    observed = F.max(F.when(F.col("b") == 0, F.col("d")))
    null = F.when(F.col("b") > 0, F.col("d"))
    stats = delta.agg(observed.alias("observed"), F.collect_list(null).alias("nulls"), F.avg(null).alias("null_mean"), F.stddev_pop(null).alias("null_std"), F.percentile(null, 0.025).alias("low"), F.percentile(null, 0.975).alias("high"))
    hits = F.size(F.filter("nulls", lambda x: x >= F.col("observed")))
    return stats.select("observed", ((F.lit(1.0) + hits) / F.lit(permutations + 1)).alias("p_value"), "null_mean", "null_std", "low", "high")


def paired(first: DataFrame, second: DataFrame, by: Sequence[str] = ("iteration", "fold"), sample: str = "sample_idx") -> DataFrame:
    """(by, sample, y_true, s1, s2) from two tables of predictions, of samples that both have."""
    other = second.select(*by, sample, F.col("y_pred").alias("s2"))
    return first.select(*by, sample, "y_true", F.col("y_pred").alias("s1")).join(other, [*by, sample])


def stored(store, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name in a store (``sources.checkpoints``), made and saved if there is none."""
    return store.load(name) if store.exists(name) else store.save(make(), name)


def all_pairs(store, sets: Mapping[str, Callable[[], DataFrame]], kinds: Mapping[str, str], permutations: int = 10_000, wanted: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(first, second, observed, …) of each pair of sets of features, in order.

    ``sets`` makes each set's predictions, all with the same seeds; stored ones are
    used again. Pairs with a set that isn't known, or of kind rfg, are left out.
    """
    usable = [name for name in sets if kinds.get(name) != "rfg"]
    chosen = [p for p in (wanted if wanted is not None else combinations(usable, 2)) if set(p) <= set(usable)]
    if not chosen:
        return store.spark.createDataFrame([], "first string, second string, observed double, p_value double, null_mean double, null_std double, low double, high double")
    tables = {name: stored(store, f"predictions-{name}", sets[name]) for name in dict.fromkeys(n for p in chosen for n in p)}
    tests = [test(paired(tables[a], tables[b]), "sample_idx", ["iteration", "fold"], permutations).select(F.lit(a).alias("first"), F.lit(b).alias("second"), "*") for a, b in chosen]
    return reduce(DataFrame.unionByName, tests)
