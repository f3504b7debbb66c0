"""What the operators share: tables in the shared folder, Arrow helpers, graph components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Broadcast a side only if its counted rows, at so many bytes each once hashed, are
#: within this bound.
BROADCAST_BYTES, HASHED_ROW_BYTES = 32 << 20, 64
#: Rows, and bytes, of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
#: Edges that a task of the components holds, about.
TASK_EDGES = 1 << 19


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of an Arrow batch, where they are higher, for rows that hold whole texts.

    The plans that operators return run later, so the setting stays: batches of
    Spark's default size hold 64 MB of texts, in each task, outside the heap.
    """
    conf = spark._jsparkSession.sessionState().conf()
    if not 0 < conf.arrowMaxRecordsPerBatch() <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if not 0 < conf.arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of our own only where none is set and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here.

    ``rows_of`` gives their number, which is observed as they are written.
    """
    path = f"{shared_dir(df.sparkSession)}/quillspark/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    (counted.coalesce(partitions) if partitions else counted).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quill_path, out._quill_rows = path, seen.get["rows"]
    return out


def rows_of(df: DataFrame) -> int:
    """The number of rows: of a materialised table without a job."""
    return df.__dict__["_quill_rows"] if "_quill_rows" in df.__dict__ else df.count()


def release(*frames: DataFrame) -> None:
    """Deletes materialised tables that no lazy result needs any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._quill_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """A materialised table with a broadcast hint if it is small enough, else as it is."""
    return F.broadcast(df) if rows_of(df) * HASHED_ROW_BYTES <= BROADCAST_BYTES else df


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch whose values in ``column`` hold about ``most`` bytes, with these.

    The batch is cut by its offsets, so only one part at a time becomes Python objects.
    """
    values = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "left")) + 1)
        stop = min(stop, len(ends))
        yield batch.slice(start, stop - start), values.slice(start, stop - start).to_pylist()
        start = stop


def dealt_by_part(df: DataFrame, parts: int) -> DataFrame:
    """Packed rows by their column part, of ``parts`` in all, which a task gets one after another.

    There are as many tasks as the session has shuffle partitions, however many parts;
    Spark sorts them, on disk if need be, so a worker holds one part at a time.
    """
    tasks = min(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, "part").sortWithinPartitions("part")


def each_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The batches of each part (the first column) in rows that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and held[0].column(0)[0].as_py() != part[a]:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def tidy() -> None:
    """Hands freed memory back to the system, which a reused Python worker would else hold."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


# -- components ------------------------------------------------------------


def least_of_component(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), ascending, and the smallest node of each one's component.

    Labels are hooked and halved for all edges at once until none changes.
    """
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        old = label
        label = label[label]
        low = np.minimum(label[x], label[y])
        for at in (old[x], old[y], x, y):
            np.minimum.at(label, at, low)
        if np.array_equal(label, old):
            return nodes, nodes[label]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges reduced to stars around the smallest node of each component.

    It holds at most some TASK_EDGES at a time; what is left of more is joined on.
    """
    a, b, n = [], [], 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        nodes, least = least_of_component(np.concatenate(a), np.concatenate(b))
        return nodes[nodes != least], least[nodes != least]

    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n > 2 * TASK_EDGES:
            x, y = reduced()
            if len(x) > TASK_EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])
                x, y = x[:0], y[:0]
            a, b, n = [x], [y], len(x)
    if n:
        x, y = reduced()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])
    tidy()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """A materialised table (node, component) of every node with an edge; component is its smallest node.

    ``edges`` has two long columns. They are dealt to tasks of
    about TASK_EDGES edges, which reduce their own to stars. If one task is enough,
    that is all; else large-star and small-star rounds, which only take minima per
    node and join them back, run until nothing changes. No group is collected.
    """
    tasks = rows_of(edges) // TASK_EDGES + 1
    dealt = edges.toDF("a", "b").repartition(tasks)
    stars = materialise(dealt.mapInArrow(_forest, "a long, b long"), name)
    while tasks > 1:
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        up = down.join(least, "a")
        step = up.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        fresh = materialise(step.distinct(), name)
        same = rows_of(fresh) == rows_of(stars) and fresh.join(stars, ["a", "b"], "left_anti").isEmpty()
        release(stars)
        stars = fresh
        if same:
            break
    found = materialise(stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct()), name)
    release(stars)
    return found


# -- MinHash in one pass ----------------------------------------------------

_M = np.uint64


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Well-spread 64-bit values of 64-bit keys (a new array)."""
    h = h ^ _M((seed * 0x9E3779B97F4A7C15 + 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> _M(32)
    h *= _M(0xD6E8FEB86659FD93)
    h ^= h >> _M(29)
    h *= _M(0xFF51AFD7ED558CCD)
    h ^= h >> _M(32)
    return h
