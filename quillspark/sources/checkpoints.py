"""State that outlives a run: tables, small JSON states, finished chunks, audit rows; and embedding scans on top."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import exists

AUDIT = "kind string, key string, prompt string, response string"


class Checkpoints:
    """Tables and states by name in one folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    # -- tables

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table anew beside the former one, makes it the current one, and reads it back."""
        path = f"{name}/table={time.time_ns()}"
        df.write.parquet(f"{self.folder}/{path}")
        self.put(name, {"table": path})
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.get(name)['table']}")

    # -- states

    def put(self, name: str, value: Mapping) -> None:
        """Writes a small state; the file is complete before it takes its place."""
        fs, where = self._at(f"{name}.json")
        _, draft = self._at(f"{name}.json.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        fs.delete(where, False)
        fs.rename(draft, where)

    def get(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/{name}.json", wholetext=True).first()[0])

    def exists(self, name: str) -> bool:
        return exists(self.spark, f"{self.folder}/{name}.json")

    def remove(self, *names: str) -> None:
        for name in names:
            for path in (name, f"{name}.json"):
                fs, where = self._at(path)
                fs.delete(where, True)

    # -- chunks

    def done(self, job: str) -> list[int]:
        """Numbers of the job's finished chunks, ascending."""
        return sorted(self.get(f"{job}-chunks")["done"]) if self.exists(f"{job}-chunks") else []

    def finish(self, job: str, chunk: int) -> None:
        self.put(f"{job}-chunks", {"done": sorted({*self.done(job), chunk})})

    def progress(self, job: str, chunks: int) -> dict:
        done = self.done(job)
        return {"done": done, "left": [c for c in range(chunks) if c not in done], "percent": round(100.0 * len(done) / chunks, 2) if chunks else 100.0}

    def clean_up(self, job: str, chunks: int) -> bool:
        """Removes the job's state if every chunk is finished, and says whether it did."""
        whole = not self.progress(job, chunks)["left"]
        if whole:
            self.remove(f"{job}-chunks")
        return whole

    # -- audit

    def log(self, rows: Sequence[Mapping], name: str = "audit") -> None:
        """Appends rows (kind, key, prompt, response)."""
        self.spark.createDataFrame([tuple(r[c] for c in ("kind", "key", "prompt", "response")) for r in rows], AUDIT).write.mode("append").parquet(f"{self.folder}/{name}")

    def log_table(self, rows: DataFrame, name: str = "audit") -> None:
        """Appends the rows of a table (kind, key, prompt, response)."""
        rows.select("kind", "key", "prompt", "response").write.mode("append").parquet(f"{self.folder}/{name}")


# -- embeddings -----------------------------------------------------------------

Embedder = Callable[[list[str]], list[Sequence[float]]]


def embed(notes: DataFrame, embedder: Embedder, key: str, text: str, dims: int, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(key, embedding, error): each text's vector; zeros, with the error, after the last try.

    The embedder, any picklable function of texts, is called for a text alone, and
    again after wait, 2 wait, 4 wait … seconds.
    """

    def one(value: str | None) -> tuple[list[float], str | None]:
        error = None
        for k in range(tries):
            try:
                got = [float(x) for x in embedder([value or ""])[0]]
                if len(got) != dims:
                    raise ValueError(f"{len(got)} components instead of {dims}")
                return got, None
            except Exception as e:  # a failed text becomes zeros with its error
                error = f"{type(e).__name__}: {e}"
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
        return [0.0] * dims, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(t) for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "embedding": [v for v, _ in got], "error": [e for _, e in got]})

    kind = dict(notes.dtypes)[key]
    made = notes.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, embedding array<double>, error string")
    return made.withColumnRenamed("key", key)


def embed_in_parts(store: Checkpoints, name: str, notes: DataFrame, embedder: Embedder, key: str, text: str, dims: int, parts: int = 1, wait: float = 1.0) -> DataFrame:
    """The vectors of all notes; a part whose vectors were written is not made again.

    Notes are dealt to parts by a hash of their key, so a run that was broken off
    goes on where it ended, and keys that a finished part lacks are made at last.
    """
    path = f"{store.folder}/{name}"
    left = store.progress(name, parts)["left"]
    if left:  # the notes are read once, and each part then from its own folder
        dealt, mine = f"{path}-notes-{time.time_ns()}", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        notes.select(key, text, mine.alias("quill_part")).filter(F.col("quill_part").isin(left)).write.partitionBy("quill_part").parquet(dealt)
        own = store.spark.read.schema(notes.select(key, text, F.lit(0).alias("quill_part")).schema).parquet(dealt)
        for part in left:
            embed(own.filter(F.col("quill_part") == part), embedder, key, text, dims, wait=wait).write.mode("overwrite").parquet(f"{path}/part={part}")
            store.finish(name, part)
    made = store.spark.read.option("basePath", path).parquet(path).drop("part")
    new = notes.join(made.select(key), key, "left_anti")
    return made.unionByName(embed(new, embedder, key, text, dims, wait=wait))


def write_vectors_csv(df: DataFrame, key: str, vector: str, dims: int, path: str) -> None:
    """The vectors in order of their keys as CSV without header; the keys stay out, as readers expect."""
    df.orderBy(key).select(*[F.col(vector)[i].cast("double").alias(f"emb_{i}") for i in range(dims)]).write.mode("overwrite").csv(path)


def reduced_if_wide(df: DataFrame, key: str, vector: str, svd: Callable[[DataFrame, str, str, int], DataFrame]) -> DataFrame:
    """The vectors by ``svd`` if they have more components than there are rows, else as they are."""
    rows, dims = df.agg(F.count("*"), F.max(F.size(vector))).first()
    return svd(df, key, vector, rows) if dims is not None and dims > rows else df.select(key, F.col(vector).cast("array<double>").alias(vector))


def hashed_vector(texts: list[str], dims: int = 8) -> list[list[float]]:
    """A deterministic embedder: how often each residue of the characters' codes occurs."""
    out = []
    for t in texts:
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") % dims
        out.append(np.bincount(codes, minlength=dims).astype(float).tolist())
    return out
