"""Extraction that resumes: only notes that no earlier run finished are worked on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.extract import pending
from ..sources.tables import exists


def resume(spark: SparkSession, notes: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], key: str = "row_idx") -> int:
    """Appends the results of the notes missing in the table at ``path``; returns how many these were."""
    todo = pending(notes, spark.read.parquet(path), key) if exists(spark, path) else notes
    n = todo.count()
    if n:
        work(todo).write.mode("append").parquet(path)
    return n


def follow(notes: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "row_idx"):
    """The same over a stream of notes: each micro-batch is deduplicated and resumed."""

    def batch(df: DataFrame, _: int) -> None:
        resume(df.sparkSession, df.dropDuplicates([key]), path, work, key)

    return notes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
