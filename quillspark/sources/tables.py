"""Readers and writers of notes, features, embeddings, specifications and results."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.preprocess import drop_columns
from ..operators.specs import SPEC

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with header, quoted line feeds and doubled quotes; types inferred unless given."""
    reader = spark.read.options(**_CSV)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_notes(spark: SparkSession, path: str, index: str, text: str) -> DataFrame:
    """(row_idx, text) from a CSV; row_idx is the note's own key."""
    return read_csv(spark, path).select(F.col(index).cast("long").alias("row_idx"), F.col(text).cast("string").alias("text"))


def read_structured(spark: SparkSession, path: str, label: str, index: str, notes: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Features and labels, each with the index column."""
    df = read_csv(spark, path)
    return drop_columns(df, [label, *([notes] if notes else [])]), df.select(index, F.col(label).cast("int").alias(label))


def read_generated(spark: SparkSession, path: str, label: str, index: str, notes: str) -> DataFrame:
    """Generated features with the index, without unnamed, label and note columns."""
    return drop_columns(read_csv(spark, path), [label, notes])


def read_embeddings_csv(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(line_key, embedding) from CSV files without header; the key is the line's number, from 0, over the files by name.

    A file is read by one task, unsplit, so a line's number in it doesn't change with
    the size of splits. Parquet with a key is the better home for many vectors.
    """
    names = [f"emb_{i}" for i in range(dims)]
    rows = spark.read.schema(", ".join(f"{n} double" for n in names)).option("multiLine", True).csv(path)
    lines = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.array(*names).alias("embedding"))
    lines = lines.withColumn("inside", F.row_number().over(Window.partitionBy("file").orderBy("at")))
    below = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    before = lines.groupBy("file").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
    return lines.join(F.broadcast(before), "file").select((F.col("inside") + F.col("before") - 1).cast("long").alias("line_key"), "embedding")


def read_all(spark: SparkSession, paths: Mapping[str, tuple[str, Callable[[SparkSession, str], DataFrame]]]) -> dict[str, DataFrame]:
    """Lazy tables by name; sources whose path doesn't exist are left out."""
    return {name: reader(spark, path) for name, (path, reader) in paths.items() if exists(spark, path)}


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Specifications from JSON files: lists, or an object a line, as ``write_specs`` writes them."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    one_a_line = first is not None and first["value"].strip().startswith("{") and first["value"].strip().endswith("}")
    return spark.read.schema(SPEC).option("multiLine", not one_a_line).json(path)


def write_specs(specs: DataFrame, path: str) -> None:
    specs.write.mode("overwrite").json(path)


def write_versioned(df: DataFrame, folder: str, name: str, fmt: str = "parquet", stamp: str | None = None) -> str:
    """Writes folder/name/version=stamp and returns it; ``read_latest`` finds the newest."""
    path = f"{folder}/{name}/version={stamp or time.strftime('%Y%m%d%H%M%S')}"
    df.write.mode("errorifexists").format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)
    return path


def read_latest(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """The rows of the greatest version; the others aren't read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    latest = max(s.getPath().getName() for s in found if s.getPath().getName().startswith("version="))
    return spark.read.format(fmt).options(**({"header": True, "inferSchema": True} if fmt == "csv" else {})).load(f"{folder}/{name}/{latest}")


def write_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Creates or replaces a table of the session's catalog, its files in the warehouse or at ``path``."""
    (df.write.option("path", path) if path else df.write).mode("overwrite").saveAsTable(name)


def write_results(df: DataFrame, path: str) -> None:
    """A result table as CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_generated(df: DataFrame, folder: str, notes: str, stamp: str | None = None) -> str:
    """Generated features, without the notes that they are of, as a CSV of the day; returns where."""
    return write_versioned(drop_columns(df, [notes]), folder, "generated_features", "csv", stamp or time.strftime("%m%d"))


def write_summary(spark: SparkSession, values: Mapping, path: str) -> None:
    """A run's settings and figures as one JSON line."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def embeddings_with_zeros(keys: DataFrame, vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """Every key's vector, zeros where none was made."""
    zeros = F.array_repeat(F.lit(0.0), dims)
    return keys.select(key).join(vectors.select(key, vector), key, "left").select(key, F.coalesce(vector, zeros).alias(vector))


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Names of the numeric columns but for ``exclude``."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if c not in exclude and (t in kinds or t.startswith("decimal"))]
