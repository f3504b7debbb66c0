"""Views of the test tables in the roles that the operators expect."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds
from ..sources import work


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a query's files in the one that all share."""
    return f"{work.shared_folder(spark)}/quillspark-plans/{name}-{uuid.uuid4().hex}"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions to judge: labelled documents with a score in hundredths, so that ties occur."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = read(spark, sf_dir, "labels")
    y_pred = (F.col("n_chars") % 101).cast("double") / F.lit(100.0)
    rows = labels.join(docs, "doc_id").select("doc_id", F.col("quality").alias("y_true"), y_pred.alias("y_pred"))
    return folds.stratified(rows, "doc_id", "y_true", 3)


#: The same rows in SQL.
SCORED = """scored AS (
  SELECT doc_id, y_true, y_pred, ((row_number() OVER (PARTITION BY y_true ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id) - 1) % 3)::INT AS fold
  FROM (SELECT doc_id, quality AS y_true, (n_chars % 101)::DOUBLE / 100.0::DOUBLE AS y_pred FROM labels JOIN documents USING (doc_id)))"""
