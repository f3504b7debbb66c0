"""Stratified folds by hash, scaling and simple imputation fitted on training rows."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import numbers


def derived_seed(*parts: int | str) -> int:
    """A seed of 31 bits for a role: from the master seed, iteration, fold and the role's name."""
    text = "/".join(map(str, parts)).encode()
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little") & 0x7FFFFFFF


def stratified(df: DataFrame, key: str, label: str, folds: int, seed_text: str = "42") -> DataFrame:
    """``df`` with fold, from 0: each label's rows dealt in turn in the order of a hash of their key."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed_text}")))
    return _dealt(numbers.by_hash(df, [label], order, [key], "fold"), folds)


def repeated(df: DataFrame, key: str, label: str, folds: int, repeats: int) -> DataFrame:
    """The same, dealt anew for each repeat, from 0."""
    many = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.col("repeat").cast("string")))
    return _dealt(numbers.by_hash(many, ["repeat", label], order, [key], "fold"), folds)


def _dealt(numbered: DataFrame, folds: int) -> DataFrame:
    return numbered.withColumn("fold", ((F.col("fold") - 1) % folds).cast("int"))


def standardise(df: DataFrame, column: str, folds: int) -> DataFrame:
    """(…, test_fold, scaled): every row scaled as in each fold, by mean and population deviation of its training rows.

    Each fold gives count, mean and variance once; those of a training set are
    merged from its folds', around their common mean, so that large values lose no
    digits. A deviation of zero counts as one.
    """
    x = F.col(column).cast("double")
    per = df.groupBy("fold").agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).filter("n > 0")
    tests = df.sparkSession.range(folds).select(F.col("id").cast("int").alias("test_fold"))
    sets = tests.join(F.broadcast(per), F.col("fold") != F.col("test_fold"), "left")  # folds by folds
    train = sets.groupBy("test_fold").agg(F.sum("n").alias("n"), F.collect_list(F.struct("n", "m", "v")).alias("parts"))
    first = F.col("parts")[0]["m"]
    mean = first + F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["n"] * (p["m"] - first)) / F.col("n")
    around = train.withColumn("m", mean)
    spread = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["n"] * (p["v"] + (p["m"] - F.col("m")) * (p["m"] - F.col("m"))))
    stats = around.select("test_fold", "m", F.sqrt(spread / F.col("n")).alias("d"))
    grid = df.withColumn("test_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    scaled = (x - F.col("m")) / F.when(F.col("d") > 0, F.col("d")).otherwise(1.0)
    return grid.join(F.broadcast(stats), "test_fold").withColumn("scaled", scaled).drop("m", "d")


def impute(df: DataFrame, columns: Sequence[str], how: str = "mean", by: Sequence[str] = ()) -> DataFrame:
    """Missing values replaced by the exact mean or median of the known ones, within ``by``."""
    agg = {"mean": F.avg, "median": F.median}[how]
    fills = df.groupBy(*by).agg(*[agg(F.col(c).cast("double")).alias(f"_{c}") for c in columns])
    joined = df.join(fills, list(by)) if by else df.crossJoin(F.broadcast(fills))  # one row
    return joined.select(*[F.coalesce(F.col(c).cast("double"), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])
