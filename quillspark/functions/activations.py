"""Functions of numbers and of arrays of numbers that models are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relu(x: Column) -> Column:
    """The number, or 0 if it is less."""
    return F.when(x > 0, x).when(x.isNotNull(), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(x, F.lit(-500.0)), F.lit(500.0))))


def unit(vector: Column) -> Column:
    """The array at Euclidean length 1; unchanged if all its components are 0."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: x / F.when(length > 0, length).otherwise(1.0))
