"""Scores parsed from patterns, and horizontal aggregates over region columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grade group of each pair of patterns; weights of primary and secondary.
GRADES = {"3+3": 1, "3+4": 2, "4+3": 3, "4+4": 4, "3+5": 4, "5+3": 4, "4+5": 5, "5+4": 5, "5+5": 5}
PRIMARY_WEIGHT, SECONDARY_WEIGHT = 0.75, 0.25


def pattern_part(pattern: Column, part: int) -> Column:
    """Primary (1) or secondary (2) number of a leading 'a+b'; null otherwise."""
    return F.nullif(F.regexp_extract(pattern, r"^(\d+)\+(\d+)", part), F.lit("")).cast("int")


def grade(pattern: Column, histology: Column) -> Column:
    """Grade group of the exact pattern, 0 for others or other than adenocarcinoma."""
    table = F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv])
    known = F.coalesce(F.try_element_at(table, pattern), F.lit(0))
    return F.when(F.coalesce(F.contains(F.lower(histology), F.lit("adenocarcinoma")), F.lit(False)), known).otherwise(0)


def weighted_high(pattern: Column) -> Column:
    """Weighted sum of the parts of 4 and more; null unless both are known."""
    p, s = pattern_part(pattern, 1), pattern_part(pattern, 2)
    part = lambda x, w: F.when(x >= 4, x * F.lit(w)).otherwise(F.lit(0.0))
    return F.when(p.isNotNull() & s.isNotNull(), part(p, PRIMARY_WEIGHT) + part(s, SECONDARY_WEIGHT))


def row_max(columns: Sequence[Column]) -> Column:
    """Greatest of the columns, nulls skipped."""
    return F.greatest(*columns)


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the columns that are not null; null if all are."""
    known = F.filter(F.array(*[c.cast("double") for c in columns]), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(known) > 0, total / F.size(known))


def any_positive(columns: Sequence[Column]) -> Column:
    """Whether any of the columns is over 0."""
    return F.coalesce(F.exists(F.array(*columns), lambda x: F.coalesce(x > 0, F.lit(False))), F.lit(False))


def positive_share(groups: Sequence[Sequence[Column]]) -> Column:
    """Percent of the groups that hold a positive column."""
    hits = sum((any_positive(g).cast("int") for g in groups), F.lit(0))
    return hits * F.lit(100.0) / F.lit(float(len(groups)))


def bilateral(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """1 if both sides hold a positive column, else 0."""
    return (any_positive(left) & any_positive(right)).cast("int")
