"""Cohorts and feature tables: index events, windows, fusion, pivots and flags.

All operators are lazy and built of DataFrame expressions. Orders always end in a
unique key, so that ties have one result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order (the optimizer cuts groups early)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def index_event(events: DataFrame, keys: Sequence[str], order: Sequence[Column], survives: Column) -> DataFrame:
    """The index event of each key, kept only if it survives.

    Survival is tested after the choice: a key whose first event fails vanishes,
    whatever its later events are.
    """
    return first_by(events, keys, order).filter(survives)


def outcome_within(end: Column, event: Column, days: int) -> Column:
    """1 if ``event`` falls after ``end`` and at most ``days`` days later, else 0, never null."""
    after, until = event > end, event <= end + F.expr(f"INTERVAL {days} DAYS")
    return F.when(event.isNotNull() & after & until, 1).otherwise(0)


def plausible(value: Column, low: float, high: float) -> Column:
    """The value, or null outside the range."""
    return F.when(value.between(low, high), value)


def celsius(value: Column, above: float = 45.0) -> Column:
    """Degrees over ``above`` are taken as Fahrenheit."""
    return F.when(value > above, (value - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)).otherwise(value)


def converted(name: Column, value: Column, factors: Mapping[str, float]) -> Column:
    """The value in the common unit that the reading's name implies; null for other names."""
    out = None
    for unit, factor in factors.items():
        scaled = value if factor == 1.0 else value * F.lit(factor)
        out = F.when(name == unit, scaled) if out is None else out.when(name == unit, scaled)
    return out


def guarded_ratio(weight: Column, height_cm: Column, weights: tuple[float, float] = (30.0, 300.0), heights: tuple[float, float] = (120.0, 220.0)) -> Column:
    """Weight by squared height in metres if both are plausible, else null."""
    ratio = F.try_divide(weight, F.pow(height_cm / F.lit(100.0), F.lit(2.0)))
    return F.when(weight.between(*weights) & height_cm.between(*heights), ratio)


def semi_reduce(fact: DataFrame, cohort: DataFrame, keys: Sequence[str], broadcast: bool = False) -> DataFrame:
    """Rows of ``fact`` whose key is in the cohort, for use below an aggregate by that key.

    ``broadcast`` is the caller's statement that the cohort's keys are of a bounded
    size; otherwise the planner chooses by its own statistics.
    """
    ids = cohort.select(*keys)
    return fact.join(F.broadcast(ids) if broadcast else ids, list(keys), "left_semi")


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, moment: str, before_days: int, after_days: int) -> DataFrame:
    """Pairs of equal keys whose ``moment`` lies from before_days before ``at`` to after_days after it."""
    low, high = F.col(at) - F.expr(f"INTERVAL {before_days} DAYS"), F.col(at) + F.expr(f"INTERVAL {after_days} DAYS")
    return left.join(right, list(keys)).filter(F.col(moment).between(low, high))


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, moment: str, before_days: int, after_days: int, ties: Sequence[str]) -> DataFrame:
    """Each left row with the right row nearest in days inside the window, by the earliest moment and then ``ties``; rows without one go.

    The nearest reading is taken even if its value is null. One sort by key and day
    holds the left rows and the readings; of a key's readings the first of each day
    counts, and windows in that same order find the last day before and the next two
    from the same day on, so a row meets three readings, however many lie in its
    window. Only where one of them lies on the window's first day, and the window
    begins within that day, are that day's readings met.
    """
    low, high = F.col(at) - F.expr(f"INTERVAL {before_days} DAYS"), F.col(at) + F.expr(f"INTERVAL {after_days} DAYS")
    order = [moment, *[c for c in ties if c != moment]]
    order += [c for c in right.columns if c not in order and c not in keys]
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)  # as in a join, null meets nothing
    readings = right.filter(F.col(moment).isNotNull()).filter(known).select(*keys, F.to_date(moment).alias("_day"), F.struct(*order).alias("_r"))
    rows = left.filter(known).select(*keys, F.to_date(at).alias("_day"), F.struct(*[c for c in left.columns if c not in keys], low.alias("_low"), high.alias("_high")).alias("_l"))
    both = rows.unionByName(readings, allowMissingColumns=True).withColumn("_kind", F.col("_r").isNotNull())
    key = Window.partitionBy(*keys).orderBy("_day", "_kind", "_r")
    again = F.lag(F.when(F.col("_kind"), F.col("_day"))).over(key).eqNullSafe(F.col("_day"))  # the row before it is a reading of that day
    first = both.select("*", F.when(F.col("_kind") & ~again, F.col("_r")).alias("_first"))
    near = [F.last("_first", True).over(key.rowsBetween(Window.unboundedPreceding, 0)).alias("_before"), *[F.expr(f"lead(_first, {n}) IGNORE NULLS").over(key).alias(c) for n, c in ((1, "_same"), (2, "_after"))]]
    seen = first.select("*", *near).filter("NOT _kind").drop("_kind", "_first", "_r", "_day")
    low_day = F.to_date("_l._low")
    edge = F.coalesce((F.col("_l._low") > low_day) & (F.coalesce(F.to_date(F.col("_before")[moment]) == low_day, F.lit(False)) | F.coalesce(F.to_date(F.col("_same")[moment]) == low_day, F.lit(False))), F.lit(False))
    inner = seen.filter(~edge).withColumn("_edge", F.lit(None).cast(readings.schema["_r"].dataType))
    outer = seen.filter(edge).withColumns({"_day": low_day, "_row": F.monotonically_increasing_id()}).join(readings, [*keys, "_day"])
    least = F.min(F.when(F.col("_r")[moment] >= F.col("_l._low"), F.col("_r"))).alias("_edge")
    outer = outer.groupBy(*keys, "_row").agg(*[F.first(c).alias(c) for c in ("_l", "_before", "_same", "_after")], least).drop("_row")
    found = [F.when(F.col(c)[moment].between(F.col("_l._low"), F.col("_l._high")), F.struct(F.abs(F.datediff(F.col(c)[moment], F.col("_l")[at])).alias("d"), F.col(c).alias("r"))) for c in ("_before", "_same", "_after", "_edge")]
    best = inner.unionByName(outer).withColumn("_b", F.array_min(F.array_compact(F.array(*found)))).filter("_b IS NOT NULL")
    return best.select(*keys, *[F.col("_l")[c].alias(c) for c in left.columns if c not in keys], *[F.col("_b.r")[c].alias(c) for c in right.columns if c not in keys])


def conditional_pivot(fact: DataFrame, keys: Sequence[str], code: str, value: str, columns: Mapping[str, tuple[str, Sequence[int]]]) -> DataFrame:
    """One row a key; each column aggregates (avg, max, min, sum) the values of its codes, in one scan."""
    how = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum}
    aggs = [how[kind](F.when(F.col(code).isin(*codes), F.col(value))).alias(name) for name, (kind, codes) in columns.items()]
    wanted = sorted({c for _, codes in columns.values() for c in codes})
    return fact.filter(F.col(code).isin(*wanted) & F.col(value).isNotNull()).groupBy(*keys).agg(*aggs)


def any_flags(fact: DataFrame, keys: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """1 for a key if any of its rows meets the condition, else 0; keys without rows have no row."""
    return fact.groupBy(*keys).agg(*[F.max(F.when(cond, 1).otherwise(0)).alias(name) for name, cond in flags.items()])


def fuse(*sources: Column) -> Column:
    """The first value that is not null, in order of priority."""
    return F.coalesce(*sources)


def concat_ordered(df: DataFrame, keys: Sequence[str], text: str, separator: str, order: str, name: str) -> DataFrame:
    """Texts of each key joined in an order, given as SQL."""
    grouped = ", ".join(keys)
    return df.sparkSession.sql(f"SELECT {grouped}, listagg({text}, '{separator}') WITHIN GROUP (ORDER BY {order}) AS {name} FROM {{notes}} GROUP BY {grouped}", notes=df)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, failing at run time if a key has several rows: a join with it can't fan out."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    checked = F.when(n > 1, F.raise_error(F.lit(f"several rows for a key of {list(keys)}"))).otherwise(F.lit(True)).cast("boolean")
    return df.withColumn("_unique", checked).filter("_unique").drop("_unique")


def star(driver: DataFrame, keys: Sequence[str], *sides: DataFrame) -> DataFrame:
    """The driver's rows with the columns of every side, by left joins on the same key.

    The joins share one partitioning of the key, so the driver is shuffled once.
    """
    out = driver
    for side in sides:
        out = out.join(side, list(keys), "left")
    return out
