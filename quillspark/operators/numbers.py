"""Row numbers over a whole order, or over few large groups, without one task for each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import held

#: Ranges that an order is cut into.
RANGES = 64


def in_buckets(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column | str], name: str = "row_number") -> DataFrame:
    """``df`` with the number, from 1, of each row in its group.

    ``bucket`` rises with the order, so a row's number is that in its bucket and the
    rows of lower buckets; the counts of buckets are few.
    """
    own = df.withColumn("quill_bucket", bucket)
    keys = [*by, "quill_bucket"]
    counts = own.groupBy(*keys).agg(F.count("*").alias("quill_n"))
    below = Window.partitionBy(*by).orderBy(F.col("quill_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, F.coalesce(F.sum("quill_n").over(below), F.lit(0)).alias("quill_before"))
    inside = own.withColumn("quill_inside", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    met = F.lit(True)
    for k in keys:
        met = met & inside[k].eqNullSafe(before[k])
    # A row for each bucket of each group: Spark broadcasts it if it turns out small.
    joined = inside.join(before, met)
    return joined.select(*[inside[c] for c in df.columns], (F.col("quill_inside") + F.col("quill_before")).cast("long").alias(name))


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """``df`` with the number, from 1, of each row in the whole order (ascending, nulls first).

    The first column of the order gives ranges, by its own quantiles, if it is a
    number; other orders are sorted over tasks, whose counts say where each begins.
    """
    kind = dict(df.dtypes)[order[0]]
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not kind.startswith("decimal"):
        return _sorted_numbers(df, order, name)
    cuts = df.select(F.percentile_approx(order[0], [k / RANGES for k in range(1, RANGES)], 1000)).first()[0] or []
    bucket = sum((F.coalesce(F.col(order[0]) > c, F.lit(False)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    return in_buckets(df, [], bucket, order, name)


def _sorted_numbers(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Row numbers by a sort over tasks; the sorted rows are held, so that both readings see the same."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    at = F.monotonically_increasing_id().alias("quill_at")
    rows = held(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*df.columns, at), "sorted-rows").withColumn("quill_part", F.shiftright("quill_at", 33))
    parts = rows.groupBy("quill_part").agg(F.count("*").alias("quill_n"), F.min("quill_at").alias("quill_first"))
    below = Window.orderBy("quill_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = parts.select("quill_part", "quill_first", F.coalesce(F.sum("quill_n").over(below), F.lit(0)).alias("quill_before"))
    numbered = rows.join(F.broadcast(starts), "quill_part")
    return numbered.select(*df.columns, (F.col("quill_at") - F.col("quill_first") + F.col("quill_before") + 1).cast("long").alias(name))


def by_hash(df: DataFrame, by: Sequence[str], digest: Column, ties: Sequence[str], name: str = "row_number") -> DataFrame:
    """``df`` with the number of each row in its group by a hexadecimal digest; its first digits make the buckets."""
    return in_buckets(df, by, F.substring(digest, 1, 2), [digest, *ties], name)
