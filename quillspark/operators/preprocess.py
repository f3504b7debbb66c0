"""Column profiles and preparation of feature matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_distinct, missing) of every column, from one pass."""
    n = F.count(F.lit(1)).cast("long")
    stats = [F.struct(F.lit(c).alias("column"), n.alias("n_rows"), F.countDistinct(c).alias("n_distinct"), F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias("missing")) for c in df.columns]
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def high_cardinality(df: DataFrame, share: float = 0.10) -> list[str]:
    """String columns with more distinct values than this share of the rows (strictly)."""
    texts = [c for c, t in df.dtypes if t == "string"]
    found = profile(df.select(*texts)).collect() if texts else []
    return [r["column"] for r in found if r["n_rows"] and r["n_distinct"] / r["n_rows"] > share]


def mostly_missing(df: DataFrame, share: float = 0.95) -> list[str]:
    """Columns whose share of missing values reaches ``share``."""
    return [r["column"] for r in profile(df).collect() if r["missing"] >= share]


def finite(c: Column) -> Column:
    """Null for infinite values and NaN."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def numeric(c: Column) -> Column:
    """The value as a finite double, null where it is none."""
    return finite(c.try_cast("double"))


#: Categories that a column may have: each becomes a column.
MOST_CATEGORIES = 10_000


def categories(df: DataFrame, column: str, most: int = MOST_CATEGORIES) -> list:
    """Sorted distinct values, which reach the driver; raises ValueError if there are more than ``most``."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"column {column} has over {most} categories")
    return found


def one_hot(df: DataFrame, column: str, values: Sequence, keep: Sequence[str]) -> DataFrame:
    """0/1 columns of all values but the first; a null is 0 in all."""
    hot = [F.when(F.col(column) == v, 1.0).otherwise(0.0).alias(f"{column}_{v}") for v in list(values)[1:]]
    return df.select(*keep, *hot)


def preprocess(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drops high-cardinality texts, codes the other texts, drops mostly missing columns, makes all finite doubles."""
    out = df.drop(*[c for c in high_cardinality(df) if c not in keep])
    for c in [c for c, t in out.dtypes if t == "string" and c not in keep]:
        out = one_hot(out, c, categories(out, c), [x for x in out.columns if x != c])
    out = out.drop(*[c for c in mostly_missing(out) if c not in keep])
    return out.select(*[c for c in out.columns if c in keep], *[numeric(F.col(c)).alias(c) for c in out.columns if c not in keep])


def drop_columns(df: DataFrame, names: Sequence[str], prefix: str = "Unnamed") -> DataFrame:
    """Without the named columns that exist and those of a prefix."""
    return df.drop(*[c for c in df.columns if c in names or c.startswith(prefix)])


def combine(sets: Sequence[DataFrame], key: str) -> DataFrame:
    """Feature sets side by side on a key; every duplicate name gets _0, _1, ..., the first too."""
    names = [c for s in sets for c in s.columns if c != key]
    seen: dict[str, int] = {}
    out = None
    for s in sets:
        renamed = [F.col(key)]
        for c in s.columns:
            if c == key:
                continue
            if names.count(c) > 1:
                renamed.append(F.col(c).alias(f"{c}_{seen.get(c, 0)}"))
                seen[c] = seen.get(c, 0) + 1
            else:
                renamed.append(F.col(c))
        part = s.select(*renamed)
        out = part if out is None else out.join(part, key)
    return out


def misaligned(a: DataFrame, b: DataFrame, row: str, value: str) -> DataFrame:
    """Rows where two tables of one row index differ, or that only one has; aligned if empty."""
    both = a.select(row, F.col(value).alias("left_value"), F.lit(1).alias("_a")).join(b.select(row, F.col(value).alias("right_value"), F.lit(1).alias("_b")), row, "full")
    return both.filter("_a IS NULL OR _b IS NULL OR NOT (left_value <=> right_value)").select(row, "left_value", "right_value")


def missing_percent(long: DataFrame, feature: str = "feature_name", value: str = "value") -> DataFrame:
    """Percent of values of each feature that are null, empty or 'null', to two digits."""
    v = F.col(value).cast("string")
    gone = v.isNull() | (v == "") | (F.lower(v) == "null") | (F.lower(v) == "nan")
    return long.groupBy(feature).agg(F.round(F.lit(100.0) * F.avg(gone.cast("double")), 2).alias("missing_percent"))
