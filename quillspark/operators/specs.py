"""Nested feature specifications as rows: expand, merge, diff, prune, chunk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import numbers

#: A source of an aggregate is a name, or a JSON object with feature_name and perhaps
#: specific_subgroups; JSON files may hold either, which are read as text alike.
SPEC = "feature_name string, specific_subgroups array<string>, description string, instructions string, is_aggregated boolean, aggregated_from array<string>, status string"
SOURCE = "feature_name string, specific_subgroups array<string>"
FIELDS = ("description", "instructions")


def flatten(specs: DataFrame) -> DataFrame:
    """A row for each subgroup, named name_subgroup; null or empty subgroups keep the name.

    Sources of aggregates become flat names; a source without own subgroups takes
    those of the spec of its name. With one source or none the row is no aggregate.
    """
    base = specs.select(F.col("feature_name").alias("source_name"), F.col("specific_subgroups").alias("base_subgroups")).dropDuplicates(["source_name"])
    names = lambda name, groups: F.when(F.size(groups) > 0, F.transform(groups, lambda g: F.concat_ws("_", name, g))).otherwise(F.array(name))
    sources = specs.filter("is_aggregated").select("feature_name", F.posexplode("aggregated_from").alias("pos", "entry"))
    parsed = F.when(F.ltrim("entry").startswith("{"), F.from_json("entry", SOURCE)).otherwise(F.struct(F.col("entry").alias("feature_name"), F.lit(None).cast("array<string>").alias("specific_subgroups")))
    sources = sources.withColumn("s", parsed).select("feature_name", "pos", F.col("s.feature_name").alias("source_name"), F.col("s.specific_subgroups").alias("own"))
    sources = sources.join(base, "source_name", "left").withColumn("groups", F.coalesce("own", "base_subgroups", F.array().cast("array<string>")))
    sources = sources.withColumn("flat", names(F.col("source_name"), F.col("groups")))
    lists = sources.groupBy("feature_name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "flat"))), lambda x: x["flat"])).alias("sources"))
    flat = specs.withColumn("subgroup", F.explode_outer("specific_subgroups")).join(lists, "feature_name", "left")
    many = F.coalesce(F.size("sources"), F.lit(0)) > 1
    return flat.select(
        F.concat_ws("_", "feature_name", "subgroup").alias("feature_name"),
        "description",
        "instructions",
        (F.coalesce("is_aggregated", F.lit(False)) & many).alias("is_aggregated"),
        F.when(F.coalesce("is_aggregated", F.lit(False)) & many, F.col("sources")).alias("aggregated_from"),
    )


def merge_status(raw: DataFrame, reviewed: DataFrame, honor_drops: bool = False) -> DataFrame:
    """Specs after a review: drop, aligned, edited and new, by name.

    Edited fields overlay the raw ones where given; names that only the review has
    are added unless dropped; reviewed rows without name are skipped. Dropped specs
    stay, with status dropped, unless ``honor_drops``.
    """
    r = reviewed.filter(F.col("feature_name").isNotNull()).select("feature_name", *[F.col(f).alias(f"_{f}") for f in FIELDS], F.col("status").alias("_status"))
    both = raw.select("feature_name", *FIELDS, F.lit(True).alias("_raw")).join(r, "feature_name", "full")
    edited = F.col("_status").isin("edited", "new")
    fields = [F.when(edited | F.col("_raw").isNull(), F.coalesce(f"_{f}", f)).otherwise(F.col(f)).alias(f) for f in FIELDS]
    status = F.when(F.col("_status") == "drop", "dropped").when(F.col("_raw").isNull(), "new").when(F.col("_status").isNull(), "kept").otherwise(F.col("_status"))
    out = both.filter(F.col("_raw").isNotNull() | (F.col("_status") != "drop")).select("feature_name", *fields, status.alias("status"))
    return out.filter("status <> 'dropped'") if honor_drops else out


def status_summary(merged: DataFrame) -> DataFrame:
    return merged.groupBy("status").agg(F.count("*").alias("n_features"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(feature_name, field, old, new) of every field that differs, null-safe."""
    long = lambda df, name: df.select("feature_name", F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in FIELDS]), F.array(*FIELDS))).alias("field", name))
    return long(old, "old").join(long(new, "new"), ["feature_name", "field"]).filter("NOT (old <=> new)")


def prune(aggregates: DataFrame, alive: DataFrame) -> DataFrame:
    """Aggregates with the sources that are still alive; with one or none they go.

    ``aggregates`` has feature_name and aggregated_from (flat names), ``alive``
    feature_name.
    """
    sources = aggregates.select("feature_name", F.posexplode("aggregated_from").alias("pos", "source"))
    left = sources.join(alive.select(F.col("feature_name").alias("source")), "source", "left_semi")
    kept = left.groupBy("feature_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("aggregated_from"))
    return kept.filter(F.size("aggregated_from") > 1)


def parts(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Specs without and with sources; the flag, which then says nothing, is left out."""
    flag = F.coalesce("is_aggregated", F.lit(False))
    return specs.filter(~flag).drop("is_aggregated"), specs.filter(flag).drop("is_aggregated")


def joined(plain: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Both parts as one table again, with the flag."""
    return plain.withColumn("is_aggregated", F.lit(False)).unionByName(aggregates.withColumn("is_aggregated", F.lit(True)), allowMissingColumns=True)


def final(merged: DataFrame) -> DataFrame:
    """What a review leaves: without dropped features and without status."""
    return merged.filter("status NOT IN ('drop', 'dropped')").drop("status")


def without_removed(long: DataFrame, specs: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values and specs, both by feature_name, without the features of ``removed``."""
    gone = removed.select("feature_name")
    return long.join(gone, "feature_name", "left_anti"), specs.join(gone, "feature_name", "left_anti")


def chunks(df: DataFrame, order: Sequence[str], chunk_count: int, batch_size: int) -> DataFrame:
    """``df`` with chunk, row_idx and batch (columns so named are replaced).

    Chunks are of equal size, the first ones taking the rest; batches are of fixed size.

    Rows are numbered over the whole order without one task seeing them all, where
    its first column is a number: ranges of that are numbered each on its own.
    """
    numbered = numbers.row_numbers(df, order, "quill_row")
    n = df.agg(F.count("*").alias("quill_rows"))
    at = F.col("quill_row") - 1
    size, rest = F.floor(F.col("quill_rows") / chunk_count), F.col("quill_rows") % chunk_count
    long_rows = rest * (size + 1)
    chunk = F.when(at < long_rows, F.floor(at / (size + 1))).otherwise(rest + F.floor((at - long_rows) / F.greatest(size, F.lit(1))))
    start = F.when(at < long_rows, chunk * (size + 1)).otherwise(long_rows + (chunk - rest) * size)
    made = {"chunk": chunk.cast("int"), "row_idx": at.cast("int"), "batch": F.floor((at - start) / F.lit(batch_size)).cast("int")}
    kept = [c for c in df.columns if c not in made]
    return numbered.crossJoin(F.broadcast(n)).select(*kept, *[v.alias(k) for k, v in made.items()])  # one row
