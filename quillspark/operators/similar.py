"""Names that say nearly the same, by their words, before anyone is asked to merge what they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import held

#: Percent of the words of two names together that both must have.
PERCENT = 80


def word_sets(df: DataFrame, name: str) -> DataFrame:
    """(words, name, n): the distinct sets of lower-cased words, each with its first name; names without a word are left out."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != "")))
    named = df.select(F.col(name).alias("name"), words.alias("words")).filter("size(words) > 0")
    return named.groupBy("words").agg(F.min("name").alias("name"), F.size("words").alias("n"))


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b), a < b: names whose sets have 100 * intersection >= percent * union.

    Words are ordered from the rarest. Two such sets share one of the first
    n - ceil(percent n / 100) + 1 words of each, so only names that do are compared,
    and a frequent word brings together only sets of frequent words.
    """
    each = sets.select("name", "n", F.explode("words").alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("often"))
    kept = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ordered = each.join(often, "word").groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("o"))
    first = held(ordered.select("name", "n", F.transform("o", lambda x: x["word"]).alias("words")).withColumn("first", F.explode(F.slice("words", F.lit(1), kept.cast("int")))), "name-prefixes")
    a, b = (first.select("first", *[F.col(c).alias(f"{c}_{s}") for c in ("name", "n", "words")]) for s in "ab")
    near = a.join(b, "first").filter("name_a < name_b").filter((F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent))
    shared = F.size(F.array_intersect("words_a", "words_b"))
    return near.filter(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b); the component is its smallest node.

    In each round a node takes the least label around it, and then its label's label,
    so that labels travel ever farther; rounds end when none changes.
    """
    both = held(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "edges")
    labels = held(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("least"))
        taken = labels.join(around, "a").select("a", F.least("label", "least").alias("label"), F.col("label").alias("before"))
        jumped = taken.join(labels.select(F.col("a").alias("label"), F.col("label").alias("next")), "label", "left")
        fresh = held(jumped.select("a", F.least("label", F.coalesce("next", "label")).alias("label"), "before"), "labels")
        labels = fresh.select("a", "label")
        if fresh.filter("label <> before").isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))


def clusters(df: DataFrame, name: str = "feature_name", percent: int = PERCENT) -> DataFrame:
    """(name, cluster) of every distinct name: the first name of those that similar ones link it with, itself if none does.

    A null name is left out; one without a word is a cluster of its own.
    """
    names = df.select(name).filter(F.col(name).isNotNull()).distinct()
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != "")))
    sets = held(word_sets(names, name), "word-sets")
    groups = components(links(sets, percent))
    first = sets.join(groups, F.col("name") == F.col("node"), "left").select("words", F.coalesce("component", "name").alias("cluster"))
    return names.withColumn("words", words).join(first, "words", "left").select(name, F.coalesce("cluster", name).alias("cluster"))
