"""Similar names against all pairs of them."""

import random

from quillspark.operators import definition, similar


def by_hand(names, percent):
    sets = {n: frozenset("".join(c if c.isascii() and c.isalnum() else " " for c in n.lower()).split()) for n in names}
    label = {n: n for n in names}
    changed = True
    while changed:
        changed = False
        for a in names:
            for b in names:
                both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if both and 100 * both >= percent * all_ and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_clusters_equal_those_of_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["mean", "rate", "the"] * 2
    names = {"_".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(150)} | {"Mean Rate", "rate-mean", "???", "", "!!"}
    df = spark.createDataFrame([(n,) for n in [*names, *list(names)[:9], None]], "feature_name string")
    for percent in (50, 67, 80, 100):
        got = {r.feature_name: r.cluster for r in similar.clusters(df, percent=percent).collect()}
        assert got == by_hand(sorted(names), percent)
    assert similar.clusters(df.limit(0)).count() == 0


def test_chains_are_followed_to_their_end(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y")], "a string, b string")
    got = {r.node: r.component for r in similar.components(edges).collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(61)} | {"x": "x", "y": "x"}


def test_similar_definitions_are_one(spark):
    rows = [(0, "heart_rate_mean_daily_max", "A", "i", "kept"), (1, "Heart rate, mean daily max", "B", "i", "new"), (1, "weight", "W", None, "kept"), (2, "weight", "V", None, "edited"), (2, "old", "O", None, "dropped")]
    states = spark.createDataFrame(rows, "chunk int, feature_name string, description string, instructions string, status string")
    got = {tuple(r) for r in definition.union_of_similar(states).collect()}
    assert got == {("heart_rate_mean_daily_max", "A", "i", 2, 2), ("weight", "W", None, 2, 1)}
