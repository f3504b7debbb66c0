"""Specifications on small hand-made cases."""

from pyspark.sql import functions as F

from quillspark.operators import specs as S
from quillspark.sources import tables

SPECS = [
    ("size", ["left", "right"], "Size", "in mm", False, None, None),
    ("smoker", None, "Smoker", "yes or no", False, None, None),
    ("stage", [], "Stage", "roman", None, None, None),
    ("max_size", None, "Largest", "max", True, ["size"], None),
    ("side_size", None, "One side", "max", True, ['{"feature_name": "size", "specific_subgroups": ["left"]}'], None),
    ("risk", ["high"], "Risk", "count", True, ["smoker", '{"feature_name": "size", "specific_subgroups": ["right"]}', "stage"], None),
]
REVIEW = [("size", "drop", None, None), ("smoker", "edited", "Smokes now", None), ("stage", "aligned", "ignored", None), ("bmi", "new", "BMI", "kg/m2"), ("old", "drop", "x", None), ("odd", "unknown", "Odd", None), (None, "new", "nameless", None)]


def test_subgroups_become_names(spark):
    flat = S.flatten(spark.createDataFrame(SPECS, S.SPEC))
    got = {r.feature_name: (r.is_aggregated, r.aggregated_from) for r in flat.collect()}
    plain = dict.fromkeys(("size_left", "size_right", "smoker", "stage", "side_size"), (False, None))
    assert got == plain | {"max_size": (True, ["size_left", "size_right"]), "risk_high": (True, ["smoker", "size_right", "stage"])}


def test_reviews_merge(spark):
    raw = spark.createDataFrame(SPECS, S.SPEC).filter("feature_name in ('size', 'smoker', 'stage', 'risk')")
    merged = S.merge_status(raw, spark.createDataFrame(REVIEW, "feature_name string, status string, description string, instructions string"))
    assert {tuple(r) for r in merged.collect()} == {
        ("size", "Size", "in mm", "dropped"), ("smoker", "Smokes now", "yes or no", "edited"), ("stage", "Stage", "roman", "aligned"),
        ("risk", "Risk", "count", "kept"), ("bmi", "BMI", "kg/m2", "new"), ("odd", "Odd", None, "new"),
    }
    assert [tuple(r) for r in S.diff(raw, merged).collect()] == [("smoker", "description", "Smoker", "Smokes now")]


def test_aggregates_need_two_sources(spark):
    aggregates = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["y", "z"]), ("c", ["y"])], "feature_name string, aggregated_from array<string>")
    alive = spark.createDataFrame([("x",), ("z",)], "feature_name string")
    assert [tuple(r) for r in S.prune(aggregates, alive).collect()] == [("a", ["x", "z"])]


def test_specs_of_lines_and_of_lists(spark, tmp_path):
    df = spark.createDataFrame(SPECS, S.SPEC).coalesce(1)
    tables.write_specs(df, str(tmp_path / "lines"))
    assert tables.read_specs(spark, str(tmp_path / "lines")).select(F.col("feature_name")).collect() == df.select("feature_name").collect()
    for i, text in enumerate(('[{"feature_name": "a"}, {"feature_name": "b"}]', '[\n{"feature_name":\n"a"},\n{"feature_name": "b"}]')):
        (tmp_path / f"{i}.json").write_text(text)
        assert [r.feature_name for r in tables.read_specs(spark, str(tmp_path / f"{i}.json")).collect()] == ["a", "b"]
