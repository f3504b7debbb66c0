"""Small hand-made cases, one for each quirk."""

import contextlib
import datetime as dt
import io
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import grades, text
from quillspark.operators import cohort, decompose, extract, folds, metrics, models, numbers, permutation, preprocess, specs, vectors
from quillspark.plans import modelling, textual
from quillspark.sources import tables
from quillspark.streaming import incremental


def test_fatal_first_event_removes_the_subject(spark):
    df = spark.createDataFrame([(1, 1, "F"), (1, 2, "O"), (2, 3, "O")], "s int, at int, status string")
    got = cohort.index_event(df, ["s"], [F.col("at").asc()], F.col("status") != "F").collect()
    assert [(r.s, r.at) for r in got] == [(2, 3)]


def test_outcome_edges(spark):
    end = dt.datetime(2020, 1, 1, 12)
    events = [end, end + dt.timedelta(days=30), end + dt.timedelta(days=30, seconds=1), None]
    df = spark.createDataFrame([(i, end, e) for i, e in enumerate(events)], "i int, e timestamp_ntz, d timestamp_ntz")
    got = df.select("i", cohort.outcome_within(F.col("e"), F.col("d"), 30).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [0, 1, 0, 0]


def test_window_edges_and_null_nearest(spark):
    at = dt.datetime(2020, 6, 1)
    left = spark.createDataFrame([(1, at)], "k int, at timestamp_ntz")
    days = [-366, -365, 7, 8]
    right = spark.createDataFrame([(1, at + dt.timedelta(days=d), d) for d in days], "k int, m timestamp_ntz, d int")
    assert sorted(r.d for r in cohort.interval_join(left, right, ["k"], "at", "m", 365, 7).collect()) == [-365, 7]
    bad = spark.createDataFrame([(1, at, "12 kg"), (1, at + dt.timedelta(days=3), "80")], "k int, m timestamp_ntz, v string")
    got = cohort.nearest_within(left, bad, ["k"], "at", "m", 365, 7, ["m"]).select(F.col("v").try_cast("double")).first()
    assert got[0] is None


def test_fan_out_is_refused(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    try:
        cohort.assert_unique(df, ["k"]).collect()
        raise AssertionError("not refused")
    except Exception as e:
        assert "several rows" in str(e)


def test_grades(spark):
    df = spark.createDataFrame([("3+4", "adenocarcinoma"), ("4+3=7", "adenocarcinoma"), (None, "adenocarcinoma"), ("4+5", "benign")], "p string, h string")
    got = df.select(grades.grade(F.col("p"), F.col("h")).alias("g"), grades.weighted_high(F.col("p")).alias("w"), grades.pattern_part(F.col("p"), 1).alias("a")).collect()
    assert [tuple(r) for r in got] == [(2, 1.0, 3), (0, 3.0, 4), (0, None, None), (0, 4.25, 4)]


def test_json_places(spark):
    replies = ["a <JSON>{1}</JSON>", "```json\n{2}```", "``` [3] ```", "bare {4}", None]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    assert [r[0] for r in df.select(text.tagged_json(F.col("r"))).collect()] == ["{1}", "{2}", "[3]", None, None]


def test_missing_kinds(spark):
    df = spark.createDataFrame([("f", v) for v in (None, "", "null", "NaN", "0")], "feature_name string, value string")
    assert preprocess.missing_percent(df).first()["missing_percent"] == 80.0


def test_strict_cardinality_and_missing(spark):
    rows = [(f"v{i % 2}", f"w{i % 3}", 1.0 if i == 0 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "a string, b string, c double")
    assert preprocess.high_cardinality(df) == ["b"] and preprocess.mostly_missing(df) == ["c"]


def test_categories_are_bounded(spark):
    with pytest.raises(ValueError, match="over 3 categories"):
        preprocess.categories(spark.range(5), "id", most=3)


def test_one_hot_drops_the_first_and_zeroes_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "k int, c string")
    got = preprocess.one_hot(df, "c", preprocess.categories(df, "c"), ["k"])
    assert got.columns == ["k", "c_b"] and [r.c_b for r in got.orderBy("k").collect()] == [1.0, 0.0, 0.0]


def test_auc_ties_and_symmetry(spark):
    rows = [(1, 1, 0.9), (1, 1, 0.4), (1, 0, 0.4), (1, 0, 0.1), (1, 1, 0.7)]
    df = spark.createDataFrame(rows, "g int, y_true int, y_pred double")
    a = metrics.auc(df, ["g"]).first()["auc"]
    b = metrics.auc(df.withColumn("y_pred", -F.col("y_pred")), ["g"]).first()["auc"]
    assert round(a, 6) == 0.916667 and abs(a + b - 1) < 1e-12


def test_identical_models_have_p_one(spark):
    df = spark.createDataFrame([(i, i % 2, 0, i / 10, i / 10) for i in range(10)], "id int, y_true int, fold int, s1 double, s2 double")
    got = permutation.test(df, "id", ["fold"], 10).first()
    assert got["observed"] == 0 and got["p_value"] == 1


def test_fold_sizes(spark):
    df = folds.stratified(spark.range(101).withColumn("y", F.col("id") % 2), "id", "y", 4)
    sizes = [r["count"] for r in df.groupBy("y", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_chunks_give_the_rest_to_the_first(spark):
    got = specs.chunks(spark.range(10), ["id"], 3, 2).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in got] == [4, 3, 3]


def test_sources_are_names_or_objects(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"feature_name": "size", "specific_subgroups": ["l", "r"]}, {"feature_name": "top", "is_aggregated": true, "aggregated_from": ["size", {"feature_name": "age"}, {"feature_name": "size", "specific_subgroups": ["l"]}]}]')
    got = {r.feature_name: r for r in specs.flatten(tables.read_specs(spark, str(tmp_path / "s.json"))).collect()}
    assert got["top"].is_aggregated and got["top"].aggregated_from == ["size_l", "size_r", "age", "size_l"]
    plain, aggregates = specs.parts(specs.flatten(tables.read_specs(spark, str(tmp_path / "s.json"))))
    assert plain.count() == 2 and aggregates.count() == 1 and specs.joined(plain, aggregates).filter("is_aggregated").count() == 1


def test_row_numbers_over_ranges(spark):
    rows = [(i * 37 % 1000, i % 3) for i in range(1000)] + [(None, 1), (5, 0)]
    df = spark.createDataFrame(rows, "v int, g int").repartition(5)
    got = numbers.row_numbers(df, ["v", "g"]).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert [key(r) for r in sorted(got, key=lambda r: r.row_number)] == sorted(map(key, rows)) and sorted(r.row_number for r in got) == list(range(1, 1003))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # several tasks
    texts = df.selectExpr("CAST(v AS STRING) AS t", "v", "g")
    got = numbers.row_numbers(texts, ["t", "v", "g"]).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.t for r in sorted(got, key=lambda r: r.row_number)] == sorted((r.t for r in texts.collect()), key=lambda t: (t is not None, t)) and sorted(r.row_number for r in got) == list(range(1, len(rows) + 1))
    assert numbers.row_numbers(texts.limit(0), ["t"]).count() == 0
    assert numbers.row_numbers(df.limit(0), ["v"]).count() == 0


def test_standardise_of_large_values(spark):
    rows = [(i, i % 3, 1e9 + 0.1 * i) for i in range(90)] + [(90, 2, None)]
    got = {(r.i, r.test_fold): r.scaled for r in folds.standardise(spark.createDataFrame(rows, "i int, fold int, x double"), "x", 3).collect()}
    for t in range(3):
        x = np.array([v for i, f, v in rows if f != t and v is not None])
        for i, _, v in rows[:90]:
            assert abs(got[i, t] - (v - x.mean()) / x.std()) < 1e-4


def test_votes_of_string_labels(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "z"), (2, "c")], "q long, label string")
    assert {r.q: r.vote for r in vectors.vote(df, "label").collect()} == {1: "b", 2: "c"}


def test_fences_with_a_language(spark):
    replies = ["so ```text\n{1}\n```", "```\n[2]```", "``` {3} ```", "```python\nx```{4}```", "```a very long line that is no language\n{5}```", "```{6}\n```"]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    assert [r[0] for r in df.select(text.tagged_json(F.col("r"))).collect()] == ["{1}", "[2]", "{3}", None, None, "{6}"]
    assert extract.parse_reply('so ```text\n{"a": 1}\n```') == {"a": 1}


def test_stems(spark):
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal", "triplicate": "triplic", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil"}
    assert {w: text.stem(w) for w in known} == known and text.stem("é") == "é"
    df = spark.createDataFrame([(["hopping", None, "ponies"],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(text.stemmed(F.col("w"))).collect()] == [["hop", None, "poni"], None]


def test_flatten_is_idempotent(spark):
    df = spark.createDataFrame([("a", ["x", "y"], "d", "i", False, None, None)], specs.SPEC)
    once = specs.flatten(df).withColumn("specific_subgroups", F.lit(None).cast("array<string>")).withColumn("aggregated_from", F.lit(None).cast("array<string>"))
    assert sorted(r.feature_name for r in specs.flatten(once).collect()) == ["a_x", "a_y"]


def test_backend_extraction_and_fixpoint(spark):
    notes = spark.createDataFrame([(0, "age 71"), (1, "age 50 mass"), (2, None)], "row_idx long, text string")
    backend = extract.RuleBackend({"age": r"age (\d+)", "mass": r"mass"})
    got = extract.extract(notes, ["age", "mass"], backend)
    assert sorted((r.row_idx, r.feature_name, r.value) for r in got.collect() if r.value is not None) == [(0, "age", 71.0), (1, "age", 50.0), (1, "mass", 1.0)]
    long, status = extract.fixpoint(notes, ["age", "mass"], lambda n, f, k: extract.extract(n, f, extract.RuleBackend({x: backend.rules[x] for x in f})), lambda df, k: df)
    assert status == {"age": "proceed", "mass": "remove"} and {r.feature_name for r in long.collect()} == {"age"}


def test_imputers_leave_known_cells():
    x = np.random.default_rng(0).random((30, 4))
    holes = x.copy()
    holes[::5, 1] = np.nan
    for make in models.IMPUTERS.values():
        out = make().fit(holes).transform(holes)
        assert np.allclose(out[~np.isnan(holes)], x[~np.isnan(holes)]) and not np.isnan(out).any()


def test_svd_embeddings_span_the_left_singular_vectors(spark):
    x = np.random.default_rng(1).random((40, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = np.array([r.embedding for r in decompose.vector_embeddings(df, "id", "v", 3).orderBy("id").collect()])
    u = np.linalg.svd(x, full_matrices=False)[0][:, :3]
    assert np.allclose(got @ got.T, u @ u.T, atol=1e-8)


def test_csv_versions_and_resume(spark, tmp_path):
    (tmp_path / "n.csv").write_text('id,note\n1,"a, ""b""\nc"\n2,d\n')
    notes = tables.read_notes(spark, str(tmp_path / "n.csv"), "id", "note")
    assert [r.text for r in notes.orderBy("row_idx").collect()] == ['a, "b"\nc', "d"]
    tables.write_versioned(notes, str(tmp_path), "t", stamp="1")
    tables.write_versioned(notes.filter("row_idx = 2"), str(tmp_path), "t", stamp="2")
    assert tables.read_latest(spark, str(tmp_path), "t").count() == 1
    out = str(tmp_path / "done")
    assert incremental.resume(spark, notes.filter("row_idx = 1"), out, lambda d: d) == 1
    assert incremental.resume(spark, notes, out, lambda d: d) == 1 and spark.read.parquet(out).count() == 2


def test_specs_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x"], "d", "i", True, ["b", '{"feature_name":"c"}'], None)], specs.SPEC)
    tables.write_specs(df, str(tmp_path / "s"))
    assert spark.read.schema(specs.SPEC).json(str(tmp_path / "s")).collect() == df.collect()


def test_model_queries_use_every_row_and_column(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    ids = np.r_[0:30, 390:430, 5000:5050]
    v, digit = rng.standard_normal((len(ids), 64)).astype(np.float32), rng.integers(0, 10, len(ids))
    rows = [(int(i), r.tolist(), int(c)) for i, r, c in zip(ids, v, digit, strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("lr_predict", "random_features", "svd_impute"):
        got = modelling.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(r.sample_idx for r in got) == ids.tolist() and all(0 <= r.y_pred <= 1 for r in got)
        assert {r.fold for r in got} == {0, 1, 2} and [r.y_true for r in sorted(got, key=lambda r: r.sample_idx)] == (digit < 5).astype(int).tolist()
    assert [len(c) for c in modelling._VARIANTS.values()] == [5, 64]


def test_ngrams_to_five_words_with_all_counts_and_weights(spark, tmp_path):
    texts = ["The cat sat on the mat, a cat!", "the cat sat on the mat", "x y z", None, "dogs run far"]
    rng = np.random.default_rng(6)
    texts += [" ".join(f"w{i}" for i in rng.integers(0, 3000, 200)) for _ in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, t in enumerate(texts):
        w = [x for x in "".join(c for c in (t or "").lower() if c.isalnum() or c.isspace()).split() if len(x) > 1]
        want[i] = Counter(" ".join(w[a : a + n]) for n in range(1, 6) for a in range(len(w) - n + 1))
    got = textual.QUERIES["ngram_counts_all"](spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, t, n) for i, c in want.items() for t, n in c.items())
    total = sum(want.values(), Counter())
    top = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:10_000]
    assert len(total) > 10_000 and [tuple(r) for r in textual.QUERIES["vocab_topk_all"](spark, str(tmp_path)).collect()] == top
    df = Counter(t for c in want.values() for t in c)
    weights = {}
    for i, c in want.items():
        raw = {t: c[t] * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, _ in top if t in c}
        length = math.sqrt(sum(x * x for x in raw.values()))
        weights |= {(i, t): x / length for t, x in raw.items()}
    found = {(r.doc_id, r.term): r.weight for r in textual.QUERIES["tfidf_weights_all"](spark, str(tmp_path)).collect()}
    assert found.keys() == weights.keys() and all(abs(found[k] - x) < 1e-9 for k, x in weights.items())


def test_nearest_readings_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(12)
    hour = np.timedelta64(3600, "s")
    t0 = np.datetime64("2020-01-01T00:00:00")
    left = [(int(k), i, (t0 + int(h) * hour).item()) for i, (k, h) in enumerate(zip(rng.integers(0, 6, 80), rng.integers(0, 24 * 40, 80), strict=True))] + [(1, 900, None), (None, 901, t0.item())]
    right = [(int(k), (t0 + int(h) * hour).item(), int(t), None if t == 3 else float(t)) for k, h, t in zip(rng.integers(0, 6, 300), rng.integers(0, 24 * 40, 300), rng.integers(0, 4, 300), strict=True)] + [(2, None, 0, 1.0), (None, t0.item(), 0, 1.0)]
    a = spark.createDataFrame(left, "k int, i int, at timestamp_ntz")
    b = spark.createDataFrame(right, "k int, m timestamp_ntz, t int, v double")
    for before, after in ((5, 2), (0, 0), (1, 0), (0, 3), (100, 100)):
        pairs = cohort.interval_join(a, b, ["k"], "at", "m", before, after)
        want = cohort.first_by(pairs, ["i"], [F.abs(F.datediff("m", "at")).asc(), F.col("m").asc(), F.col("t").asc(), F.col("v").asc()])
        got = cohort.nearest_within(a, b, ["k"], "at", "m", before, after, ["t", "v"])
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0


def test_a_nearest_reading_is_found_by_one_sort(spark):
    t0 = dt.datetime(2020, 1, 1)
    left = spark.createDataFrame([(1, t0 + dt.timedelta(days=3)), (1, t0 + dt.timedelta(days=3)), (1, t0), (2, t0)], "k int, at timestamp_ntz")
    right = spark.createDataFrame([(1, t0 + dt.timedelta(days=d, hours=h), h) for d in (1, 2, 4) for h in (5, 2, 2)], "k int, m timestamp_ntz, h int")
    near = cohort.nearest_within(left, right, ["k"], "at", "m", 10, 10, ["h"])
    with contextlib.redirect_stdout(io.StringIO()) as said:
        near.explain()
    branch = said.getvalue().split("\n   +- ")[0]  # rows with no reading on their window's first day
    assert branch.count("Sort [") == 1 == branch.count("Exchange hashpartitioning") and "SortAggregate" not in branch
    assert sorted((r.at, r.m) for r in near.collect()) == [(t0, t0 + dt.timedelta(days=1, hours=2)), *[(t0 + dt.timedelta(days=3), t0 + dt.timedelta(days=2, hours=2))] * 2]
