"""What is counted, compared or folded grows no faster than the rows, and is still the whole."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import definition, paid, vectors


def grams(words, most):
    return Counter(" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1))


def texts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 30)))) for i in range(60)]
    return rows, spark.createDataFrame([*rows, (60, None)], "k long, words string").repartition(5)


def test_terms_are_counted_where_their_row_is(spark):
    rows, df = texts(spark)
    found = text.term_counts(df, "k", F.col("words"), 3)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {(k, t): n for k, w in rows for t, n in grams(w.split(), 3).items()}
    assert {(r.k, r.term): r.n for r in found.collect()} == want


def test_rows_that_share_a_key_are_counted_together(spark):
    rows, df = texts(spark)
    shared = df.withColumn("k", F.when(F.col("k") < 4, F.lit(None)).otherwise(F.floor(F.col("k") / 2)).cast("long"))
    want = Counter()
    for k, w in rows:
        for t, n in grams(w.split(), 2).items():
            want[None if k < 4 else k // 2, t] += n
    assert {(r.k, r.term): r.n for r in text.term_counts(shared, "k", F.col("words"), 2).collect()} == want
    vocabulary = ["a", "a b", "b", "z"]
    cells = {(r.k, vocabulary[i]): n for r in text.vocabulary_counts(shared, "k", F.col("words"), 2, vocabulary).collect() for i, n in zip(r["at"], r["w"], strict=True)}
    assert cells == {k: n for k, n in want.items() if k[1] in vocabulary}


def test_most_frequent_terms_with_ties(spark):
    rows, df = texts(spark)
    want = Counter()
    for _, w in rows:
        want += grams(w.split(), 4)
    ranked = sorted(want.items(), key=lambda r: (-r[1], r[0]))
    for size in (1, 7, 150, 100_000):
        assert text.top_terms(df.select("words"), 4, size) == ranked[:size]
    assert text.top_terms(df.select("words").limit(0), 4, 5) == []


def test_neighbours_are_chosen_by_products_and_measured_exactly():
    rng = np.random.default_rng(9)
    y = np.r_[rng.standard_normal((400, 8)) + 1e3, np.tile(rng.standard_normal(8) + 1e3, (30, 1))]
    ids = rng.permutation(len(y)).astype(np.int64)
    for metric in ("euclidean", "manhattan"):
        for i, near, d in vectors._chosen(y[:50], y, ids[:50], ids, 5, metric):
            off = np.abs(y - y[i])
            all_d = off.sum(axis=1) if metric == "manhattan" else np.sqrt((off**2).sum(axis=1))
            want = [j for j in np.lexsort((ids, all_d)) if ids[j] != ids[i]][:5]
            assert near.tolist() == want and d.tolist() == all_d[want].tolist()


def test_a_task_holds_the_replies_of_few_prompts(spark, tmp_path):
    asked = spark.range(400).selectExpr("concat('p', id) AS q")
    for _ in range(2):
        got = paid.replies(asked, "q", str.upper, str(tmp_path), wait=0.0)
        assert {(r.q, r.reply) for r in got.collect()} == {(f"p{i}", f"P{i}") for i in range(400)}
    held = [len(paid.ReplyLog(str(tmp_path), int(p.name.partition("=")[2])).read()) for p in tmp_path.iterdir()]
    assert sum(held) == 400 and max(held) <= 10


def test_chunks_are_folded_in_rounds(spark, monkeypatch):
    notes = spark.createDataFrame([(i, "ab"[i % 2] * (i % 7), i % 3, i // 6) for i in range(90)], "row_idx long, text string, chunk int, batch int")
    start, aligner = [{"feature_name": "a", "description": "a"}, {"feature_name": "b", "description": "b"}], definition.KeywordAligner({"a": "aa", "b": "bbb"}, 1, {"c": "aaaa"}, 1)
    early = definition.align(notes.filter("batch < 4"), start, aligner)
    want = sorted(map(str, definition.align(notes, start, aligner).collect()))
    calls = []
    once = definition._aligned
    monkeypatch.setattr(definition, "_aligned", lambda own, *a, **k: calls.append(own.select("batch").distinct().count()) or once(own, *a, **k))
    monkeypatch.setattr(definition, "ROUND", 3)
    assert sorted(map(str, definition.align(notes, start, aligner).collect())) == want
    assert calls == [3] * 5
    assert sorted(map(str, definition.align(notes, start, aligner, early).collect())) == want
