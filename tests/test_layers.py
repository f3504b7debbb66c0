"""Definitions, experts, checkpoints, models and permutation pairs on small hand-made cases."""

import json
import sys

import numpy as np
import pytest

from pyspark import cloudpickle

from quillspark import config
from quillspark.operators import definition, expert, extract, models, nested, permutation, reports, specs
from quillspark.sources import checkpoints

# The workers can't import this module; its classes travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Script:
    """Answers in turn, and remembers what it was asked."""

    def __init__(self, *replies):
        self.replies, self.asked = list(replies), []

    def complete(self, prompt):
        self.asked.append(prompt)
        return self.replies.pop(0)


@pytest.fixture
def notes(spark):
    return spark.createDataFrame([(i, f"note {i} of the ward") for i in range(25)], "row_idx long, text string")


def test_a_conversation_reads_notes(notes):
    call = '<TOOL>{"name": "get_note", "parameters": {"index": 3}}</TOOL>'
    bad = '<TOOL>{"name": "get_note", "parameters": {"index": 99}}</TOOL><TOOL>no json</TOOL>'
    final = '<JSON>[{"feature_name": "ward", "description": "d"}, {"feature_name": "ward"}]</JSON>'
    backend = Script(call, bad, "no list", final)
    got, log = definition.propose(notes, backend, "notes", "outcome")
    assert [(r.feature_name, r.description) for r in got.collect()] == [("ward", "d")]
    assert [x["kind"] for x in log] == ["reply", "tool", "reply", "tool", "tool", "reply", "reply"]
    assert "note 3 of the ward" in backend.asked[1] and "KeyError" in backend.asked[2] and "JSONDecodeError" in backend.asked[2]
    with pytest.raises(RuntimeError):
        definition.converse(Script(*[call] * 3), "p", {"get_note": lambda index: ""}, rounds=3)


def test_reviews_combine_as_tables_do(spark):
    raw = [{"feature_name": n, "description": n, "instructions": "i", "status": "kept"} for n in ("a", "b", "c")]
    review = [{"feature_name": "a", "status": "drop"}, {"feature_name": "b", "status": "edited", "description": "B"}, {"feature_name": "x", "status": "new", "description": "X"}, {"feature_name": "y", "status": "drop"}, {"status": "new"}]
    got = {f["feature_name"]: (f["description"], f["instructions"], f["status"]) for f in definition.combine(raw, review)}
    assert got == {"a": ("a", "i", "dropped"), "b": ("B", "i", "edited"), "c": ("c", "i", "kept"), "x": ("X", None, "new")}
    tables = specs.merge_status(spark.createDataFrame([(f["feature_name"], f["description"], f["instructions"]) for f in raw], "feature_name string, description string, instructions string"), spark.createDataFrame([(r.get("feature_name"), r["status"], r.get("description"), None) for r in review], "feature_name string, status string, description string, instructions string"))
    assert {r.feature_name: (r.description, r.instructions, r.status) for r in tables.collect()} == got


class Flaky:
    """No usable reply for a batch that holds the given note."""

    def __init__(self, note):
        self.note = note

    def complete(self, prompt):
        features = json.loads(prompt.partition("<FEATURES>")[2].partition("</FEATURES>")[0])
        shown = json.loads(prompt.partition("<NOTES>")[2].partition("</NOTES>")[0])
        if self.note in shown:
            return "sorry"
        return json.dumps([]) if not features else "```\n" + json.dumps([{"feature_name": f["feature_name"], "status": "edited", "description": f"{f['description']}{sum(bool(t) for t in shown)}"} for f in features]) + "\n```"


def test_alignment_is_a_fold_that_resumes(spark, notes):
    dealt = specs.chunks(notes, ["row_idx"], 2, 10).select("row_idx", "text", "chunk", "batch")
    start = [{"feature_name": "f", "description": ""}]
    whole = definition.align(dealt, start, Flaky("note 24 of the ward"))
    last = {r.chunk: r.description for r in definition.last_state(whole).collect()}
    assert last == {0: "103", 1: "10"}  # 13 notes; 12, of which the last batch gives nothing
    first = spark.createDataFrame(whole.filter("batch = 0").collect(), definition.STATE)
    again = definition.align(dealt, start, Flaky("note 24 of the ward"), done=first)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))


def test_chunks_merge_with_tries(spark):
    states = spark.createDataFrame([(1, "a", "A1", "i", "aligned"), (0, "a", "A0", "i", "aligned"), (0, "b", "B", None, "dropped"), (1, "c", "C", None, "new")], "chunk int, feature_name string, description string, instructions string, status string")
    assert sorted((r.feature_name, r.description, r.n_chunks) for r in definition.union_of_chunks(states).collect()) == [("a", "A0", 2), ("c", "C", 1)]
    backend = Script("no", '<JSON>[{"feature_name": "ac"}]</JSON>')
    assert [r.feature_name for r in definition.merge(states, backend).collect()] == ["ac"] and "Chunk 1: " in backend.asked[0]
    with pytest.raises(ValueError):
        definition.merge(states, Script(*["no"] * 5))


class Report:
    def complete(self, prompt):
        if "PNI" in prompt:
            return 'Here: {"PNI": "Present", "surgical_margin": "Positive at apex"} as asked'
        return json.dumps({"left_apex_lateral_percent_involved": "30", "left_apex_lateral_gleason_pattern": "4+3", "left_apex_lateral_histology": "Adenocarcinoma", "right_mid_medial_percent_involved": 10, "TNM_N": None}) if "good" in prompt else "nothing"


def test_expert_features_from_notes(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "row_idx long, text string")
    got = {r.row_idx: r for r in expert.with_derived(expert.extract(df, Report())).collect()}
    assert len(got[1]) == 1 + 43 + 58
    assert (got[1].left_apex_lateral_gleason_grade, got[1].left_apex_lateral_primary, got[1].gleason_four_five, got[1].max_gleason_grade) == (3, 4, 3.0, 3)
    assert (got[1].percent_involved_mean, got[1].percent_involved_max, got[1].bilateral, got[1].PNI) == (20.0, 30.0, 1, 1)
    assert round(got[1].percent_pos_regions, 3) == 66.667 and round(got[1].percent_pos_cores, 3) == 16.667
    assert got[2].percent_involved_mean is None and got[2].bilateral == 0 and got[3].PNI == 1


def test_embeddings_in_parts_go_on_where_they_ended(spark, tmp_path):
    store = checkpoints.Checkpoints(spark, str(tmp_path))
    rows = spark.createDataFrame([(i, "ab" * i) for i in range(20)], "k long, t string")
    calls = []

    def broken(texts):
        raise OSError("down")

    got = checkpoints.embed(rows, broken, "k", "t", 2, tries=2, wait=0.0).collect()
    assert all(r.embedding == [0.0, 0.0] and "down" in r.error for r in got) and not calls
    half = checkpoints.embed_in_parts(store, "v", rows.filter("k < 10"), lambda ts: checkpoints.hashed_vector(ts, 2), "k", "t", 2, parts=3, wait=0.0)
    assert half.count() == 10 and store.done("v") == [0, 1, 2]
    whole = checkpoints.embed_in_parts(store, "v", rows, broken, "k", "t", 2, parts=3, wait=0.0).collect()
    assert sorted(r.k for r in whole) == list(range(20)) and sum(r.error is not None for r in whole) == 10


def test_tables_are_replaced_and_states_removed(spark, tmp_path):
    store = checkpoints.Checkpoints(spark, str(tmp_path))
    store.save(spark.range(3), "t")
    assert store.save(store.load("t").limit(2), "t").count() == 2  # reads what it replaces
    store.remove("t")
    assert not store.exists("t")


@pytest.mark.parametrize("name", ["lr", "random_features", "knn", "forest", "boosting", "svm"])
def test_models_learn_a_rule(name):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    model = models.MODELS[name]().fit(x[:200], y[:200])
    assert models.rank_auc(y[200:], model.predict(x[200:])) > 0.9
    weight = models.importance_of(model)
    assert weight is None or np.abs(weight).argmax() == 0
    assert ((0 <= model.predict(x)) & (model.predict(x) <= 1)).all()


def test_a_tree_splits_exactly():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    assert models.Tree(depth=1, leaf=1).fit(x, np.array([0.0, 0.0, 1.0, 1.0])).predict(np.array([[1.4], [1.6]])).tolist() == [0.0, 1.0]


def test_iterative_imputer_finds_linear_columns():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((200, 3))
    whole = np.c_[a, a @ [1.0, -2.0, 0.5], rng.standard_normal(200)]
    holes = whole.copy()
    holes[rng.random(whole.shape) < 0.1] = np.nan
    at = np.isnan(holes[:, 3]) & ~np.isnan(holes[:, :3]).any(axis=1)
    for how in ({}, {"bayesian": True}, {"nearest": 3}):
        got = models.IterativeImputer(rounds=10, **how).fit(holes).transform(holes)
        assert not np.isnan(got).any() and np.abs(got[at, 3] - whole[at, 3]).mean() < 0.15


def test_candidates_that_fail_are_passed_over(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 2))
    df = spark.createDataFrame([(i, int(a > 0), float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, y int, a double, b double")
    fits = nested.nested_fits(df, "id", "y", {"ALL": ["a", "b"]}, {"knn": {"k": [0]}, "lr": {"C": [1.0]}}, 1, 3, 2)
    pred = nested.predictions(fits).collect()
    assert {r.model for r in pred} == {"lr"} and sorted(r.sample_idx for r in pred) == list(range(60))
    assert [r.feature_name for r in reports.importances(nested.weights(fits)).collect()] == ["a", "b"]


def _cells(n=3):
    rng = np.random.default_rng(8)
    rows = []
    for it in range(2):
        for fold in range(n):
            for s in range(30):
                y = int(rng.random() < 0.5)
                rows.append((it, fold, fold * 30 + s, y, float(rng.normal()), float(y + 0.8 * rng.normal())))
    return rows


def test_permutations_equal_plain_numpy(spark):
    rows = _cells()
    df = spark.createDataFrame(rows, "iteration int, fold int, sample_idx long, y_true int, s1 double, s2 double")
    got = {r.b: r.d for r in permutation.null_differences(df, "sample_idx", ["iteration", "fold"], 30).collect()}
    masks = []
    for b in range(31):
        diffs = []
        for it in range(2):
            for fold in range(3):
                own = [r for r in rows if r[:2] == (it, fold)]
                ids, y, one, two = (np.array(c) for c in list(zip(*own, strict=True))[2:])
                swap = permutation.swapped(ids, b, (it, fold)) if b else np.zeros(len(ids), bool)
                masks.append(swap)
                diffs.append(models.rank_auc(y, np.where(swap, one, two)) - models.rank_auc(y, np.where(swap, two, one)))
        assert abs(got[b] - np.mean(diffs)) < 1e-8
    # The draws are fair, and those of cells and permutations differ.
    drawn = np.array(masks[6:])
    assert abs(drawn.mean() - 0.5) < 0.03 and len({m.tobytes() for m in drawn}) == len(drawn)
    assert permutation.test(df, "sample_idx", ["iteration", "fold"], 200).first()["p_value"] < 0.01


@pytest.mark.parametrize("step", [3, 64, 1000])
def test_runs_of_scores_put_together_equal_whole_ranks(monkeypatch, step):
    monkeypatch.setattr(permutation, "CHUNK", 7)
    rng = np.random.default_rng(0)
    y, one, two, ids = rng.integers(0, 2, 400), rng.integers(0, 30, 400) / 30, rng.integers(0, 30, 400) / 30, np.arange(400)
    order = np.argsort(np.r_[one, two], kind="stable")
    score, positive, second, sample = np.r_[one, two][order], np.r_[y, y][order] == 1, np.arange(800)[order] >= 400, np.r_[ids, ids][order]

    def run(first, last):
        sweep = permutation.Sweep(20, (1, 2))
        for i in range(first, last, step):
            cut = slice(i, min(i + step, last))
            sweep.add(score[cut], positive[cut], second[cut], sample[cut])
        return sweep.total()

    middle = int(np.searchsorted(score, 0.5))
    u1, u2, p1, n1, (p, n, *_) = permutation.after(run(0, middle), run(middle, 800))
    for b in range(21):
        swap = permutation.swapped(ids, b, (1, 2)) if b else np.zeros(400, bool)
        want = [models.rank_auc(y, np.where(swap, two, one)), models.rank_auc(y, np.where(swap, one, two))]
        assert np.allclose([u1[b] / (p1[b] * n1[b]), u2[b] / ((p - p1[b]) * (n - n1[b]))], want)


def test_pairs_use_stored_predictions_and_skip_others(spark, tmp_path):
    store = checkpoints.Checkpoints(spark, str(tmp_path))
    rows = _cells()
    made = []

    def table(k):
        def make():
            made.append(k)
            return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4 + k]) for r in rows], "iteration int, fold int, sample_idx long, y_true int, y_pred double")

        return make

    sets = {"a": table(0), "b": table(1), "r": table(0)}
    for _ in range(2):
        got = permutation.all_pairs(store, sets, {"r": "rfg"}, 50, [("a", "b"), ("a", "r"), ("a", "unknown")]).collect()
        assert [(r.first, r.second) for r in got] == [("a", "b")] and got[0].observed > 0.2
    assert made == [0, 1]
    assert permutation.all_pairs(store, sets, {"r": "rfg"}, 50, []).count() == 0


def test_settings_are_checked():
    good = {"label": "y", "index": "id", "models": {"lr": {}}, "metrics": ["ROC AUC", "auc", "F1"]}
    assert config.evaluation(json.dumps(good)).metrics == ("auc", "f1")
    for bad in ({"label": "y"}, good | {"colour": 1}, good | {"metrics": ["beauty"]}):
        with pytest.raises(ValueError):
            config.evaluation(bad)


def test_replies_of_a_backend_are_bounded(notes):
    got = extract.extract(notes.limit(1), ["a"], extract.RuleBackend({"b": "x"})).collect()
    assert got[0].value is None and "keys" in got[0].error


def test_neighbour_imputer_and_classifier_equal_plain_loops():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((40, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    got = models.KNNImputer(3).fit(x).transform(x)
    for i, j in zip(*np.nonzero(np.isnan(x)), strict=True):
        near = []
        for k in range(len(x)):
            both = ~np.isnan(x[k]) & ~np.isnan(x[i])
            if both.any() and not np.isnan(x[k, j]):
                near.append((float(((x[k] - x[i])[both] ** 2).sum() * 4 / both.sum()), k))
        assert abs(got[i, j] - np.mean([x[k, j] for _, k in sorted(near)[:3]])) < 1e-12
    a, y = rng.standard_normal((30, 3)), rng.integers(0, 2, 30)
    t = rng.standard_normal((10, 3))
    for metric, p in (("euclidean", 2), ("manhattan", 1)):
        for weights in ("uniform", "distance"):
            got = models.KNNClassifier(5, weights, metric).fit(a, y).predict(t)
            for row, value in zip(t, got, strict=True):
                d = (np.abs(a - row) ** p).sum(axis=1) ** (1 / p)
                near = np.argsort(d, kind="stable")[:5]
                w = np.ones(5) if weights == "uniform" else 1 / d[near]
                assert abs(value - (w * y[near]).sum() / w.sum()) < 1e-12
