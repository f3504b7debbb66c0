"""Making feature definitions with a backend: propose, align with notes, merge.

A definition is (feature_name, description, instructions). Alignment is a sequential
fold: batch by batch, a chunk's notes are shown together with the definitions that the
chunk's earlier batches left. Chunks are independent; a task reads a chunk's notes in
order and holds one batch of them.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import held, shared_folder
from . import similar
from .extract import Backend, parse_reply
from .specs import FIELDS

#: Notes shown at once; tries of a batch and of a merge; rounds of a conversation with tools.
BATCH, TRIES, MERGE_TRIES, ROUNDS = 10, 3, 5, 100
#: Batches of a chunk that one task folds.
ROUND = 2_000
#: Definitions that a merge is shown at most.
MOST_SHOWN = 5_000
DEFINITION = "feature_name string, description string, instructions string"
STATE = f"chunk int, batch int, {DEFINITION}, status string"
_CALL = re.compile(r"<TOOL>(.*?)</TOOL>", re.S)
Feature = dict[str, str | None]


# -- conversations ---------------------------------------------------------------


def converse(backend: Backend, prompt: str, tools: Mapping[str, Callable[..., object]], rounds: int = ROUNDS) -> tuple[str, list[dict]]:
    """The first reply without tool calls, and the log of (kind, key, prompt, response).

    A call is {"name": ..., "parameters": {...}} between TOOL tags; its result, or
    its error, goes into the next prompt. After ``rounds`` replies it gives up.
    """
    history, log = [prompt], []
    for k in range(rounds):
        reply = backend.complete("\n".join(history))
        log.append({"kind": "reply", "key": str(k), "prompt": history[-1], "response": reply})
        calls = _CALL.findall(reply)
        if not calls:
            return reply, log
        history.append(reply)
        for text in calls:
            try:
                call = json.loads(text)
                result = str(tools[call["name"]](**call.get("parameters", {})))
            except Exception as e:  # the backend sees its mistake
                result = f"error: {type(e).__name__}: {e}"
            history.append(f"<RESULT>{result}</RESULT>")
            log.append({"kind": "tool", "key": text, "prompt": text, "response": result})
    raise RuntimeError(f"no final reply after {rounds} rounds")


def note_reader(notes: DataFrame) -> Callable[[int], str]:
    """get_note(index): the text of the note with that row_idx, by a point filter."""

    def get_note(index: int) -> str:
        found = notes.filter(F.col("row_idx") == int(index)).select("text").first()
        if found is None:
            raise KeyError(f"no note {index}")
        return found["text"] or ""

    return get_note


def propose(notes: DataFrame, backend: Backend, description: str, outcome: str, known: Sequence[str] = (), tries: int = TRIES) -> tuple[DataFrame, list[dict]]:
    """Definitions that the backend proposes after reading notes of its choice, and the log."""
    last = notes.agg(F.max("row_idx")).first()[0]
    prompt = f"Propose features of {description} that tell {outcome}. Known: {json.dumps(list(known))}. Notes 0 to {last} can be read by get_note.\nAnswer with a JSON list of definitions."
    log: list[dict] = []
    for k in range(tries):
        reply, more = converse(backend, prompt, {"get_note": note_reader(notes)})
        log += more
        try:
            found = as_features(parse_reply(reply))
            break
        except ValueError:
            if k + 1 == tries:
                raise
    rows = [(f["feature_name"], *[f.get(x) for x in FIELDS]) for f in found]
    return notes.sparkSession.createDataFrame(rows, DEFINITION).dropDuplicates(["feature_name"]), log


def as_features(reply: object) -> list[Feature]:
    """The reply's list of objects; raises ValueError if it is none."""
    if not isinstance(reply, list) or not all(isinstance(x, dict) for x in reply):
        raise ValueError("no list of features")
    return reply


# -- alignment --------------------------------------------------------------------


def alignment_prompt(notes: Sequence[str], features: Iterable[Feature], batch: int = BATCH) -> str:
    """The prompt of one batch; fewer notes are filled up with empty ones."""
    shown = [*notes[:batch], *[""] * (batch - len(notes))]
    return f"<NOTES>{json.dumps(shown)}</NOTES>\n<FEATURES>{json.dumps(list(features))}</FEATURES>\nGive each feature a status: aligned, edited, drop or new."


def combine(features: list[Feature], reviewed: Sequence[Feature]) -> list[Feature]:
    """Definitions after a review, as ``specs.merge_status`` does for tables.

    Dropped ones stay, with that status; edited fields overlay; a name that isn't
    known is new unless it is to be dropped; rows without name are skipped.
    """
    out = {f["feature_name"]: dict(f) for f in features}
    for r in reviewed:
        name, status = r.get("feature_name"), r.get("status")
        if name is None:
            continue
        if name not in out:
            if status != "drop":
                out[name] = {"feature_name": name, **{x: r.get(x) for x in FIELDS}, "status": "new"}
            continue
        if status in ("edited", "new"):
            out[name] |= {x: r[x] for x in FIELDS if r.get(x) is not None}
        out[name]["status"] = "dropped" if status == "drop" else status
    return list(out.values())


def align_batch(backend: Backend, notes: Sequence[str], features: list[Feature], tries: int = TRIES) -> list[Feature] | None:
    """The definitions after a batch; None if no try gave a list."""
    for _ in range(tries):
        try:
            return combine(features, as_features(parse_reply(backend.complete(alignment_prompt(notes, features)))))
        except ValueError:
            continue
    return None


def align(notes: DataFrame, features: Sequence[Feature], backend: Backend, done: DataFrame | None = None) -> DataFrame:
    """The definitions after each batch of each chunk: (chunk, batch, feature_name, …, status).

    ``notes`` has row_idx, text, chunk and batch (``specs.chunks``). A batch without
    a usable reply leaves the definitions as they are. ``done`` is such a result of
    an earlier run: a chunk goes on behind its last batch there.

    Chunks of over ROUND batches are folded in rounds, each by a task of its own that
    goes on behind the last one's definitions, so what a task reads is bounded; these
    rounds run while the plan is built.
    """
    if (notes.agg(F.max("batch")).first()[0] or 0) < ROUND:
        return _aligned(notes, features, backend, done)
    path = f"{shared_folder(notes.sparkSession)}/quillspark-work/rounds-{uuid.uuid4().hex}"
    dealt = notes.select("chunk", "batch", "row_idx", "text", F.floor(F.col("batch") / ROUND).cast("int").alias("round"))
    dealt.write.partitionBy("round").parquet(path)
    own = notes.sparkSession.read.schema(dealt.schema).parquet(path)
    parts, state = [], done
    for k in sorted(r["round"] for r in own.select("round").distinct().collect()):  # as many as the largest chunk needs
        new = held(_aligned(own.filter(F.col("round") == k).drop("round"), features, backend, state, anew=True), "aligned")
        parts.append(new)
        both = new if state is None else state.select(*new.columns).unionByName(new)
        state = held(both.join(both.groupBy("chunk").agg(F.max("batch").alias("batch")), ["chunk", "batch"], "left_semi").select(*new.columns), "states")
    made = reduce(DataFrame.unionByName, parts)
    return made if done is None else done.select(*made.columns).unionByName(made)


def _aligned(notes: DataFrame, features: Sequence[Feature], backend: Backend, done: DataFrame | None, anew: bool = False) -> DataFrame:
    """The same in one round; with ``anew``, without the rows of ``done``."""
    start = [{"feature_name": f["feature_name"], **{x: f.get(x) for x in FIELDS}, "status": "kept"} for f in features]
    names = ["feature_name", *FIELDS, "status"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's rows, by chunk: the earlier definitions, then its notes by batch, of which one is held."""
        chunk, batch, state, texts, last = None, None, start, [], -1

        def aligned() -> pd.DataFrame:
            nonlocal state
            state = align_batch(backend, texts, state) or state
            return pd.DataFrame([(chunk, batch, *[f[x] for x in names]) for f in state], columns=["chunk", "batch", *names])

        for part in batches:
            for r in part.replace({float("nan"): None}).itertuples(index=False):
                if r.chunk != chunk or r.batch != batch:
                    if texts:
                        yield aligned()
                    if r.chunk != chunk:
                        state, last = start, -1
                    chunk, batch, texts = r.chunk, r.batch, []
                if r.note == 0:
                    state = [*(state if last >= 0 else []), {x: getattr(r, x) for x in names}]
                    last = r.batch
                elif r.batch > last:
                    texts.append(r.text or "")
        if texts:
            yield aligned()

    own = notes.select("chunk", "batch", F.lit(1).alias("note"), "row_idx", "text", *[F.lit(None).cast("string").alias(x) for x in names])
    if done is not None:
        ends = done.groupBy("chunk").agg(F.max("batch").alias("batch"))
        earlier = done.join(ends, ["chunk", "batch"], "left_semi").select("chunk", "batch", F.lit(0).alias("note"), F.lit(None).cast("long").alias("row_idx"), F.lit(None).cast("string").alias("text"), *names)
        own = own.union(earlier)
    # A chunk's rows come to one task in the order of the fold; Spark sorts them, on disk if need be.
    order = ["chunk", F.when(F.col("note") == 0, -1).otherwise(F.col("batch")), "note", "row_idx", "feature_name"]
    new = own.repartition("chunk").sortWithinPartitions(*order).mapInPandas(fold, STATE)
    return new if done is None or anew else done.select(*new.columns).unionByName(new)


def last_state(progress: DataFrame) -> DataFrame:
    """Each chunk's definitions after its last batch, in order of chunk."""
    last = F.max("batch").over(Window.partitionBy("chunk"))
    return progress.withColumn("quill_last", last).filter("batch = quill_last").drop("quill_last", "batch").orderBy("chunk", "feature_name")


def union_of_chunks(states: DataFrame) -> DataFrame:
    """One definition for each name that a chunk kept: that of the lowest chunk, and by how many chunks."""
    kept = states.filter("status <> 'dropped'")
    return kept.groupBy("feature_name").agg(F.min_by(F.struct(*FIELDS), "chunk").alias("f"), F.count("*").alias("n_chunks")).select("feature_name", "f.*", "n_chunks")


def union_of_similar(states: DataFrame, percent: int = similar.PERCENT) -> DataFrame:
    """One definition for each cluster of similar names that chunks kept: that of the lowest chunk, and by how many chunks and names."""
    kept = states.filter("status <> 'dropped'")
    own = kept.join(similar.clusters(kept, "feature_name", percent), "feature_name")
    first = F.min_by(F.struct("feature_name", *FIELDS), F.struct("chunk", "feature_name")).alias("f")
    found = own.groupBy("cluster").agg(first, F.count_distinct("chunk").alias("n_chunks"), F.count_distinct("feature_name").alias("n_names"))
    return found.select("f.*", "n_chunks", "n_names")


def merge(states: DataFrame, backend: Backend, tries: int = MERGE_TRIES) -> DataFrame:
    """The definitions that the backend makes of all chunks', which it is shown as a whole.

    What chunks define alike is one definition before it is shown; over MOST_SHOWN are
    more than a prompt can hold, and raise ValueError.
    """
    rows = union_of_similar(states).join(states.select("chunk", "feature_name"), "feature_name").groupBy("feature_name", *FIELDS).agg(F.min("chunk").alias("chunk")).orderBy("chunk", "feature_name").limit(MOST_SHOWN + 1).collect()
    if len(rows) > MOST_SHOWN:
        raise ValueError(f"over {MOST_SHOWN} definitions to merge")
    sets: dict[int, list[Feature]] = {}
    for r in rows:
        sets.setdefault(r["chunk"], []).append({x: r[x] for x in ("feature_name", *FIELDS)})
    prompt = "\n".join(["Merge these sets of features.", *[f"Chunk {i}: {json.dumps(s)}" for i, s in enumerate(sets.values(), 1)], "Answer with a JSON list."])
    for k in range(tries):
        try:
            found = as_features(parse_reply(backend.complete(prompt)))
            return states.sparkSession.createDataFrame([(f["feature_name"], *[f.get(x) for x in FIELDS]) for f in found], DEFINITION)
        except ValueError:
            if k + 1 == tries:
                raise
    raise ValueError("no try")


class KeywordAligner:
    """Deterministic backend for alignment: judges each feature by the notes of a batch that hold its keyword.

    With ``edit_at`` notes or more the feature is edited: the count is added to its
    description; with none it is to be dropped; else it is aligned. ``new_at`` notes
    with the keyword of ``offers`` add that feature.
    """

    def __init__(self, keywords: Mapping[str, str], edit_at: int, offers: Mapping[str, str], new_at: int):
        self.keywords, self.edit_at, self.offers, self.new_at = dict(keywords), edit_at, dict(offers), new_at

    def complete(self, prompt: str) -> str:
        notes = json.loads(re.search(r"<NOTES>(.*?)</NOTES>\n<FEATURES>", prompt, re.S)[1])
        features = json.loads(re.search(r"<FEATURES>(.*)</FEATURES>", prompt, re.S)[1])
        out = []
        for f in features:
            if f["feature_name"] in self.keywords:
                n = sum(self.keywords[f["feature_name"]] in t for t in notes)
                if n >= self.edit_at:
                    out.append({"feature_name": f["feature_name"], "status": "edited", "description": f"{f['description']}+{n}"})
                else:
                    out.append({"feature_name": f["feature_name"], "status": "drop" if n == 0 else "aligned"})
        known = {f["feature_name"] for f in features}
        for name, keyword in self.offers.items():
            if name not in known and (n := sum(keyword in t for t in notes)) >= self.new_at:
                out.append({"feature_name": name, "status": "new", "description": f"seen {n}"})
        return f"```json\n{json.dumps(out)}\n```"
