"""Feature extraction from notes, validation and the loop between them.

A backend answers prompts; without one, rules of patterns extract natively. Values
stay in long form (row_idx, feature_name, value) until the last step.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import FENCED
from . import paid

#: Rounds of the loop; validations after which a feature isn't extracted again; tries of a call.
MAX_ROUNDS, MAX_VALIDATIONS, TRIES = 6, 3, 3


class Backend(Protocol):
    """What completes a prompt; it travels to the executors, so it must be picklable."""

    def complete(self, prompt: str) -> str: ...


class RuleBackend:
    """Deterministic: answers with what patterns find in the prompt's note."""

    def __init__(self, rules: Mapping[str, str]):
        self.rules = dict(rules)

    def complete(self, prompt: str) -> str:
        note = prompt.partition("<NOTE>")[2].rpartition("</NOTE>")[0]
        found = {}
        for name, pattern in self.rules.items():
            m = re.search(pattern, note)
            found[name] = float(m[1] if m.groups() else 1) if m else None
        return f"<JSON>{json.dumps(found)}</JSON>"


class ReplayBackend:
    """Answers recorded earlier, by prompt."""

    def __init__(self, replies: Mapping[str, str]):
        self.replies = dict(replies)

    def complete(self, prompt: str) -> str:
        return self.replies[prompt]


def parse_reply(reply: str | None) -> dict:
    """The object between JSON tags, in a fence, or from the first { to the last }; raises ValueError if none."""
    text = reply or ""
    for pattern, part in ((r"<JSON>(.*?)</JSON>", text), (r"```json\s*(.*?)```", text), (FENCED, text.partition("```")[2]), (r"(\{.*\})", text)):
        if m := re.search(pattern, part, re.S):
            return json.loads(m[1])
    raise ValueError("No JSON content found")


def call(backend: Backend, prompt: str, wanted: Sequence[str] | None = None, tries: int = TRIES, wait: float = 0.0) -> tuple[dict | None, str | None]:
    """The parsed reply with exactly the wanted keys, or the last error after bounded tries."""
    error = None
    for k in range(tries):
        try:
            reply = parse_reply(backend.complete(prompt))
            if wanted is not None and set(reply) != set(wanted):
                raise ValueError(f"keys {sorted(reply)} instead of {sorted(wanted)}")
            return reply, None
        except Exception as e:  # a failed row becomes a null with its error
            error = f"{type(e).__name__}: {e}"
            time.sleep(wait * 2**k)
    return None, error


def exactly(wanted: Sequence[str]) -> Callable[[str], dict]:
    """What reads a reply's object, and raises ValueError if it hasn't exactly the wanted keys."""

    def read(reply: str) -> dict:
        got = parse_reply(reply)
        if set(got) != set(wanted):
            raise ValueError(f"keys {sorted(got)} instead of {sorted(wanted)}")
        return got

    return read


def extract_logged(notes: DataFrame, features: Sequence[str], backend: Backend, folder: str, instructions: str = "", **how) -> DataFrame:
    """The same as ``extract`` by calls that are paid for once (``paid.replies``, which takes ``how``)."""
    names = list(features)
    prompt = F.concat(F.lit(f"{instructions}\n{json.dumps(names)}\n<NOTE>"), F.coalesce("text", F.lit("")), F.lit("</NOTE>"))
    got = paid.replies(notes.select("row_idx", prompt.alias("prompt")), "prompt", backend.complete, folder, exactly(names), **how)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, reply, error in zip(b["row_idx"], b["reply"], b["error"], strict=True):
                found = parse_reply(reply) if reply is not None else {}
                rows += [(i, n, float(v) if isinstance(v := found.get(n), (int, float)) else None, error) for n in names]
            yield pd.DataFrame(rows, columns=["row_idx", "feature_name", "value", "error"])

    return got.select("row_idx", "reply", "error").mapInPandas(run, "row_idx long, feature_name string, value double, error string")


def extract(notes: DataFrame, features: Sequence[str], backend: Backend, instructions: str = "") -> DataFrame:
    """(row_idx, feature_name, value, error) for each note (row_idx, text) and feature, by the backend."""
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["row_idx"], b["text"], strict=True):
                reply, error = call(backend, f"{instructions}\n{json.dumps(names)}\n<NOTE>{text or ''}</NOTE>", names)
                for n in names:
                    v = None if reply is None else reply[n]
                    rows.append((i, n, float(v) if isinstance(v, (int, float)) else None, error))
            yield pd.DataFrame(rows, columns=["row_idx", "feature_name", "value", "error"])

    return notes.select("row_idx", "text").mapInPandas(run, "row_idx long, feature_name string, value double, error string")


def extract_native(notes: DataFrame, rules: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The long form by patterns alone: number (first group), flag or count of matches."""
    made = {
        "number": lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit("")).try_cast("double"),
        "flag": lambda p: F.col("text").rlike(p).cast("double"),
        "count": lambda p: F.regexp_count("text", F.lit(p)).cast("double"),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("feature_name"), made[kind](p).alias("value")) for n, (kind, p) in rules.items()])
    return notes.select("row_idx", F.explode(pairs).alias("f")).select("row_idx", "f.feature_name", "f.value")


def wide(long: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row a note; the list of names keeps the schema fixed and saves a pass."""
    return long.groupBy("row_idx").pivot("feature_name", list(features)).agg(F.max("value"))


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that no earlier run finished."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def decide(stats: DataFrame, counts: DataFrame, remove_at: float = 95.0, again_at: float = 50.0) -> DataFrame:
    """(feature_name, missing_percent, validation_count, decision) by rules.

    A feature that would be extracted again but was validated MAX_VALIDATIONS times
    is removed.
    """
    gone, n = F.col("missing_percent"), F.coalesce("validation_count", F.lit(0))
    decision = F.when(gone >= remove_at, "remove").when((gone >= again_at) & (n >= MAX_VALIDATIONS), "remove").when(gone >= again_at, "reextract").otherwise("proceed")
    return stats.join(counts, "feature_name", "left").withColumn("decision", decision)


def validated(long: DataFrame, validator: Callable[[str, pd.Series], tuple[str, str]]) -> DataFrame:
    """(feature_name, decision, reasoning) by a function of a whole column.

    A column is one group in one task: a validator reads a column as a whole.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["feature_name"].iloc[0]
        return pd.DataFrame([(name, *validator(name, pdf["value"]))], columns=["feature_name", "decision", "reasoning"])

    return long.groupBy("feature_name").applyInPandas(run, "feature_name string, decision string, reasoning string")


def aggregate_features(long: DataFrame, plans: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """One row a note with declared aggregates (max, min, mean, sum, count, any) of its features."""
    how = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum, "count": F.count, "any": lambda c: F.max(F.when(c > 0, 1).when(c.isNotNull(), 0))}
    return long.groupBy("row_idx").agg(*[how[kind](F.when(F.col("feature_name").isin(*names), F.col("value"))).alias(n) for n, (kind, names) in plans.items()])


def fixpoint(notes: DataFrame, features: Sequence[str], extractor: Callable[[DataFrame, list[str], int], DataFrame], checkpoint: Callable[[DataFrame, int], DataFrame], rounds: int = MAX_ROUNDS) -> tuple[DataFrame, dict[str, str]]:
    """Extracts and validates until nothing is pending or the rounds are over.

    Returns the long form of the features that stay and the status of each. One row
    for each feature reaches the driver a round; ``checkpoint`` writes a round's
    values and reads them back. Features still pending at the end stay.
    """
    from .preprocess import missing_percent

    spark = notes.sparkSession
    status, tries, todo = {}, dict.fromkeys(features, 0), list(features)
    out = None
    for k in range(rounds):
        if not todo:
            break
        got = checkpoint(extractor(notes, todo, k).select("row_idx", "feature_name", "value"), k)
        kept = got if out is None else out.filter(~F.col("feature_name").isin(*todo)).union(got)
        counts = spark.createDataFrame(list(tries.items()), "feature_name string, validation_count int")
        for r in decide(missing_percent(got), counts).collect():
            status[r["feature_name"]] = r["decision"]
            tries[r["feature_name"]] += 1
        todo = [n for n in todo if status.get(n) == "reextract"]
        gone = [n for n, s in status.items() if s == "remove"]
        out = kept.filter(~F.col("feature_name").isin(*gone)) if gone else kept
    return out, status
