"""Quality rules as a short-circuit cascade of SQL expressions.

Every rule is a column expression over a text. Their cost and their selectivity
are estimated on a random sample of bounded size; the cascade then tests them in the
order of rejections per cost, and stops at a document's first failure. ``keep``
computes a rule's measures only for what the earlier rules left; ``judge`` does so
with all measures but those that it is asked to report. Only DataFrame and SQL
functions are used.

Words are runs of characters other than blank and \\t to \\r. A null text has no
words and fails the base rule; an empty table gives an empty result; other
columns, whatever their names, are carried, but for those of a reported measure or of
base_failed, rejected_by and kept, which are replaced; repeated rows are judged each
on its own.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, rows_of

#: Rows that the estimates are made on, about, and the runs of which the fastest
#: counts; they decide only the order.
SAMPLE_ROWS, RUNS = 2_000, 2
MIN_WORDS = 20
WINDOW = 8
#: Limits of the rules beyond the base rule.
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUPLICATE_LINES = 0.5
MIN_WORD_CHARS, MAX_WORD_CHARS = 2.0, 15.0
MAX_EXCLAMATIONS_PER_WORD = 0.5
SPACE = r"[ \t-\r]"


#: Helper columns and measures, each with what it is made from, in order.
_NEEDS = {
    "q_text": (),
    "q_words": ("q_text",),
    "q_lines": ("q_text",),
    "n_words": ("q_words",),
    "q_hashes": ("q_words",),
    "q_windows": ("q_hashes",),
    "q_repeats": ("q_windows",),
    "q_sorted": ("q_windows", "q_repeats"),
    "q_places": ("q_sorted",),
    "word_chars": ("q_words",),
    "n_symbols": ("q_text",),
    "n_lines": ("q_lines",),
    "n_dup_lines": ("q_lines",),
    "n_repeat_words": ("q_places",),
    "n_exclamations": ("q_text",),
}
MEASURES = tuple(k for k in _NEEDS if k.startswith(("n_", "word_")))


def _made(name: str, text: str) -> Column:
    if name == "q_text":
        return F.coalesce(F.col(text), F.lit(""))
    if name == "q_words":
        return F.filter(F.split("q_text", rf"{SPACE}+"), lambda w: w != "")
    if name == "q_lines":
        return F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    if name == "q_hashes":
        return F.transform("q_words", lambda w: F.xxhash64(w))
    if name == "q_windows":
        starts = F.sequence(F.lit(1), F.greatest(F.size("q_hashes") - (WINDOW - 1), F.lit(1)))
        return F.when(F.size("q_hashes") > WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get("q_hashes", i + (k - 1)) for k in range(WINDOW)])))
    if name == "q_repeats":
        return F.coalesce(F.size(F.array_distinct("q_windows")) < F.size("q_windows"), F.lit(False))
    if name == "q_sorted":
        return F.when(F.col("q_repeats"), F.array_sort(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    if name == "q_places":
        s = F.col("q_sorted")
        last = F.size(s) - 1
        twice = F.filter(s, lambda w, i: ((i > 0) & (F.get(s, i - 1)["h"] == w["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == w["h"])))
        return F.when(s.isNotNull(), F.array_sort(F.transform(twice, lambda w: w["i"])))
    if name == "n_repeat_words":
        p = F.col("q_places")
        spans = F.transform(p, lambda v, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - v, F.lit(WINDOW))))
        return F.coalesce(F.when(F.size(p) > 0, F.aggregate(spans, F.lit(0), lambda a, v: a + v)), F.lit(0)).cast("long")
    plain = {
        "n_words": lambda: F.size("q_words"),
        "word_chars": lambda: F.length(F.array_join("q_words", "")),
        "n_symbols": lambda: F.regexp_count("q_text", F.lit(r"[#*$%&|<>]")),
        "n_lines": lambda: F.size("q_lines"),
        "n_dup_lines": lambda: F.size("q_lines") - F.size(F.array_distinct("q_lines")),
        "n_exclamations": lambda: F.regexp_count("q_text", F.lit("!")),
    }
    return plain[name]().cast("long")


def _closure(names: tuple[str, ...]) -> list[str]:
    wanted = set(names)
    for name in reversed(_NEEDS):
        if name in wanted:
            wanted.update(_NEEDS[name])
    return [name for name in _NEEDS if name in wanted]


def _with(df: DataFrame, names: tuple[str, ...], text: str, have: set[str]) -> DataFrame:
    """``df`` with these measures and what they are made from, but for ``have``."""
    for name in _closure(names):
        if name not in have:
            df = df.withColumn(name, _made(name, text))
            have.add(name)
    return df


def _wrapped(df: DataFrame, text: str) -> DataFrame:
    """The caller's row as a struct, so that no name of its own meets one of ours, and the text."""
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("q_row"), F.col(text).alias("q_source"))


def _unwrapped(df: DataFrame, columns: list[str], names: tuple[str, ...]) -> DataFrame:
    """The caller's columns but for those of ``names``, and these."""
    made = df.select("q_row", F.struct(*names).alias("q_made"))
    return made.select(*[F.col("q_row").getField(c).alias(c) for c in columns if c not in names], *[F.col("q_made").getField(c).alias(c) for c in names])


def measures(df: DataFrame, text: str = "text", names: tuple[str, ...] = MEASURES) -> DataFrame:
    """``df`` with the named measures (long) of every text; columns so named are replaced."""
    return _unwrapped(_with(_wrapped(df, text), names, "q_source", set()), df.columns, names)


#: Each rule's measures and rejecting condition.
RULES: dict[str, tuple[tuple[str, ...], str]] = {
    "too_short": (("n_words",), f"n_words < {MIN_WORDS}"),
    "repeats_itself": (("n_words", "n_repeat_words"), "100 * n_repeat_words > 30 * n_words"),
    "symbols": (("n_words", "n_symbols"), f"n_symbols > {MAX_SYMBOLS_PER_WORD}D * n_words"),
    "duplicate_lines": (("n_lines", "n_dup_lines"), f"n_dup_lines > {MAX_DUPLICATE_LINES}D * n_lines"),
    "word_length": (("n_words", "word_chars"), f"word_chars < {MIN_WORD_CHARS}D * n_words OR word_chars > {MAX_WORD_CHARS}D * n_words"),
    "exclamations": (("n_words", "n_exclamations"), f"n_exclamations > {MAX_EXCLAMATIONS_PER_WORD}D * n_words"),
}
BASE = ("too_short", "repeats_itself")


def cascade_order(df: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """Rules with their estimated cost and rejected share, best ratio first.

    A random sample, written once without a shuffle, is read by each rule alone, so
    that its plan computes only the measures it needs. The time over that of a plain
    reading is the cost, in powers of two of the reading's time, so that small
    differences of two runs change no order. Rules of equal ratio, and an empty
    sample's, keep the order in which they are stated.
    """
    n = rows_of(df)
    held = materialise(df.select(F.col(text).alias("text")).sample(min(1.0, rows / max(n, 1)), 20240229), "rules-sample")

    def timed(of: DataFrame) -> tuple[float, float]:
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            share = of.first()[0] or 0.0
            took.append(time.perf_counter() - began)
        return min(took), share

    plain, _ = timed(held.agg(F.avg(F.length("text"))))
    found = []
    for name, (needs, rejects) in RULES.items():
        took, share = timed(measures(held, "text", needs).agg(F.avg(F.expr(rejects).cast("double"))))
        found.append((name, 2.0 ** round(math.log2(max(took / plain - 1, 1 / 16))), share))
    release(held)
    return sorted(found, key=lambda r: -r[2] / r[1])


def judge(df: DataFrame, text: str = "text", order: list[str] | None = None, report: tuple[str, ...] = MEASURES) -> DataFrame:
    """``df`` with the measures of ``report``, base_failed, rejected_by (the first rule that rejects) and kept.

    Measures that aren't reported are null, and cost nothing, where an earlier rule
    of the cascade rejects.
    """
    order = order or [name for name, _, _ in cascade_order(df, text)]
    base_needs = tuple(m for name in BASE for m in RULES[name][0])
    have: set[str] = set()
    out = _with(_wrapped(df, text), (*report, *base_needs), "q_source", have)
    # As in ``keep``, the marker stops a later filter from moving below the measures.
    out = out.withColumn("q_mark", F.monotonically_increasing_id())
    failure = F.when(F.col("q_mark") < 0, "unmarked")
    for name in order:
        needs, rejects = RULES[name]
        for m in _closure(needs):
            if m not in have:
                out = out.withColumn(m, F.when(failure.isNull(), _made(m, "q_source")))
                have.add(m)
        failure = failure.when(F.expr(rejects), name)
    base = " OR ".join(f"({RULES[name][1]})" for name in BASE)
    out = out.withColumns({"base_failed": F.expr(base), "rejected_by": failure}).withColumn("kept", F.col("rejected_by").isNull())
    return _unwrapped(out, df.columns, (*report, "base_failed", "rejected_by", "kept"))


def keep(df: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` that no rule rejects, with its columns.

    One filter per rule, in the cascade's order. A rule's measures are computed
    above the filters of earlier rules, so rejected texts cost nothing more; the
    row marker, which the filter must read, keeps the optimizer from moving a filter
    below them and working everything out anew for each mention.
    """
    order = order or [name for name, _, _ in cascade_order(df, text)]
    out, have = _wrapped(df, text), set()
    for name in order:
        needs, rejects = RULES[name]
        out = _with(out, needs, "q_source", have).withColumn("q_mark", F.monotonically_increasing_id()).filter(f"q_mark >= 0 AND NOT ({rejects})")
    return out.select("q_row.*")
