"""Secrets in whole texts, by rules of regular expressions over a trigram inverted index.

From each rule's expression follows which trigrams a text must contain
(``trigrams.query``). The index has a posting, of trigram and document, for every
trigram that some rule asks for; it is a table in the shared folder. Postings meet
the rules' alternatives, and a document is a candidate of a rule if it has all
trigrams of one of them. Candidates are verified by the expression itself, over the
whole text; a rule that no trigram is mandatory for scans all texts. Only DataFrame
and SQL functions are used.

Spans are leftmost and non-overlapping per rule, in code points, the end exclusive.
A null text counts as empty. Documents are known by id and 128 bits of their text, so
rows of a shared or null id are each judged by their own text, and repeated rows get
the same spans, each its own row. A key of many rows is split by the adaptive join,
as no aggregate stands above it. Columns that aren't to be kept don't matter, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trigrams
from .common import materialise, release, small


@dataclass(frozen=True)
class Rule:
    """What matches ``pattern``, with ``least`` characters or more in its ``group``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    @property
    def expression(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Runs are as long as they can be, so asking for 16 finds those of [0-9a-f]+ that have them.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Rules beyond the base: public formats of keys and tokens.
FORMATS = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"(?:https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D/:@]{1,256}:[^\x20\x09-\x0D/@]{1,256}@"),
)
RULES = BASE + FORMATS
KEY = ("s_id", "s_low", "s_high")


def queries(rules: Sequence[Rule]) -> dict[int, trigrams.Query]:
    """The trigram query of each rule that has one, by its place; the others scan all texts."""
    asked = {i: trigrams.query(r.pattern, r.ignore_case) for i, r in enumerate(rules)}
    return {i: q for i, q in asked.items() if q != trigrams.ANY}


def _keyed(df: DataFrame, key: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    source = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(*[F.col(c) for c in keep]).alias("s_row") if keep else F.lit(None).alias("s_row")
    return df.select(F.col(key).alias("s_id"), F.xxhash64(source).alias("s_low"), F.xxhash64(F.lit("high"), source).alias("s_high"), source.alias("s_text"), row)


def index(df: DataFrame, wanted: Sequence[tuple[str, bool]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (term, and the document's key): a row for each of the ``wanted`` trigrams that a text contains.

    A term is a place in ``wanted``, of trigrams and whether they are of the
    lower-cased text.
    """
    lowered = _keyed(df, key, text).withColumn("s_lower", F.lower("s_text"))
    found = [F.when(F.col("s_lower" if folded else "s_text").contains(t), F.lit(i)) for i, (t, folded) in enumerate(wanted)]
    return lowered.select(*KEY, F.explode(F.array_compact(F.array(*found))).alias("term"))


def candidates(df: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """A materialised table of documents' keys, each with the rules (their places) that it may match, as far as these have a query."""
    asked = queries(rules)
    wanted = sorted({(t, rules[i].ignore_case) for i, q in asked.items() for a in q for t in a})
    place = {t: n for n, t in enumerate(wanted)}
    terms = [(place[t, rules[i].ignore_case], i, n, len(a)) for i, q in asked.items() for n, a in enumerate(q) for t in a]
    # A row for each trigram of each alternative: the rules' own size bounds it.
    names = ("term", "rule", "alternative", "needed")
    lookup = F.broadcast(df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(t, names, strict=True)]) for t in terms]))))
    postings = materialise(index(df, wanted, key, text), "secret-postings")
    met = postings.join(lookup, "term").groupBy(*KEY, "rule", "alternative", "needed").agg(F.count_distinct("term").alias("n"))
    able = met.filter("n = needed").groupBy(*KEY).agg(F.collect_set("rule").alias("s_rules"))
    out = materialise(able, "secret-candidates")
    release(postings)
    return out


def _running(lengths: Column) -> Column:
    """Sums of an array's first elements, for each number of them, in as many passes as its length has bits."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(2)).cast("double"))).cast("int"))

    def doubled(sums: Column, k: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.when(i >= reach, F.get(sums, i - reach)).otherwise(F.lit(0)))

    return F.aggregate(passes, lengths, doubled)


def _verified(df: DataFrame, i: int, rule: Rule, may: Column) -> DataFrame:
    """``df`` with column s_spans_i: (start, rule, end) of the rule's matches, an empty array where there are none."""
    whole, value, gaps, ends, spans = (f"s_{part}_{i}" for part in ("whole", "value", "gaps", "ends", "spans"))
    df = df.withColumn(whole, F.when(may, F.regexp_extract_all("s_text", F.lit(rule.expression), F.lit(0))))
    some = F.size(whole) > 0
    df = df.withColumns({
        value: F.when(some, F.regexp_extract_all("s_text", F.lit(rule.expression), F.lit(rule.group))) if rule.group else F.col(whole),
        gaps: F.when(some, F.split("s_text", rule.expression, -1)),
    })
    df = df.withColumn(ends, F.when(some, _running(F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, w: F.length(g) + F.length(w)))))
    each = F.transform(F.arrays_zip(whole, value, ends), lambda m: F.struct((m[ends] - F.length(m[whole])).alias("start"), F.lit(i).alias("rule"), m[ends].alias("end"), F.length(m[value]).alias("size")))
    kept = F.transform(F.filter(each, lambda m: m["size"] >= rule.least), lambda m: F.struct(m["start"], m["rule"], m["end"]))
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    return df.withColumn(spans, F.when(some, kept).otherwise(none)).drop(whole, value, gaps, ends)


def scan(df: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row and ``spans``: array of (kind, start, end) by start, then the rules' order.

    A column of ``keep`` named spans is replaced.
    """
    keep = [c for c in keep if c != "spans"]
    asked = queries(rules)
    rows = _keyed(df, key, text, keep)
    if asked:
        found = small(candidates(df, rules, key, text).select(*[F.col(k).alias(f"c_{k}") for k in KEY], "s_rules"))
        rows = rows.join(found, [rows[k].eqNullSafe(found[f"c_{k}"]) for k in KEY], "left")
    for i, rule in enumerate(rules):
        rows = _verified(rows, i, rule, F.coalesce(F.array_contains("s_rules", i), F.lit(False)) if i in asked else F.lit(True))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    all_spans = F.array_sort(F.concat(*[F.col(f"s_spans_{i}") for i in range(len(rules))]))
    named = F.transform(all_spans, lambda s: F.struct(F.get(kinds, s["rule"]).alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
    return rows.select(*[F.col("s_row").getField(c).alias(c) for c in keep], named.alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(df: DataFrame) -> DataFrame:
    """doc_id, the numbers of spans of the base rules, the digest of these and all spans."""
    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    own, base = scan(df), of(*[r.kind for r in BASE])
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return own.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
