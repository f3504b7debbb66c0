"""Cleaning, tokens, n-grams and JSON found in text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import held

#: Terms, and rows of terms in a vocabulary, that a task holds before it passes them on.
TERMS_AT_ONCE, ROWS_AT_ONCE = 1 << 18, 256

#: Common English stop words, and those words that clinical text needs
#: (which are kept, stop word or not).
STOPWORDS = """a about above after again against ain all am an and any are aren as at be because been before being below
between both but by can couldn d did didn do does doesn doing don down during each few for from further had hadn has
hasn have haven having he her here hers herself him himself his how i if in into is isn it its itself just ll m ma me
mightn more most mustn my myself needn no nor not now o of off on once only or other our ours ourselves out over own re
s same shan she should shouldn so some such t than that the their theirs them themselves then there these they this
those through to too under until up ve very was wasn we were weren what when where which while who whom why will with
without won wouldn y you your yours yourself yourselves""".split()
KEPT_WORDS = "no not nor without against positive negative above below over under few more most all any same other both each".split()
URL = r"http\S+|www\S+|https\S+"
EMAIL = r"\S+@\S+"
#: JSON in a fence, from behind its opening marks.
FENCED = r"(?s)^(?:[^\n\[{][^\n]{0,18}\n)?\s*([\[{].*?)```"


def clean_plain(text: Column) -> Column:
    """Lower case, trimmed, punctuation removed."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_\s]", "")


def without_addresses(text: Column) -> Column:
    """Without URLs and e-mail addresses.

    The pattern of addresses tries every start of a run of characters, so it is used
    only on texts with an @.
    """
    t = F.regexp_replace(text, URL, "")
    return F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, EMAIL, "")).otherwise(t)


def clean_units(text: Column) -> Column:
    """Lower case without URLs and addresses; numbers parted from units; punctuation to blanks."""
    t = without_addresses(F.lower(text))
    t = F.regexp_replace(t, r"(\d+\.?\d*)([a-z]{1,3})\b", "$1 $2")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean_dense(text: Column) -> Column:
    """For dense embedders: case kept, no URLs and addresses, runs of .!? and of white space made one."""
    t = F.regexp_replace(without_addresses(text), r"\s+", " ")
    for mark in (".", "!", "?"):
        t = F.regexp_replace(t, rf"[{mark}]{{2,}}", mark)
    return F.trim(t)


def tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def without_stopwords(words: Column, stop: Sequence[str] = STOPWORDS, kept: Sequence[str] = KEPT_WORDS) -> Column:
    gone = sorted(set(stop) - set(kept))  # a list of literals is looked up by hash, an array is searched
    return F.filter(words, lambda w: ~w.isin(gone))


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word by Porter's published algorithm."""
    return _porter(word) if len(word) > 2 and word.isascii() and word.isalpha() else word


def stemmed(words: Column) -> Column:
    """An array's words as stems; a worker keeps the stems of many words from batch to batch."""

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda ws: None if ws is None else [None if w is None else stem(w) for w in ws])

    return run(words)


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = "".join("v" if _is_vowel(stem, i) else "c" for i in range(len(stem)))
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", kinds)))


def _is_vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or word[i] == "y" and i > 0 and not _is_vowel(word, i - 1)


def _has_vowel(stem: str) -> bool:
    return any(_is_vowel(stem, i) for i in range(len(stem)))


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    n = len(word)
    return n > 2 and not _is_vowel(word, n - 1) and _is_vowel(word, n - 2) and not _is_vowel(word, n - 3) and word[-1] not in "wxy"


#: The suffixes of steps 2 to 4 of the published algorithm, and what replaces them.
_STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _replaced(word: str, table: dict[str, str]) -> str:
    suffix = max((s for s in table if word.endswith(s)), key=len, default=None)
    return word[: -len(suffix)] + table[suffix] if suffix and _measure(word[: -len(suffix)]) > 0 else word


def _porter(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif cut := next((s for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and not _is_vowel(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, _STEP_2), _STEP_3)
    suffix = max((s for s in _STEP_4 if w.endswith(s)), key=len, default=None)
    if suffix and _measure(w[: -len(suffix)]) > 1 and (suffix != "ion" or w[: -len(suffix)].endswith(("s", "t"))):
        w = w[: -len(suffix)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def joined(words: Column) -> Column:
    """Words of two or more characters as one string, parted by blanks, which no word holds."""
    return F.array_join(F.filter(words, lambda w: F.length(w) >= 2), " ")


def _split(text: str | None) -> list[str]:
    return text.split(" ") if text else []


def ngrams(words: Sequence[str], n: int) -> Iterable[str]:
    """All runs of n words, joined by blanks."""
    return words if n == 1 else map(" ".join, zip(*(words[i:] for i in range(n)), strict=False))


def _one_row_a_key(rows: DataFrame, key: str, made: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``made`` gives of each row, merged for keys that several rows share.

    The keys alone are read first: where none repeats, which is the rule, nothing is shuffled.
    """
    repeated = held(rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_key")), "repeated-keys")
    if repeated.isEmpty():
        return made(rows)
    same = F.col(key).eqNullSafe(F.col("_key"))
    return made(rows.join(repeated, same, "left_anti")).unionByName(merged(made(rows.join(repeated, same, "left_semi"))))


def term_counts(df: DataFrame, key: str, words: Column, most: int = 1) -> DataFrame:
    """(key, term, n): how often a key has each n-gram of 1 to ``most`` words; ``words`` are parted by blanks.

    A row's terms are counted where the row is, so no term is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            terms: list[str] = []
            counts: list[int] = []
            for i, text in enumerate(b.column(1)):
                own, found = _split(text.as_py()), Counter()
                for n in range(1, most + 1):
                    found.update(ngrams(own, n))
                at += [i] * len(found)
                terms += found.keys()
                counts += found.values()
                if len(terms) >= TERMS_AT_ONCE or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], [key, "term", "n"])
                    at, terms, counts = [], [], []

    rows = df.select(key, words.alias("words"))
    made = lambda some: some.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, term string, n long")
    return _one_row_a_key(rows, key, made, lambda some: some.groupBy(key, "term").agg(F.sum("n").alias("n")))


def top_terms(texts: DataFrame, most: int, size: int) -> list[tuple[str, int]]:
    """(term, n): the ``size`` most frequent n-grams of 1 to ``most`` words, in order, ties by term.

    ``texts`` has one column, of words parted by blanks. Whenever an n-gram is among
    these, so is what it begins with: that is as frequent at least, and comes first
    on a tie. So n-grams are counted length by length, and only those whose beginning
    is among the most frequent so far; what is left out can't be in the result.
    """
    top: list[tuple[str, int]] = []
    for length in range(1, most + 1):
        begin = {t for t, _ in top if t.count(" ") == length - 2}
        if length > 1 and not begin:
            break

        def run(batches: Iterator[pa.RecordBatch], length=length, begin=begin) -> Iterator[pa.RecordBatch]:
            found: Counter[str] = Counter()

            def rows() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

            for b in batches:
                for text in b.column(0):
                    own = _split(text.as_py())
                    grams = ngrams(own, length)
                    found.update(compress(grams, map(begin.__contains__, ngrams(own, length - 1))) if length > 1 else grams)
                    if len(found) >= TERMS_AT_ONCE:
                        yield rows()
                        found.clear()
            yield rows()

        counts = texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        top += [(r["term"], r["n"]) for r in counts.orderBy(F.desc("n"), "term").limit(size).collect()]
        top = sorted(top, key=lambda r: (-r[1], r[0]))[:size]
    return top


def vocabulary_counts(df: DataFrame, key: str, words: Column, most: int, vocabulary: Sequence[str]) -> DataFrame:
    """(key, at, w): of every key, places in the vocabulary of the n-grams of 1 to ``most`` words that it has, ascending, and how often."""
    place = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(start, ROWS_AT_ONCE)
                at, w = [], []
                for text in part.column(1):
                    own, found = _split(text.as_py()), Counter()
                    for n in range(1, most + 1):
                        found.update(filter(place.__contains__, ngrams(own, n)))
                    cells = sorted((place[t], float(n)) for t, n in found.items())
                    at.append([i for i, _ in cells])
                    w.append([n for _, n in cells])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(w, pa.list_(pa.float64()))], [key, "at", "w"])

    def merged(some: DataFrame) -> DataFrame:
        cells = some.select(key, F.explode_outer(F.arrays_zip("at", "w")).alias("e")).groupBy(key, "e.at").agg(F.sum("e.w").alias("w"))
        own = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "w")))).alias("e"))
        return own.select(key, F.col("e.at").alias("at"), F.col("e.w").alias("w"))

    rows = df.select(key, words.alias("words"))
    return _one_row_a_key(rows, key, lambda some: some.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, at array<int>, w array<double>"), merged)


def vocabulary_weights(counts: DataFrame, key: str, documents: DataFrame) -> DataFrame:
    """``vocabulary_counts`` as weights, tf * (ln((1 + N) / (1 + df)) + 1), each row of Euclidean length 1.

    ``documents`` has the rows that N counts; a row's weights are made where the row is.
    """
    frequency = {r["at"]: r["df"] for r in counts.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).collect()}  # a row a term
    idf = np.ones(max(frequency, default=-1) + 1)
    idf[list(frequency)] = np.log((1.0 + documents.count()) / (np.array(list(frequency.values())) + 1.0)) + 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            row, w = np.repeat(np.arange(b.num_rows), sizes), n * idf[at]
            w /= np.sqrt(np.bincount(row, w * w, b.num_rows))[row]
            places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(w))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), places], [key, "at", "w"])

    return counts.mapInArrow(run, f"{key} {dict(counts.dtypes)[key]}, at array<int>, w array<double>")


def tfidf(counts: DataFrame, key: str, documents: DataFrame) -> DataFrame:
    """(key, term, weight): tf * (ln((1 + N) / (1 + df)) + 1), each row of Euclidean length 1.

    ``documents`` has the rows that N counts; the count is part of the plan.
    """
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    total = documents.agg(F.count("*").alias("total"))
    raw = counts.join(frequency, "term").crossJoin(F.broadcast(total))  # one row
    raw = raw.withColumn("w", F.col("n") * (F.log((F.lit(1.0) + F.col("total")) / (F.col("df") + F.lit(1.0))) + 1.0))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / length).alias("weight"))


def tagged_json(reply: Column) -> Column:
    """What stands between JSON tags, else in a json fence, else in the first fence; null if nowhere.

    In a fence without the word json, a short first line that is no JSON is stepped
    over as the name of a language, and what follows must start with { or [.
    """
    found = lambda text, pattern: F.nullif(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"^\s+|\s+$", ""), F.lit(""))
    behind = F.when(F.contains(reply, F.lit("```")), F.substr(reply, F.instr(reply, "```") + F.lit(3)))
    return F.coalesce(found(reply, r"(?s)<JSON>(.*?)</JSON>"), found(reply, r"(?s)```json\s*(.*?)```"), found(behind, FENCED))


def brace_json(reply: Column) -> Column:
    """From the first { to the last }, over lines; null if there is none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))


def presence(value: Column) -> Column:
    """1 for Present, 0 for Absent, null for anything else."""
    v = F.lower(F.trim(value))
    return F.when(v == "present", 1).when(v == "absent", 0)


def metric(name: Column, known: Mapping[str, str]) -> Column:
    """The metric's own name by ``known``, whatever the case and signs of the given one; null for one that isn't known."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), key)


def file_name(text: Column) -> Column:
    """A name for files: letters, digits, dot, minus and underscore; never empty."""
    safe = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(safe == "", "unnamed").otherwise(safe)
