"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive examples; a sample of all labelled texts,
their labels hidden, is the unlabelled set, of which the positives make up the
class prior. A linear model over the presence of hashed words, and of their first
letters, is trained in numpy on the class-prior-corrected risk: the negative part of
the risk, which the unlabelled risk less the prior times the positives' gives, may not
fall below zero; where it does, its gradient is reversed.

Only rows with crc32(doc_id) mod 5 other than 0 teach. Labels, language, source
and id are no inputs of a score. The fit uses at most ``POSITIVES`` and
``UNLABELLED`` rows, chosen by a hash of their id, and of these as many, in the order
of a hash, as have ``FIT_BYTES`` of features; every row is scored.

Defined results: a null text is empty and scored as such; rows with a null id or a
null label teach nothing (held_out is then false); without any positive example
all scores are the prior, 0 if there are no labels; repeated rows are scored each;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces, release, tidy

#: Rows that the model is fitted on, at most.
POSITIVES, UNLABELLED = 1_500, 4_000
#: Bytes of features of all chosen rows that the driver holds, about.
FIT_BYTES = 64 << 20
#: First letters of longer words that are features too.
FIRST, BITS = (3, 4, 5), 18
#: Chosen by folds of the teaching rows alone (toxicity_settings.py).
LEAST_TEXTS, STEPS, RATE, DECAY = 32, 300, 0.05, 3e-4
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the text's words, lower-cased runs of letters, and of their first letters."""
    words = set(_WORD.findall((text or "").lower()))
    found = words.union(*({f"{w[:n]}*" for w in words if len(w) > n} for n in FIRST))
    buckets = np.fromiter((xxhash.xxh3_64_intdigest(f.encode("utf-8", "surrogatepass")) >> (64 - BITS) for f in found), np.uint32, len(found))
    buckets.sort()
    return buckets[np.r_[True, buckets[1:] != buckets[:-1]][: len(buckets)]]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least_texts: int = LEAST_TEXTS, steps: int = STEPS, decay: float = DECAY
) -> tuple[np.ndarray, float]:
    """Weights of all buckets, and the bias.

    Where the gradient is reversed the steps swing to and fro, so the mean of the
    second half of them counts.
    """
    texts = positive + unlabelled
    count = np.bincount(np.concatenate(texts), minlength=1 << BITS)
    kept = np.flatnonzero(count >= least_texts)
    place = np.full(1 << BITS, -1, np.int64)
    place[kept] = np.arange(len(kept))
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    col = place[np.concatenate(texts)]
    row, col = row[col >= 0], col[col >= 0]
    is_p = np.arange(len(texts)) < len(positive)
    n_p, n_u = len(positive), len(unlabelled)
    w, bias = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    mean_w, mean_bias, first = np.zeros(len(kept)), 0.0, steps // 2
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], len(texts)) + bias
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_neg = np.logaddexp(0, z)
        negative = loss_neg[~is_p].mean() - prior * loss_neg[is_p].mean()
        pull = np.where(is_p, -prior * (1 - s) / n_p, 0.0)
        push = np.where(is_p, -prior * s / n_p, s / n_u)
        g = pull + push if negative >= 0 else -push
        grad = np.r_[np.bincount(col, g[row], len(kept)) + decay * w, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
        if step > first:
            mean_w += w / (steps - first)
            mean_bias += bias / (steps - first)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = mean_w
    return weights, float(mean_bias)


def _chosen(rows: DataFrame, order: Column, most: int, n: int) -> DataFrame:
    """About the ``most`` first of ``n`` rows by a hash, at most ``most``.

    Hashes over twice the share that is wanted are left out first, so that a task
    hands on few rows, however many there are.
    """
    share = min(1.0, 2.0 * most / max(n, 1))
    few = rows.filter(order < F.lit(int(-(1 << 63) + share * (1 << 64)))) if share < 1 else rows
    return few.orderBy(order).limit(most)


def fit(df: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray | None, float]:
    """The model, from the teaching rows of ``labels`` (doc_id, toxic) and their texts."""
    teach = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    n, toxic = teach.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = toxic / n if n else 0.0
    if not 0 < prior < 1:
        return None, prior
    p = _chosen(teach.filter("toxic = 1"), F.xxhash64("doc_id"), positives, toxic).select("doc_id", F.lit(True).alias("positive"))
    u = _chosen(teach, F.xxhash64("doc_id", F.lit(7)), unlabelled, n).select("doc_id", F.lit(False).alias("positive"))
    chosen = p.union(u)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                found = [features(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(f) * 4 for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], ["turn", "positive", "size", "features"])
        tidy()

    # At most positives + unlabelled ids, so bounded for the join; rows may repeat them.
    rows = df.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text", F.lit(11)).alias("turn"), "positive", "text")
    found = rows.mapInArrow(run, "turn long, positive boolean, size long, features binary")
    held = materialise(found.orderBy("turn").limit(positives + unlabelled), "teaching")
    sizes = held.select("turn", "size").orderBy("turn").toArrow()
    fits = np.cumsum(sizes["size"].to_numpy()) <= FIT_BYTES
    last = sizes["turn"][int(fits.sum()) - 1].as_py() if fits.any() else None
    rows = held.filter(F.col("turn") <= F.lit(last)).collect() if last is not None else []
    release(held)
    sets = {k: [np.frombuffer(r["features"], np.uint32) for r in rows if r["positive"] is k] for k in (True, False)}
    if not sets[True] or not sets[False]:
        return None, prior
    return train(sets[True], sets[False], prior)


def score(df: DataFrame, model: tuple[np.ndarray | None, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                if weights is None:
                    got = np.full(len(texts), bias)
                else:
                    z = np.array([float(weights[features(t)].sum(dtype=np.float64)) + bias for t in texts])
                    got = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        tidy()

    return df.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the teaching rows and scores every row of ``df``."""
    return score(df, fit(df, labels))
