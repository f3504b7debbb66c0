"""Near-duplicate documents by HyperMinHash over word shingles.

Texts are lower-cased (A-Z) and split at blank and \\t to \\r. A document's set
holds its distinct shingles of ``shingle`` words; a shorter one is one shingle; a
text without words has an empty set and links with nothing. Documents are linked
if 100 * intersection >= percent * union, which is confirmed on full sets.

Defined results: a null text is empty; rows with a null id link with nothing,
have a null component and are kept; rows that share an id are judged each by its
own text, and may be linked through their id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, mix, pieces, rows_of, small, tidy
from .minhash import DEALT, PART_PAIRS, Dealer, band_keys, linked, registers
from .word_table import word_hashes

#: With 48 bands of 5 registers a pair of similarity 0.8 shares no key once in 190 million.
BANDS, ROWS = 48, 5
_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit values of each text's word shingles."""
    return [_shingles(h, words) for h in word_hashes([(t or "").encode().lower() for t in texts])]


def _shingles(h: np.ndarray, words: int) -> np.ndarray:
    width = min(words, len(h))
    if not width:
        return h
    out = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        out *= np.uint64(_STEP[i % 3])
        out ^= out >> np.uint64(31)
        out += h[i : len(h) - width + 1 + i]
    out = mix(out, width)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def _sketches(df: DataFrame, shingle: int) -> DataFrame:
    """(id, n, d1, d2, regs) of every row; d1 and d2 are a digest of the set (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                sets = shingles(texts, shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                regs: list[bytes | None] = [None] * len(sets)
                digest = np.zeros((len(sets), 2), np.int64)
                if len(some):
                    for i, r in zip(some, registers(np.concatenate(sets), sizes[some], BANDS * ROWS), strict=True):
                        regs[i] = r.tobytes()
                        digest[i] = np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64)
                none = sizes == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.array(digest[:, 0], mask=none), pa.array(digest[:, 1], mask=none), pa.array(regs, pa.binary())],
                    ["id", "n", "d1", "d2", "regs"],
                )
        tidy()

    return df.mapInArrow(run, "id long, n long, d1 long, d2 long, regs binary")


def _deal(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(parts)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), BANDS * ROWS)
            for i in range(0, len(ids), 4096):
                yield from dealer.add(band_keys(regs[i : i + 4096], BANDS), ids[i : i + 4096])
        yield from dealer.flush()
        tidy()

    return run


def _values(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(items), np.uint64), np.array([len(x) // 8 for x in items], np.int64)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``df``."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sketches = materialise(_sketches(docs, shingle), "sketches")
    filled = sketches.filter("d1 is not null and id is not null")
    nodes = materialise(filled.groupBy("d1", "d2").agg(F.min("id").alias("id")), "nodes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows_of(nodes) * BANDS // PART_PAIRS + 1)
    dealt = filled.join(small(nodes), ["id", "d1", "d2"], "left_semi").select("id", "regs").mapInArrow(_deal(parts), DEALT)

    def sets_of(ids: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in pieces(batch, "text"):
                    sets = shingles(texts, shingle)
                    sizes = np.array([len(s) for s in sets], np.int64)
                    some = np.flatnonzero(sizes)
                    if not len(some):
                        continue
                    regs = registers(np.concatenate(sets), sizes[some], BANDS * ROWS)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(some)), pa.array(sizes[some]), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([sets[i].tobytes() for i in some], pa.binary())],
                        ["id", "n", "regs", "item"],
                    )
            tidy()

        return docs.join(small(ids), "id", "left_semi").mapInArrow(run, "id long, n long, regs binary, item binary")

    groups = linked(dealt, parts, sets_of, _values, percent, "near")
    rep = small(nodes).select("d1", "d2", F.col("id").alias("rep"))
    rows = sketches.select("id", "n", "d1", "d2").join(rep, ["d1", "d2"], "left")
    rows = rows.join(small(groups), F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    out = rows.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True)))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` of the smallest id of each group of near-duplicates."""
    gone = near_duplicates(df, doc_id, text, shingle, percent).filter("NOT kept").select(F.col(doc_id).alias("gone")).distinct()
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("q"), F.col(doc_id).cast("long").alias("own"))
    return rows.join(small(materialise(gone, "gone")), F.col("own") == F.col("gone"), "left_anti").select("q.*")
