"""Substring deduplication by content-defined chunking.

A gear rolling hash over the words of a text sets the borders of chunks: one falls
behind the least hash, the last on ties, of every SPAN neighbouring words. Borders
so depend on the content nearby and not on the place: an insertion shifts no border
but those beside it. Stretches of JOINED neighbouring chunks are deduplicated by
digest over all documents. A run of chunks of stretches that occurred before, in
another document or earlier in the same one, is removed if it has ``min_words``
words or more; the first occurrence, in order of document id (null first) and chunk
number, stays; documents of one id come in the order of the hash of their texts.

A repeated passage of n words is surely cut alike in all its copies but for its
first WINDOW + SPAN - 2 and its last SPAN words, at most: from the border of its
first SPAN hashes to that of its last. Of more than 50 words that are 34 or more,
no less than ``min_words`` and over the length of any stretch, so that they are
surely removed; only the words at the two ends may stay.

A document is known by its id and a hash of its text, a stretch by 128 bits.

Defined results: a null text stays null; a text without words is unchanged; words
are kept as they stand, with the white space in front of them; ids are cast to long;
rows that share an id, or have none, are judged each by their own text; rows equal in
both are one document and get one result, so the first copies of its passages stay;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_batches, dealt_by_part, each_part, materialise, mix, pieces, rows_of, tidy
from .word_table import word_hashes

#: A border falls behind the least of SPAN gear hashes, so a chunk has SPAN words at
#: most; the hash forgets a word after WINDOW words. Chunks of a stretch.
SPAN, WINDOW, JOINED = 8, 3, 4
#: Words of a run of repeated chunks that is removed: those that any passage of over
#: 50 words surely has between borders.
MIN_WORDS = 51 - (WINDOW + SPAN - 2) - SPAN
#: Chunks that a task holds before it hands them on.
HELD_CHUNKS = 1 << 17
#: Documents of a packed part, about.
DOCUMENTS_OF_PART = 8_000
_WORD = regex.compile(rb"[^ \t-\r]+")


def _gear(g: np.ndarray) -> np.ndarray:
    """The gear hash behind each word, by the words' hashes: of it and the WINDOW - 1 words before."""
    rolled = g.copy()
    for k in range(1, WINDOW):
        rolled[k:] += g[:-k] << np.uint64(64 // WINDOW * k)
    return mix(rolled)


def _ends(g: np.ndarray) -> np.ndarray:
    n = len(g)
    if n < SPAN:
        return np.array([n] if n else [], np.int64)
    # The least of each window, the last of equal ones, so that they never step back.
    least = np.arange(SPAN, n + 1) - np.lib.stride_tricks.sliding_window_view(_gear(g), SPAN)[:, ::-1].argmin(axis=1)
    return np.append(least[np.r_[True, least[1:] != least[:-1]] & (least < n)], n)


def chunk_ends(words: list[bytes]) -> list[int]:
    """Numbers of words before each border, the end included."""
    return _ends(word_hashes([b" ".join(words)])[0]).tolist()


def _digests(g: np.ndarray) -> np.ndarray:
    """Two digests of the stretch from each chunk on, of JOINED chunks, by a text's word hashes; of all chunks if they are fewer."""
    ends = _ends(g)
    if not len(ends):
        return np.empty((2, 0), np.int64)
    starts = np.r_[0, ends[:-1]]
    place = (np.arange(len(g)) - np.repeat(starts, ends - starts)).astype(np.uint64)
    words_mixed = mix(g + place * np.uint64(0x9E3779B97F4A7C15))
    out = []
    # Two sums over a chunk's words, the second weighted by odd numbers that depend on their place.
    for seed, parts in enumerate((words_mixed, words_mixed * (place * np.uint64(0xD1B54A32D192ED02) + np.uint64(1)))):
        chunks = mix(np.add.reduceat(parts, starts), seed)
        size = min(JOINED, len(chunks))
        stretch = chunks[: len(chunks) - size + 1].copy()
        for k in range(1, size):
            stretch = mix(stretch, seed) + chunks[k : len(chunks) - size + 1 + k]
        out.append(mix(stretch, seed).view(np.int64))
    return np.array(out)


PACKED = "part int, own boolean, rows binary"
#: Stands for a null id, and comes first.
_NULL = -(1 << 63)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(keys.view(np.uint64)) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _packed(table: np.ndarray, part: np.ndarray, own: bool) -> pa.RecordBatch:
    """The columns of a table, in one row for each part."""
    order = np.argsort(part, kind="stable")
    table, part = table[:, order], part[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    blobs = [np.ascontiguousarray(x).tobytes() for x in np.split(table, first[1:], axis=1)] if len(part) else []
    return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array([own] * len(first)), pa.array(blobs, pa.binary())], ["part", "own", "rows"])


def _first_and_again(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a table (digest, digest, doc, row, number): the first place of each digest, and (doc, row, number) of all others."""
    table = table[:, np.argsort(table[0])]
    same = table[0, 1:] == table[0, :-1]
    met = np.r_[same, False][: table.shape[1]] | np.r_[False, same][: table.shape[1]]
    alone, table = table[:, ~met], table[:, met]
    table = table[:, np.lexsort(table[::-1])]
    new = np.r_[True, (table[:2, 1:] != table[:2, :-1]).any(axis=0)][: table.shape[1]]
    firsts = table[:, new]
    its = np.repeat(np.arange(firsts.shape[1]), np.diff(np.r_[np.flatnonzero(new), len(new)]))
    # A repeated row has the very place of its copy; that is no repetition.
    return np.concatenate([alone, firsts], axis=1), table[2:, (table[2:] != firsts[2:, its]).any(axis=0)]


def _chunks(parts: int):
    """Deals the stretches out by digest.

    Of a digest's places in one task's share only the first goes on to meet those of
    other tasks; the others can't be first anywhere, and go out as marks (own), to
    parts in turn. So a digest of very many documents sends one place from each share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []
        size = turn = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, turn
            sizes = [d.shape[1] for d, _, _ in held]
            places = [np.repeat(np.array([x[k] for x in held], np.int64), sizes) for k in (1, 2)]
            table = np.vstack([np.concatenate([d for d, _, _ in held], axis=1), *places, np.concatenate([np.arange(n) for n in sizes])])
            held.clear()
            size, turn = 0, turn + 1
            firsts, again = _first_and_again(table)
            yield _packed(firsts, _part_of(firsts[0], parts), False)
            if again.shape[1]:
                yield _packed(again, np.full(again.shape[1], (int(again[1, 0]) + turn) % parts), True)

        for batch in batches:
            for part, texts in pieces(batch, "text"):
                docs, rows = part.column(0).to_pylist(), part.column(1).to_pylist()
                hashes = word_hashes([(t or "").encode() for t in texts])
                for doc, row, g in zip(docs, rows, hashes, strict=True):
                    if len(g):
                        held.append((_digests(g), _NULL if doc is None else doc, row))
                        size += held[-1][0].shape[1]
                if size > HELD_CHUNKS:
                    yield from flush()
        if size:
            yield from flush()
        tidy()

    return run


def _table(part: list[pa.RecordBatch], height: int, own: bool) -> np.ndarray:
    tables = [np.frombuffer(x.as_buffer(), np.int64).reshape(height, -1) for b in part for o, x in zip(b.column(1).to_pylist(), b.column(2), strict=True) if o is own]
    return np.concatenate(tables, axis=1) if tables else np.empty((height, 0), np.int64)


def _repeats(parts: int):
    """Deals out by document (doc, row, number) of all stretches that are not the first with their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in each_part(batches):
            _, again = _first_and_again(_table(part, 5, False))
            again = np.concatenate([again, _table(part, 3, True)], axis=1)
            if again.shape[1]:
                yield _packed(again, _part_of(again[0] ^ again[1], parts), True)
        tidy()

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the runs of chunks of repeated stretches: the first of each and the one behind it."""
    for part in each_part(batches):
        table = _table(part, 3, True)
        doc, row, number = table[:, np.lexsort(table[::-1])]
        other = np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])][: len(doc)]
        new = other | np.r_[True, number[1:] > number[:-1] + JOINED][: len(doc)]
        runs = np.stack([number[new], number[np.r_[new[1:], True][: len(doc)]] + JOINED], axis=1).astype("<i4")
        first = np.flatnonzero(other[new])
        doc, row = doc[new][first], row[new][first]
        stops = np.append(first[1:], len(runs))
        for a in range(0, len(first), 4096):
            cut = slice(a, a + 4096)
            lists = [runs[x:y].tobytes() for x, y in zip(first[cut].tolist(), stops[cut].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[cut], mask=doc[cut] == _NULL), pa.array(row[cut]), pa.array(lists, pa.binary())], ["doc", "row", "runs"])
    tidy()


def without(text: str, repeated: set[int], min_words: int) -> tuple[str, int, int]:
    """The text without long runs of chunks of repeated stretches, and its numbers of chunks and of words removed."""
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw)]
    words = [raw[a:b] for a, b in spans]
    ends = chunk_ends(words)
    out, at, removed, k = [], 0, 0, 0
    while k < len(ends):
        if k not in repeated:
            k += 1
            continue
        j = k
        while j < len(ends) and j in repeated:
            j += 1
        first, last = ends[k - 1] if k else 0, ends[j - 1]
        if last - first >= min_words:
            start = spans[first - 1][1] if first else 0
            out.append(raw[at:start])
            at = spans[last - 1][1]
            removed += last - first
        k = j
    out.append(raw[at:])
    return b"".join(out).decode(), len(ends), removed


def _rewrite(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                marks = part.column(2).to_pylist()
                new, chunks, removed = [], [], []
                hashes = word_hashes([(t or "").encode() if not m else b"" for t, m in zip(texts, marks, strict=True)])
                for t, m, g in zip(texts, marks, hashes, strict=True):
                    if t is None:
                        got = (None, 0, 0)
                    elif not m:
                        got = (t, len(_ends(g)), 0)
                    else:
                        got = without(t, {k for a, b in np.frombuffer(m, "<i4").reshape(-1, 2).tolist() for k in range(a, b)}, min_words)
                    new.append(got[0])
                    chunks.append(got[1])
                    removed.append(got[2])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string()), pa.array(chunks, pa.int64()), pa.array(removed, pa.int64())], ["own", "text", "n_chunks", "n_removed_words"])
        tidy()

    return run


def dedup_substrings(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with ``text`` freed of repeated passages, and n_chunks and n_removed_words (columns so named are replaced)."""
    spark = df.sparkSession
    bounded_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows_of(df) // DOCUMENTS_OF_PART + 1)
    docs = df.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    repeated = dealt_by_part(docs.mapInArrow(_chunks(parts), PACKED), parts).mapInArrow(_repeats(parts), PACKED)
    marks = materialise(dealt_by_part(repeated, parts).mapInArrow(_runs, "doc long, row long, runs binary"), "chunk-marks")
    size = marks.agg(F.count("*") * 96 + F.coalesce(F.sum(F.length("runs")), F.lit(0))).first()[0]
    marks = F.broadcast(marks) if size <= BROADCAST_BYTES else marks
    others = [c for c in df.columns if c not in (text, "n_chunks", "n_removed_words")]
    keyed = df.select(F.struct(*[F.col(c) for c in others]).alias("own"), F.col(text).alias("text"), F.col(doc_id).cast("long").alias("own_doc"))
    met = F.col("own_doc").eqNullSafe(F.col("doc")) & (F.xxhash64("text") == F.col("row"))
    joined = keyed.join(marks, met, "left").select("own", "text", "runs")
    out = joined.mapInArrow(_rewrite(min_words), joined.select("own", "text").schema.add("n_chunks", "long").add("n_removed_words", "long"))
    made = F.struct(F.col("text").alias(text), "n_chunks", "n_removed_words").alias("made")
    return out.select("own", made).select("own.*", "made.*")
