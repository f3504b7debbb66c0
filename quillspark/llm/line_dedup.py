"""Fuzzy line deduplication by MinHash.

A line's set holds its distinct shingles of ``SHINGLE`` characters, lower-cased.
Lines of similarity 0.8 or more are linked: sketches are banded for high recall,
candidates verified on full sets, and the links closed by distributed union-find.
Of every component, exact copies included, the first line stays, in order of
document id (null first), of the hash of the document's text, and of line number;
the others are removed.

A line is known by two chained 64-bit hashes, a document by its id and the hash of
its text; so neither rows that share an id nor a collision of one hash lose text.

Defined results: lines without a character other than white space are never
removed; lines shorter than a shingle match exact copies only; a null text stays
null; a document that loses all lines keeps an empty text; rows that share an id, or
have none, are judged each by their own text; rows equal in both are one document
and get one result, so all copies of its first lines stay; of lines whose first hash
collides only exact copies are removed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_batches, materialise, mix, pieces, release, rows_of, small, tidy
from .minhash import DEALT, PART_PAIRS, Dealer, band_keys, filled, least_in_buckets, linked

SHINGLE = 8
#: With 25 bands of 4 registers a pair of similarity 0.8 shares no key once in 530,000,
#: of 0.85 once in 90 million.
BANDS, ROWS = 25, 4
#: Characters of lines whose shingles are made at once, and lines whose sketches are.
AT_ONCE, LINES_AT_ONCE = 1 << 17, 4096
WORDS_LINE = r"[^ \t-\r]"


def shingle_values(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of the shingles of each line of SHINGLE or more characters, and their number."""
    joined = "".join(lines).encode("utf-32-le", "surrogatepass")
    x = np.frombuffer(joined, "<u4").astype(np.uint64)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    h = x[:-1] * np.uint64(0x9E3779B1) + x[1:]
    h = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    h = h[:-4] * np.uint64(0x165667B19E3779F9) + h[4:]
    h = mix(h)
    number = size - (SHINGLE - 1)
    keep = np.ones(len(h), bool)
    ends = np.cumsum(size)[:-1]
    for k in range(1, SHINGLE):
        keep[ends - k] = False
    return h[keep], number


def sketches(lines: list[str]) -> np.ndarray:
    """Registers of lines, all of SHINGLE or more characters; a long line is read in overlapping parts."""
    buckets = BANDS * ROWS
    least, at = [], 0
    while at < len(lines):
        if len(lines[at]) > AT_ONCE:
            parts = (lines[at][a : a + AT_ONCE + SHINGLE - 1] for a in range(0, len(lines[at]) - SHINGLE + 1, AT_ONCE))
            least.append(np.minimum.reduce([least_in_buckets(*shingle_values([p]), buckets) for p in parts]))
            at += 1
            continue
        stop = size = 0
        while at + stop < len(lines) and size + len(lines[at + stop]) <= AT_ONCE:
            size += len(lines[at + stop])
            stop += 1
        least.append(least_in_buckets(*shingle_values(lines[at : at + stop]), buckets))
        at += stop
    return filled(np.concatenate(least), buckets) if least else np.empty((0, buckets), np.uint16)


def _line_ids(lines: list[str]) -> np.ndarray:
    """The same 64-bit ids as the SQL function xxhash64 gives."""
    return np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8"), 42) for x in lines), np.uint64, len(lines)).view(np.int64)


def _deal(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(parts)
        for batch in batches:
            for _, texts in pieces(batch, "text", 1 << 19):
                found = {line: low for t in texts if t for line in t.split("\n") if len(low := line.lower()) >= SHINGLE and not line.isspace()}
                lines, low = list(found), list(found.values())
                for i in range(0, len(lines), LINES_AT_ONCE):
                    some = slice(i, i + LINES_AT_ONCE)
                    yield from dealer.add(band_keys(sketches(low[some]), BANDS), _line_ids(lines[some]))
        yield from dealer.flush()
        tidy()

    return run


def _values(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The values of lines, all of SHINGLE or more characters, lower-cased as their sketches were."""
    return shingle_values([x.decode().lower() for x in items]) if items else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, row, pos, id, id2) of every line that may be removed."""
    rows = docs.select("doc", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.filter(F.col("line").rlike(WORDS_LINE)).select("doc", "row", "pos", F.xxhash64("line").alias("id"), F.xxhash64("line", "line").alias("id2"))


def removals(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(doc, row, gone): for each document, by id and xxhash64 of its text, the numbers, from 0, of the lines to remove."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    lines = materialise(_numbered(docs), "lines")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows_of(lines) * BANDS // PART_PAIRS + 1)
    dealt = docs.select("text").mapInArrow(_deal(parts), DEALT)

    def sets_of(ids: DataFrame) -> DataFrame:
        hit = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= SHINGLE)
        hit = hit.select(F.xxhash64("line").alias("id"), F.xxhash64("line", "line").alias("id2"), "line").join(small(ids), "id", "left_semi")
        one = hit.groupBy("id").agg(F.first("line").alias("line"), F.min("id2").alias("x"), F.max("id2").alias("y")).filter("x = y")
        return one.select("id", F.length("line").cast("long").alias("n"), F.lit(None).cast("binary").alias("regs"), F.encode("line", "utf-8").alias("item"))

    groups = linked(dealt, parts, sets_of, _values, percent, "line")
    place = F.struct(F.col("doc").isNotNull().alias("known"), "doc", "row", "pos")
    first = F.min(place).alias("first")
    copied = lines.groupBy("id", "id2").agg(first, F.count("*").alias("n")).filter("n > 1").select("id", "id2", "first")
    alike = lines.join(small(groups), lines["id"] == F.col("node"), "left_semi").groupBy("id", "id2").agg(first)
    firsts = copied.union(alike).distinct().join(small(groups), F.col("id") == F.col("node"), "left")
    firsts = materialise(firsts.select("id", "id2", "component", "first"), "line-firsts")
    keeper = materialise(firsts.filter("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("kept")), "line-kept")
    plan = firsts.join(small(keeper), "component", "left").select("id", "id2", F.coalesce("kept", "first").alias("kept"))
    plan = materialise(plan, "line-keepers")
    hits = lines.join(small(plan), ["id", "id2"]).filter(~place.eqNullSafe(F.col("kept")))
    out = materialise(hits.groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "line-gone")
    release(lines, groups, firsts, keeper, plan)
    return out


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``df`` with ``text`` freed of repeated lines, and n_lines and n_removed_lines (columns so named are replaced)."""
    gone = removals(df, doc_id, text, percent)
    size = gone.agg(F.count("*") * 96 + F.coalesce(F.sum(F.size("gone")), F.lit(0)) * 4).first()[0]
    gone = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    # The caller's row is a struct, so that no name of its own meets one of ours.
    row = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("q"), F.col(doc_id).alias("own_doc"), F.col(text).alias("own_text"))
    met = F.col("own_doc").eqNullSafe(F.col("doc")) & (F.xxhash64("own_text") == F.col("row"))
    joined = row.join(gone, met, "left").select("q", "own_text", "gone")
    kept = F.array_join(F.filter(F.split("own_text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    columns = {
        "n_lines": F.coalesce(F.size(F.filter(F.split("own_text", "\n"), lambda x: x.rlike(WORDS_LINE))), F.lit(0)).cast("long"),
        "n_removed_lines": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"),
        text: F.when(F.col("gone").isNull(), F.col("own_text")).otherwise(kept),
    }
    made = joined.select("q", F.struct(*[v.alias(k) for k, v in columns.items()]).alias("made"))
    return made.select(*[F.col("q").getField(c).alias(c) for c in df.columns if c not in columns], *[F.col("made").getField(k).alias(k) for k in columns])
