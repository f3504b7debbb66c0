"""Fill-in-the-middle transformation of whole texts.

A text is cut into units, ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``,
and its prefix and middle end after two of their borders, which a digest of seed and
id draws. A text is decoded to an array of its code points; where white space follows
something else, a unit ends; two of these borders cut it, and the pieces are encoded
again. Memory is that of one text at a time.

A null text counts as empty. Empty texts, and those that contain a sentinel, stay
plain, so that ``restore`` gives every text back exactly. A null id is drawn for as
the empty string, and rows of equal ids are cut at the same draws. Columns other than
those to keep are not returned; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .common import bounded_batches, pieces

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
SEED = 42
#: Of 100 texts, those that are cut, and of 100 of these, those whose suffix comes first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 50, 80
_MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def borders(points: np.ndarray) -> np.ndarray:
    """Where units begin and end: one number more than there are units."""
    space = (points == 32) | ((points >= 9) & (points <= 13))
    inner = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)] if len(points) else []]).astype(np.int64)


def draws(seed: int, key: object) -> list[int]:
    """Four unsigned 32-bit numbers for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str | None, key: object, seed: int, cut: int, suffix_first: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and of middle (None if plain), and the output."""
    text = text or ""
    points = code_points(text)
    ends = borders(points)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= cut or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    a, b = ends[sorted((h1 % (n + 1), h2 % (n + 1)))].tolist()
    before, within, after = (points[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, len(points))))
    p, s, m = sentinels
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, "".join((s, after, p, before, m, within))
    return n, "psm", a, b - a, "".join((p, before, s, after, m, within))


def _checked(sentinels: tuple[str, str, str]) -> None:
    """No sentinel may be found across the border of another and a piece, or within another."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"sentinels overlap: {sentinels}")


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Columns ``keep``, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output of every row.

    psm is prefix, suffix, middle, spm suffix, prefix, middle, each after its
    sentinel. Columns of ``keep`` named like a result are left out.
    """
    _checked(sentinels)
    bounded_batches(df.sparkSession)
    keep = tuple(c for c in keep if c not in _MADE)
    taken = df.select(F.col(key).cast("string").alias("fim_key"), F.col(text).alias("fim_text"), *[F.col(c).alias(f"fim_{i}") for i, c in enumerate(keep)])
    schema = df.select(*keep).schema
    for name, kind in zip(_MADE, (LongType(), StringType(), LongType(), LongType(), StringType()), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "fim_text"):
                rows = [transformed(t, k, seed, cut_percent, suffix_first_percent, sentinels) for t, k in zip(texts, part.column(0).to_pylist(), strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                made = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *made], [*keep, *_MADE])

    return taken.mapInArrow(run, schema)


def restore(df: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``df`` with ``restored``, the text that column ``output`` was made from by column ``form``."""
    p, s, m = sentinels
    out = F.col("output")

    def between(first: str, then: str):
        return F.split_part(F.split_part(out, F.lit(then), F.lit(1)), F.lit(first), F.lit(2))

    middle = F.split_part(out, F.lit(m), F.lit(2))
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return df.withColumn("restored", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(out))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of output and restored text."""
    both = restore(transform(df))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
