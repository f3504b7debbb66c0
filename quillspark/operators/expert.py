"""Features that experts fixed beforehand: regions of an organ and a few findings, and what follows from them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grades as G
from .extract import Backend

#: Sides, levels and zones that make the regions; what each region has; findings.
SIDES, LEVELS, ZONES = ("left", "right"), ("apex", "mid", "base"), ("lateral", "medial")
REGIONS = tuple(f"{s}_{v}_{z}" for s in SIDES for v in LEVELS for z in ZONES)
PARTS = {"percent_involved": "double", "gleason_pattern": "string", "histology": "string"}
FINDINGS = ("PNI", "cribriform", "IDC", "EPE", "SVI", "surgical_margin")
NODES = "TNM_N"


def raw_columns() -> dict[str, str]:
    """Names and types of what is read from a note."""
    return {f"{r}_{p}": t for r in REGIONS for p, t in PARTS.items()} | {NODES: "int"} | dict.fromkeys(FINDINGS, "string")


def regional_prompt(note: str) -> str:
    wanted = {f"{r}_{p}": None for r in REGIONS for p in PARTS} | {NODES: None}
    return (
        "Fill in this JSON object from the report and return it alone. percent_involved is a whole percentage, 0 if none is given; "
        f"gleason_pattern is like 3+4, histology a kind of tissue, {NODES} 0 or 1; null where nothing is said.\n{json.dumps(wanted)}\n<NOTE>{note}</NOTE>"
    )


def findings_prompt(note: str) -> str:
    wanted = dict.fromkeys(FINDINGS, "Not Mentioned")
    return f"Fill in this JSON object from the report with Present, Absent or Not Mentioned, for the margin Positive (and where) or Negative, and return it alone.\n{json.dumps(wanted)}\n<NOTE>{note}</NOTE>"


def parse(reply: str | None) -> dict:
    """The reply as an object, or what stands from its first { to its last }; else empty."""
    found = re.search(r"\{.*\}", reply or "", re.S)
    for text in (reply or "", found[0] if found else ""):
        try:
            got = json.loads(text)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return {}


def extract(notes: DataFrame, backend: Backend) -> DataFrame:
    """(row_idx, …) with the columns of ``raw_columns``: two prompts a note; what isn't in a reply is null."""
    columns = raw_columns()

    def typed(value: object, kind: str) -> object:
        if value is None or value == "null":
            return None
        if kind == "string":
            return str(value)
        try:
            return float(value) if kind == "double" else int(float(value))
        except (TypeError, ValueError):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["row_idx"], b["text"], strict=True):
                got = parse(backend.complete(regional_prompt(text or ""))) | parse(backend.complete(findings_prompt(text or "")))
                rows.append((i, *[typed(got.get(c), t) for c, t in columns.items()]))
            yield pd.DataFrame(rows, columns=["row_idx", *columns])

    return notes.select("row_idx", "text").mapInPandas(run, "row_idx long, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


def with_derived(df: DataFrame) -> DataFrame:
    """``df`` with the derived columns: four a region, ten over all regions; the first finding becomes 1, 0 or null."""
    regional: dict[str, Column] = {}
    for r in REGIONS:
        pattern, histology = F.col(f"{r}_gleason_pattern"), F.col(f"{r}_histology")
        regional |= {f"{r}_gleason_grade": G.grade(pattern, histology), f"{r}_primary": G.pattern_part(pattern, 1), f"{r}_secondary": G.pattern_part(pattern, 2), f"{r}_gleason_pattern_four_five": G.weighted_high(pattern)}
    of = lambda part, regions=REGIONS: [F.col(f"{r}_{part}") for r in regions]
    levels = [of("percent_involved", [r for r in REGIONS if f"_{v}_" in r]) for v in LEVELS]
    sides = [of("percent_involved", [r for r in REGIONS if r.startswith(s)]) for s in SIDES]
    over = {
        "max_gleason_grade": G.row_max(of("gleason_grade")),
        "max_gleason_primary": G.row_max(of("primary")),
        "max_gleason_secondary": G.row_max(of("secondary")),
        "gleason_four_five_max": G.row_max(of("gleason_pattern_four_five")),
        "gleason_four_five": G.row_mean(of("gleason_pattern_four_five")),
        "percent_involved_mean": G.row_mean(of("percent_involved")),
        "percent_involved_max": G.row_max(of("percent_involved")),
        "percent_pos_regions": G.positive_share(levels),
        "percent_pos_cores": G.positive_share([[c] for c in of("percent_involved")]),
        "bilateral": G.bilateral(*sides),
    }
    first = FINDINGS[0]
    return df.withColumns(regional).withColumns(over).withColumn(first, F.when(F.col(first) == "Present", 1).when(F.col(first) == "Absent", 0))
