"""Feature definitions and experts' features, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grades as G
from ..operators import definition as D
from ..operators import expert as E
from ..operators import similar as N
from ..operators import specs as S
from .tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_CHUNKS, _EDIT_AT, _NEW_AT = 5, 5, 2
_KEYWORDS = {"english": " the ", "french": " de ", "licensed": "icense"}
_OFFERS = {"german": " und "}


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = S.chunks(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], _CHUNKS, D.BATCH)
    start = [{"feature_name": n, "description": n, "instructions": "count"} for n in _KEYWORDS]
    return D.align(notes.select("row_idx", "text", "chunk", "batch"), start, D.KeywordAligner(_KEYWORDS, _EDIT_AT, _OFFERS, _NEW_AT))


_HITS = "SELECT chunk, batch, {cases} FROM (SELECT coalesce(text, '') AS text, chunk, floor((row_number() OVER (PARTITION BY chunk ORDER BY doc_id) - 1) / 10)::INT AS batch FROM (SELECT doc_id, text, (ntile(5) OVER (ORDER BY doc_id) - 1)::INT AS chunk FROM documents)) GROUP BY 1, 2"
_COUNTED = "hits AS (" + _HITS.format(cases=", ".join(f"count(*) FILTER (contains(text, '{k}')) AS {n}" for n, k in (_KEYWORDS | _OFFERS).items())) + ")"
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT chunk, batch, '{n}' AS feature_name, {n} AS n FROM hits" for n in _KEYWORDS) + ")"
_STATES = f"""WITH {_COUNTED}, {_LONG},
known AS (SELECT chunk, batch, feature_name, feature_name || array_to_string(list(CASE WHEN n >= {_EDIT_AT} THEN '+' || n ELSE '' END) OVER w, '') AS description, 'count' AS instructions,
  CASE WHEN n >= {_EDIT_AT} THEN 'edited' WHEN n = 0 THEN 'dropped' ELSE 'aligned' END AS status FROM long WINDOW w AS (PARTITION BY chunk, feature_name ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
offered AS (SELECT chunk, min(batch) AS first, arg_min(german, batch) AS n FROM hits WHERE german >= {_NEW_AT} GROUP BY 1),
states AS (SELECT * FROM known UNION ALL SELECT h.chunk, h.batch, 'german', 'seen ' || o.n, NULL, 'new' FROM hits h JOIN offered o ON h.chunk = o.chunk AND h.batch >= o.first)"""


@query(f"{_STATES} SELECT * FROM states")
def align_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitions after each batch: a sequential fold in each chunk."""
    return _progress(spark, sf_dir)


_LAST = f"{_STATES}, last AS (SELECT chunk, feature_name, description, instructions, status FROM states QUALIFY batch = max(batch) OVER (PARTITION BY chunk))"


@query(f"{_LAST} SELECT * FROM last ORDER BY chunk, feature_name")
def aligned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each chunk ends with, in order of chunk."""
    return D.last_state(_progress(spark, sf_dir))


@query(f"{_LAST} SELECT feature_name, arg_min(description, chunk) AS description, arg_min(coalesce(instructions, '-'), chunk) AS instructions, count(*) AS n_chunks FROM last WHERE status <> 'dropped' GROUP BY 1")
def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One definition for each name that a chunk kept."""
    merged = D.union_of_chunks(D.last_state(_progress(spark, sf_dir)))
    return merged.withColumn("instructions", F.coalesce("instructions", F.lit("-")))


_NAME = "concat_ws(' ', p_brand, p_type, CASE WHEN p_size > 40 THEN 'large' WHEN p_size < 10 THEN 'small' END)"
_PERCENT = 75


@query(f"""WITH RECURSIVE names AS (SELECT DISTINCT {_NAME} AS name FROM part),
sets AS (SELECT name, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> ''))) AS words FROM names),
links AS (SELECT a.name AS a, b.name AS b FROM sets a, sets b WHERE a.name <> b.name AND 100 * len(list_intersect(a.words, b.words)) >= {_PERCENT} * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))),
reach AS (SELECT name AS a, name AS b FROM names UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT a AS feature_name, min(b) AS cluster FROM reach GROUP BY 1""")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, with the first of those that similar names link them with."""
    return N.clusters(read(spark, sf_dir, "part").selectExpr(f"{_NAME} AS feature_name"), percent=_PERCENT)


@query(f"{_LAST} SELECT chunk, feature_name, description, instructions FROM last WHERE status <> 'dropped'")
def final_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions without those dropped, and without status."""
    return S.final(D.last_state(_progress(spark, sf_dir)))


class _Reader:
    """A backend that reads the first notes before it proposes a feature of each."""

    def complete(self, prompt: str) -> str:
        read_so_far = prompt.count("<RESULT>")
        if read_so_far < 3:
            return f'<TOOL>{{"name": "get_note", "parameters": {{"index": {read_so_far}}}}}</TOOL>'
        lengths = [len(x.partition("</RESULT>")[0]) for x in prompt.split("<RESULT>")[1:]]
        found = [{"feature_name": f"note_{i}", "description": str(n)} for i, n in enumerate(lengths)]
        return f"<JSON>{json.dumps(found)}</JSON>"


@query("SELECT 'note_' || doc_id AS feature_name, length(text)::VARCHAR AS description FROM documents WHERE doc_id < 3")
def proposed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features proposed by a backend that reads notes by a tool."""
    notes = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "text")
    found, _ = D.propose(notes, _Reader(), "notes", "outcome")
    return found.select("feature_name", "description")


# -- experts' features --------------------------------------------------------------

_PATTERNS = ["3+3", "3+4", "4+3", "4+4", "4+5", "5+5", "null", "2+2", "5+3=8"]


def _raw(i: int) -> dict[str, str]:
    """SQL of a region's columns, by arithmetic on the key."""
    pattern = "CASE (p_partkey + {i}) % 10 ".format(i=i) + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PATTERNS)) + " END"
    return {
        "percent_involved": f"CASE WHEN (p_partkey * {i + 3}) % 5 > 1 THEN CAST((p_partkey * {i + 7}) % 4 * 25 AS DOUBLE) END",
        "gleason_pattern": pattern,
        "histology": f"CASE (p_partkey + {2 * i}) % 3 WHEN 0 THEN 'Adenocarcinoma, acinar' WHEN 1 THEN 'benign' END",
    }


_RAW = ", ".join(f"{sql} AS {r}_{part}" for i, r in enumerate(E.REGIONS) for part, sql in _raw(i).items())
_FINDINGS = ", ".join(f"CASE (p_partkey + {k}) % 3 WHEN 0 THEN 'Present' WHEN 1 THEN 'Absent' ELSE 'Not Mentioned' END AS {f}" for k, f in enumerate(E.FINDINGS))
_TABLE = f"(SELECT p_partkey AS row_idx, {_RAW}, (p_partkey % 2)::INT AS {E.NODES}, {_FINDINGS} FROM part)"
_PART = r"nullif(regexp_extract({r}_gleason_pattern, '^(\d+)\+(\d+)', {k}), '')::INT"
_GRADE = "CASE {r}_gleason_pattern " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in G.GRADES.items()) + " ELSE 0 END"
_REGIONAL = ", ".join(
    f"CASE WHEN coalesce(contains(lower({r}_histology), 'adenocarcinoma'), false) THEN {_GRADE.format(r=r)} ELSE 0 END AS {r}_gleason_grade, {_PART.format(r=r, k=1)} AS {r}_primary, {_PART.format(r=r, k=2)} AS {r}_secondary" for r in E.REGIONS
)
_WEIGHTED = ", ".join(
    f"CASE WHEN {r}_primary IS NOT NULL AND {r}_secondary IS NOT NULL THEN (CASE WHEN {r}_primary >= 4 THEN {r}_primary * 0.75::DOUBLE ELSE 0 END) + (CASE WHEN {r}_secondary >= 4 THEN {r}_secondary * 0.25::DOUBLE ELSE 0 END) END AS {r}_gleason_pattern_four_five"
    for r in E.REGIONS
)


def _greatest(part: str) -> str:
    return f"greatest({', '.join(f'{r}_{part}' for r in E.REGIONS)})"


def _mean(part: str) -> str:
    return f"round(list_avg(list_filter([{', '.join(f'{r}_{part}' for r in E.REGIONS)}], lambda x: x IS NOT NULL)), 6)"


def _any(regions) -> str:
    return "(" + " OR ".join(f"coalesce({r}_percent_involved > 0, false)" for r in regions) + ")"


_OVER = f"""{_greatest('gleason_grade')} AS max_gleason_grade, {_greatest('primary')} AS max_gleason_primary, {_greatest('secondary')} AS max_gleason_secondary,
 {_greatest('gleason_pattern_four_five')} AS gleason_four_five_max, {_mean('gleason_pattern_four_five')} AS gleason_four_five, {_mean('percent_involved')} AS percent_involved_mean, {_greatest('percent_involved')} AS percent_involved_max,
 round(({' + '.join(_any([r for r in E.REGIONS if f'_{v}_' in r]) + '::INT' for v in E.LEVELS)}) * 100.0::DOUBLE / 3, 6) AS percent_pos_regions,
 round(({' + '.join(_any([r]) + '::INT' for r in E.REGIONS)}) * 100.0::DOUBLE / 12, 6) AS percent_pos_cores,
 ({' AND '.join(_any([r for r in E.REGIONS if r.startswith(s)]) for s in E.SIDES)})::INT AS bilateral"""


@query(f"SELECT * REPLACE (CASE PNI WHEN 'Present' THEN 1 WHEN 'Absent' THEN 0 END AS PNI), {_OVER} FROM (SELECT *, {_WEIGHTED} FROM (SELECT *, {_REGIONAL} FROM {_TABLE}))")
def expert_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the experts' table: 43 that are read and 58 that follow from them."""
    regional = [f"{sql} AS {r}_{part}" for i, r in enumerate(E.REGIONS) for part, sql in _raw(i).items()]
    findings = [f"CASE (p_partkey + {k}) % 3 WHEN 0 THEN 'Present' WHEN 1 THEN 'Absent' ELSE 'Not Mentioned' END AS {f}" for k, f in enumerate(E.FINDINGS)]
    raw = read(spark, sf_dir, "part").selectExpr("p_partkey AS row_idx", *regional, f"CAST(p_partkey % 2 AS INT) AS {E.NODES}", *findings)
    out = E.with_derived(raw)
    return out.withColumns({c: F.round(c, 6) for c in ("gleason_four_five", "percent_involved_mean", "percent_pos_regions", "percent_pos_cores")})

