"""Specification, preprocessing and extraction queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import preprocess as P
from ..operators import specs as S
from ..sources import checkpoints as K
from ..sources import tables as T
from .tables import read, scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# A specification for each part: a third have subgroups, a quarter are aggregates of the parts before them.
_SOURCES = """CASE WHEN p_partkey % 8 = 0 THEN array(concat('f', p_partkey - 1), concat('{"feature_name": "f', p_partkey - 2, '", "specific_subgroups": ["left"]}'), concat('f', p_partkey - 3))
 WHEN p_partkey % 4 = 0 THEN array(concat('f', p_partkey - 1)) END"""


def specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = "CASE p_partkey % 3 WHEN 0 THEN array('left', 'right') WHEN 1 THEN CAST(array() AS array<string>) END"
    flag = "CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END"
    return read(spark, sf_dir, "part").selectExpr("concat('f', p_partkey) AS feature_name", f"{groups} AS specific_subgroups", "p_name AS description", "p_brand AS instructions", f"{flag} AS is_aggregated", f"{_SOURCES} AS aggregated_from", "CAST(NULL AS STRING) AS status")


def _expanded(back: int) -> str:
    """SQL of the flat names of a part so many before."""
    q = f"(p_partkey - {back})"
    return f"CASE WHEN {q} % 3 = 0 AND {q} IN (SELECT p_partkey FROM part) THEN ['f' || {q} || '_left', 'f' || {q} || '_right'] ELSE ['f' || {q}] END"


#: Specifications of DuckDB: flat, with the list of sources.
FLAT = f"""flat AS (
  SELECT p_partkey, 'f' || p_partkey || unnest(CASE WHEN p_partkey % 3 = 0 THEN ['_left', '_right'] ELSE [''] END) AS feature_name, p_name AS description, p_brand AS instructions,
         CASE WHEN p_partkey % 8 = 0 THEN list_concat(list_concat({_expanded(1)}, ['f' || (p_partkey - 2) || '_left']), {_expanded(3)}) WHEN p_partkey % 4 = 0 AND len({_expanded(1)}) > 1 THEN {_expanded(1)} END AS sources
  FROM part)"""


@query(f"WITH {FLAT} SELECT feature_name, description, instructions, sources IS NOT NULL AS is_aggregated, array_to_string(sources, ',') AS sources FROM flat")
def flatten_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = S.flatten(specifications(spark, sf_dir))
    return flat.select("feature_name", "description", "instructions", "is_aggregated", F.array_join("aggregated_from", ",").alias("sources"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review of five sixths of the specifications, with names that aren't known and rows without one."""
    parts = read(spark, sf_dir, "part")
    known = parts.filter("p_partkey % 6 <> 4").selectExpr(
        "CASE WHEN p_partkey % 11 <> 0 THEN concat('f', p_partkey) END AS feature_name",
        "CASE p_partkey % 6 WHEN 0 THEN 'drop' WHEN 1 THEN 'edited' WHEN 2 THEN 'aligned' WHEN 3 THEN 'new' ELSE 'odd' END AS status",
        "CASE WHEN p_partkey % 6 <> 3 THEN concat('edited ', p_name) END AS description",
        "CASE WHEN p_partkey % 6 = 3 THEN 'anew' END AS instructions",
    )
    fresh = parts.filter("p_partkey % 7 = 0").selectExpr("concat('g', p_partkey) AS feature_name", "CASE WHEN p_partkey % 14 = 0 THEN 'drop' ELSE 'unknown' END AS status", "p_type AS description", "CAST(NULL AS STRING) AS instructions")
    return S.merge_status(specifications(spark, sf_dir).select("feature_name", "description", "instructions"), known.union(fresh))


_MERGED = """(SELECT 'f' || p_partkey AS feature_name, CASE WHEN r = 1 THEN 'edited ' || p_name ELSE p_name END AS description, CASE WHEN r = 3 THEN 'anew' ELSE p_brand END AS instructions,
  CASE r WHEN 0 THEN 'dropped' WHEN 1 THEN 'edited' WHEN 2 THEN 'aligned' WHEN 3 THEN 'new' WHEN 5 THEN 'odd' ELSE 'kept' END AS status
 FROM (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 4 ELSE p_partkey % 6 END AS r FROM part)
 UNION ALL SELECT 'g' || p_partkey, p_type, NULL, 'new' FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 14 <> 0)"""


@query(f"SELECT * FROM {_MERGED}")
def merge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@query(f"SELECT status, count(*) AS n_features FROM {_MERGED} GROUP BY 1")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.status_summary(_merged(spark, sf_dir))


@query("""SELECT 'f' || p_partkey AS feature_name, CASE r WHEN 1 THEN 'description' ELSE 'instructions' END AS field, CASE r WHEN 1 THEN p_name ELSE p_brand END AS old, CASE r WHEN 1 THEN 'edited ' || p_name ELSE 'anew' END AS new
 FROM (SELECT *, p_partkey % 6 AS r FROM part WHERE p_partkey % 11 <> 0) WHERE r IN (1, 3)""")
def spec_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.diff(specifications(spark, sf_dir), _merged(spark, sf_dir))


@query("""SELECT 'o' || l_orderkey AS feature_name, string_agg('f' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS sources FROM lineitem
 WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY l_orderkey HAVING count(*) > 1""")
def prune_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate for each order, of the parts in it; those of some size are still alive."""
    lines = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("feature_name"), F.struct("l_linenumber", "l_partkey").alias("s"))
    aggregates = lines.groupBy("feature_name").agg(F.array_sort(F.collect_list("s")).alias("s")).select("feature_name", F.transform("s", lambda x: F.concat(F.lit("f"), x["l_partkey"])).alias("aggregated_from"))
    alive = read(spark, sf_dir, "part").filter("p_size > 25").select(F.concat(F.lit("f"), "p_partkey").alias("feature_name"))
    return S.prune(aggregates, alive).select("feature_name", F.array_join("aggregated_from", ",").alias("sources"))


@query("SELECT 'f' || l_partkey AS feature_name, count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def removed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of features that aren't marked for removal; their specs go alike."""
    values = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), "l_partkey").alias("feature_name"), "l_quantity")
    specs = read(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_partkey").alias("feature_name"), "p_size")
    kept, left = S.without_removed(values, specs, specs.filter("p_size <= 25"))
    return kept.join(left, "feature_name", "left_semi").groupBy("feature_name").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("total"))


@query(f"WITH {FLAT} SELECT feature_name, sources IS NOT NULL AS is_aggregated, array_to_string(sources, ',') AS sources FROM flat")
def spec_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs parted by having sources, and put together again."""
    plain, aggregates = S.parts(S.flatten(specifications(spark, sf_dir)))
    return S.joined(plain.drop("aggregated_from"), aggregates).select("feature_name", "is_aggregated", F.array_join("aggregated_from", ",").alias("sources"))


@query("""SELECT 'f' || p_partkey AS feature_name, CASE p_partkey % 3 WHEN 0 THEN 'left,right' WHEN 1 THEN '' END AS subgroups,
 CASE WHEN p_partkey % 8 = 0 THEN 'f' || (p_partkey - 1) || ';{"feature_name": "f' || (p_partkey - 2) || '", "specific_subgroups": ["left"]};f' || (p_partkey - 3) WHEN p_partkey % 4 = 0 THEN 'f' || (p_partkey - 1) END AS sources FROM part""")
def specs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications written with a time stamp as JSON, and read back."""
    folder = scratch(spark, "specs")
    T.write_versioned(specifications(spark, sf_dir), folder, "specs", "json")
    got = T.read_specs(spark, f"{folder}/specs/*")
    return got.select("feature_name", F.array_join("specific_subgroups", ",").alias("subgroups"), F.array_join("aggregated_from", ";").alias("sources"))


@query("SELECT doc_id, chunk, row_idx, floor((row_number() OVER (PARTITION BY chunk ORDER BY doc_id) - 1) / 20)::INT AS batch FROM (SELECT doc_id, (ntile(7) OVER (ORDER BY doc_id) - 1)::INT AS chunk, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS row_idx FROM documents)")
def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunks(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 7, 20)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pending(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT DISTINCT p_type AS feature_name FROM part WHERE p_type NOT IN ('SMALL', 'LARGE')")
def new_feature_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("SMALL",), ("LARGE",)], "feature_name string")
    found = read(spark, sf_dir, "part").select(F.col("p_type").alias("feature_name"))
    return found.dropDuplicates(["feature_name"]).join(known, "feature_name", "left_anti")


_CUSTOMER = "(SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 25 = 0 THEN 1 END AS rare FROM customer)"


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(key, "c_name", "c_mktsegment", F.when(key % 4 != 0, F.col("c_acctbal")).alias("balance"), F.when(key % 25 == 0, 1).alias("rare"))


_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, round(avg(({c} IS NULL)::INT::DOUBLE), 6) AS missing FROM {_CUSTOMER}" for c in ("c_custkey", "c_name", "c_mktsegment", "balance", "rare"))


@query(_PROFILE)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(_customer(spark, sf_dir)).select("column", "n_rows", "n_distinct", F.round("missing", 6).alias("missing"))


@query(f"SELECT \"column\" FROM ({_PROFILE}) WHERE \"column\" IN ('c_name', 'c_mktsegment') AND n_distinct::DOUBLE / n_rows > 0.10")
def high_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.profile(_customer(spark, sf_dir).select("c_name", "c_mktsegment"))
    return found.filter(F.col("n_distinct") / F.col("n_rows") > 0.10).select("column")


@query(f"SELECT \"column\" FROM ({_PROFILE}) WHERE missing >= 0.95")
def mostly_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(_customer(spark, sf_dir)).filter("missing >= 0.95").select("column")


@query("SELECT p_partkey, (p_type = 'LARGE')::INT::DOUBLE AS p_type_LARGE, (p_type = 'MEDIUM')::INT::DOUBLE AS p_type_MEDIUM, (p_type = 'PROMO')::INT::DOUBLE AS p_type_PROMO, (p_type = 'SMALL')::INT::DOUBLE AS p_type_SMALL, (p_type = 'STANDARD')::INT::DOUBLE AS p_type_STANDARD FROM part")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return P.one_hot(part, "p_type", P.categories(part, "p_type"), ["p_partkey"])


@query("SELECT doc_id, d.n_chars AS n_chars_0, l.quality, l.n AS n_chars_1 FROM documents d JOIN (SELECT doc_id, quality, toxic AS n FROM labels) l USING (doc_id)")
def feature_set_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", F.col("toxic").alias("n_chars"))
    return P.combine([docs, labels], "doc_id")


@query("SELECT d.doc_id, d.n_chars AS left_value, CASE WHEN d.doc_id % 10 = 0 THEN d.n_chars + 1 END AS right_value FROM documents d WHERE d.doc_id % 10 = 0 OR d.doc_id % 7 = 0")
def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    k = F.col("doc_id")
    other = docs.filter((k % 7 != 0) | (k % 10 == 0)).select("doc_id", F.when(k % 10 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"))
    return P.misaligned(docs, other, "doc_id", "n_chars")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "text")
    return X.extract_native(docs, {"first_number": ("number", r"([0-9]{1,9})"), "licensed": ("flag", r"[Ll]icense"), "n_marks": ("count", r"[!?]")})


_LONG = """(SELECT doc_id AS row_idx, 'first_number' AS feature_name, try_cast(nullif(regexp_extract(text, '([0-9]{1,9})', 1), '') AS DOUBLE) AS value FROM documents
 UNION ALL SELECT doc_id, 'licensed', regexp_matches(text, '[Ll]icense')::INT::DOUBLE FROM documents
 UNION ALL SELECT doc_id, 'n_marks', len(regexp_extract_all(text, '[!?]'))::DOUBLE FROM documents)"""


@query(f"SELECT * FROM {_LONG}")
def extract_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir)


_BACKEND = {"first_number": r"(\d+)", "licensed": "icense", "shout": "[A-Z]{3,}!"}


@query(r"""SELECT doc_id AS row_idx, unnest(['first_number', 'licensed', 'shout']) AS feature_name,
 unnest([nullif(regexp_extract(t, '[0-9]+'), '')::DOUBLE, CASE WHEN contains(t, 'icense') THEN 1.0::DOUBLE END, CASE WHEN regexp_matches(t, '[A-Z]{3,}!') THEN 1.0::DOUBLE END]) AS value
 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def extract_paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by calls of a backend, a bounded number in flight, each reply logged; the second run finds them all."""
    notes = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "text")
    folder, names = scratch(spark, "replies"), list(_BACKEND)
    half = notes.filter("row_idx % 2 = 0")
    X.extract_logged(half, names, X.RuleBackend(_BACKEND), folder, wait=0.0)
    return X.extract_logged(notes, names, X.RuleBackend(_BACKEND), folder, wait=0.0).drop("error")


@query(f"SELECT row_idx, max(value) FILTER (feature_name = 'first_number') AS first_number, max(value) FILTER (feature_name = 'licensed') AS licensed, max(value) FILTER (feature_name = 'n_marks') AS n_marks FROM {_LONG} GROUP BY 1")
def extract_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.wide(_long(spark, sf_dir), ["first_number", "licensed", "n_marks"])


@query(f"SELECT feature_name, round(100.0::DOUBLE * avg((value IS NULL)::INT::DOUBLE), 2) AS missing_percent FROM {_LONG} GROUP BY 1")
def missing_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.missing_percent(_long(spark, sf_dir))


@query(f"""SELECT feature_name, CASE WHEN gone >= 95 THEN 'remove' WHEN gone >= 50 AND feature_name = 'first_number' THEN 'remove' WHEN gone >= 50 THEN 'reextract' ELSE 'proceed' END AS decision
FROM (SELECT feature_name, round(100.0::DOUBLE * avg((value IS NULL)::INT::DOUBLE), 2) AS gone FROM {_LONG} GROUP BY 1)""")
def validate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spark.createDataFrame([("first_number", 3), ("licensed", 0), ("n_marks", 1)], "feature_name string, validation_count int")
    return X.decide(P.missing_percent(_long(spark, sf_dir)), counts).select("feature_name", "decision")


@query(f"SELECT row_idx, greatest(max(value) FILTER (feature_name = 'n_marks'), max(value) FILTER (feature_name = 'licensed')) AS top, count(value) FILTER (feature_name IN ('n_marks', 'first_number')) AS known FROM {_LONG} GROUP BY 1")
def declarative_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.aggregate_features(_long(spark, sf_dir), {"top": ("max", ["n_marks", "licensed"]), "known": ("count", ["n_marks", "first_number"])})


def _judge(name: str, values) -> tuple[str, str]:
    """A column is removed if nothing is known of it, extracted again if less than half, else it may go on."""
    known = int(values.notna().sum())
    decision = "remove" if known == 0 else "reextract" if 2 * known < len(values) else "proceed"
    return decision, f"{known} of {len(values)}"


@query(f"SELECT feature_name, CASE WHEN count(value) = 0 THEN 'remove' WHEN 2 * count(value) < count(*) THEN 'reextract' ELSE 'proceed' END AS decision, count(value) || ' of ' || count(*) AS reasoning FROM {_LONG} GROUP BY 1")
def validated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.validated(_long(spark, sf_dir), _judge)


def _rounds(notes: DataFrame, todo: list[str], k: int) -> DataFrame:
    """Values that depend on the round: one feature is never found, one seldom at first, one late, one at once."""
    late = F.when(F.col("row_idx") % 10 >= 9 - 3 * k, F.lit(float(k)))
    made = {"never": F.lit(None).cast("double"), "late": late, "seldom": F.when(F.col("row_idx") % 10 >= 6, 1.0), "at_once": F.col("row_idx").cast("double")}
    pairs = F.array(*[F.struct(F.lit(n).alias("feature_name"), made[n].alias("value")) for n in todo])
    return notes.select("row_idx", F.explode(pairs).alias("f")).select("row_idx", "f.*")


@query("""SELECT doc_id AS row_idx, 'at_once' AS feature_name, doc_id::DOUBLE AS value FROM documents
UNION ALL SELECT doc_id, 'late', CASE WHEN doc_id % 10 >= 3 THEN 2::DOUBLE END FROM documents""")
def extraction_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted and validated until nothing is pending: what is never found goes, and what stays bad after three validations."""
    notes = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"))
    store = K.Checkpoints(spark, scratch(spark, "loop"))
    out, _ = X.fixpoint(notes, ["never", "late", "seldom", "at_once"], _rounds, lambda df, k: store.save(df, f"round-{k}"))
    return out
