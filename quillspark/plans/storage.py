"""Readers, writers, checkpoints and preparation of matrices as queries: what comes back must be what went in."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import activations as A
from ..functions import text as T
from ..operators import cohort as C
from ..operators import preprocess as P
from ..operators import vectors as V
from ..sources import checkpoints as K
from ..sources import tables as S_IO
from .tables import read, scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey AS k, o_totalprice AS price, o_orderpriority AS priority FROM orders")
def table_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the catalog, created and then replaced by one with another column; its files lie in the shared folder."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    name = f"quill_{uuid.uuid4().hex}"
    for rows in (orders.filter("k % 2 = 0").drop("priority"), orders):
        S_IO.write_table(rows, name, scratch(spark, name))
    return spark.table(name)


_NOTES = "concat('\"', c_name, '\", ', chr(10), c_mktsegment)"


def _csv(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Structured features, a label, notes with quotes, commas and line feeds, and an unnamed column, as CSV."""
    path = scratch(spark, name)
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), (F.col("c_custkey") % 2).cast("int").alias("outcome"), F.expr(_NOTES).alias("note"), F.lit(1).alias("Unnamed: 0"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


@query(f"SELECT c_custkey, c_acctbal AS balance, c_custkey % 2 AS outcome, {_NOTES} AS note FROM customer")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S_IO.read_csv(spark, _csv(spark, sf_dir, "csv")).drop("Unnamed: 0")


@query(f"SELECT c_custkey AS row_idx, {_NOTES} AS text FROM customer")
def notes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S_IO.read_notes(spark, _csv(spark, sf_dir, "notes"), "c_custkey", "note")


@query("SELECT c_custkey, c_acctbal AS balance, (c_custkey % 2)::INT AS outcome FROM customer")
def structured_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = S_IO.read_structured(spark, _csv(spark, sf_dir, "structured"), "outcome", "c_custkey", "note")
    return x.join(y, "c_custkey").select("c_custkey", "balance", "outcome")


@query("SELECT c_custkey, c_acctbal AS balance FROM customer")
def generated_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S_IO.read_generated(spark, _csv(spark, sf_dir, "generated"), "outcome", "c_custkey", "note")


@query("SELECT 'generated' AS source, count(*) AS n FROM customer UNION ALL SELECT 'notes', count(*) FROM customer")
def load_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by name; one whose path isn't there is left out."""
    path = _csv(spark, sf_dir, "all")
    found = S_IO.read_all(
        spark,
        {
            "notes": (path, lambda s, p: S_IO.read_notes(s, p, "c_custkey", "note").select(F.lit("notes").alias("source"))),
            "generated": (path, lambda s, p: S_IO.read_generated(s, p, "outcome", "c_custkey", "note").select(F.lit("generated").alias("source"))),
            "absent": (f"{path}-absent", lambda s, p: S_IO.read_csv(s, p)),
        },
    )
    out = None
    for df in found.values():
        out = df if out is None else out.union(df)
    return out.groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, 'second' AS version FROM nation")
def versioned_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, nation = scratch(spark, "versions"), read(spark, sf_dir, "nation").select("n_nationkey")
    for stamp, name in (("20200101000000", "first"), ("20210101000000", "second")):
        S_IO.write_versioned(nation.withColumn("version", F.lit(name)), folder, "nation", "csv", stamp)
    return S_IO.read_latest(spark, folder, "nation", "csv")


@query("SELECT vec_id - 0 AS line_key, (unnest(range(3)))::INT AS pos, round(unnest(embedding[1:3])::DOUBLE, 6) AS value FROM embeddings")
def embedding_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written in order of their keys, without header, and read back with line numbers."""
    path = scratch(spark, "vectors")
    K.write_vectors_csv(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3, path)
    got = S_IO.read_embeddings_csv(spark, path, 3)
    return got.select("line_key", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", 6))


_VECTOR = "[length(text), len(regexp_extract_all(text, 'a')), len(regexp_extract_all(text, ' '))]"


def _counts(texts: list[str]) -> list[list[float]]:
    """A deterministic embedder that fails on empty texts."""
    return [[len(t), t.count("a"), t.count(" ")] for t in texts if t]


@query(f"SELECT doc_id, (unnest(range(3)))::INT AS pos, unnest(CASE WHEN text = '' OR text IS NULL OR doc_id % 9 = 0 THEN [0, 0, 0] ELSE {_VECTOR} END)::DOUBLE AS value FROM documents")
def embedding_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors made in parts, the first of which an earlier run finished; zeros where the embedder fails."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text"))
    store = K.Checkpoints(spark, scratch(spark, "scan"))
    first = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    K.embed(first, _counts, "doc_id", "text", 3, wait=0.0).write.parquet(f"{store.folder}/vectors/part=0")
    store.finish("vectors", 0)
    made = K.embed_in_parts(store, "vectors", docs, _counts, "doc_id", "text", 3, parts=4, wait=0.0)
    return made.select("doc_id", F.posexplode("embedding").alias("pos", "value"))


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def frame_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table saved twice; the later one is loaded."""
    store = K.Checkpoints(spark, scratch(spark, "frames"))
    nation = read(spark, sf_dir, "nation")
    store.save(nation.limit(1), "nation")
    store.save(nation, "nation")
    return store.load("nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"))


@query("""SELECT string_agg(chunk::VARCHAR, ',' ORDER BY chunk) FILTER (NOT todo) AS done, string_agg(chunk::VARCHAR, ',' ORDER BY chunk) FILTER (todo) AS todo, round(100.0::DOUBLE * count(*) FILTER (NOT todo) / 16, 2) AS percent,
 count(*) FILTER (todo) = 0 AS removed_early, true AS removed
 FROM (SELECT i AS chunk, coalesce(n % 2, 1) = 1 AS todo FROM range(16) t(i) LEFT JOIN (SELECT doc_id % 16 AS chunk, count(DISTINCT source) + max(n_chars) AS n FROM documents GROUP BY 1) d ON d.chunk = i)""")
def chunk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents, 16 of them, finished if what they hold comes to an even number; the others are finished next."""
    store = K.Checkpoints(spark, scratch(spark, "chunks"))
    counted = read(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 16).alias("chunk")).agg((F.count_distinct("source") + F.max("n_chars")).alias("n"))
    for r in counted.filter("n % 2 = 0").orderBy(F.desc("chunk")).collect():  # a row a chunk
        store.finish("align", r["chunk"])
    p = store.progress("align", 16)
    early = store.clean_up("align", 16)
    for chunk in p["left"]:
        store.finish("align", chunk)
    late = early or store.clean_up("align", 16) and not store.exists("align-chunks")
    rows = [(",".join(map(str, p["done"])) or None, ",".join(map(str, p["left"])) or None, p["percent"], early, late)]
    return spark.createDataFrame(rows, "done string, todo string, percent double, removed_early boolean, removed boolean")


@query("SELECT * FROM (SELECT 'orders' AS name, count(*)::VARCHAR AS value, true AS found FROM orders UNION ALL SELECT 'last', max(o_orderkey)::VARCHAR, true FROM orders UNION ALL SELECT 'after', NULL, false)")
def state_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a table was seen, replaced as it goes on, read, and removed."""
    store, orders = K.Checkpoints(spark, scratch(spark, "state")), read(spark, sf_dir, "orders")
    for part in (orders.filter("o_orderkey % 2 = 0"), orders):
        n, last = part.agg(F.count("*"), F.max("o_orderkey")).first()
        store.put("main", {"orders": n, "last": last})
    value, there = store.get("main"), store.exists("main")
    store.remove("main")
    return spark.createDataFrame([*[(k, str(v), there) for k, v in value.items()], ("after", None, store.exists("main"))], "name string, value string, found boolean")


@query("SELECT role AS kind, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM conversations WHERE turn > 0 GROUP BY 1")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn logged with the turn before it, in two appends."""
    store = K.Checkpoints(spark, scratch(spark, "audit"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    rows = turns.join(before, ["conv_id", "turn"]).select(F.col("role").alias("kind"), F.concat_ws("/", "conv_id", "turn").alias("key"), "prompt", F.col("text").alias("response"))
    for half in (0, 1):
        store.log_table(rows.filter(F.pmod(F.xxhash64("key"), F.lit(2)) == half))
    return spark.read.parquet(f"{store.folder}/audit").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("response")).alias("n_chars"))


@query("SELECT * FROM (SELECT 'rows' AS name, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'customers', count(DISTINCT o_custkey)::VARCHAR FROM orders UNION ALL SELECT 'seed', '7')")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "summary")
    rows, customers = read(spark, sf_dir, "orders").agg(F.count("*"), F.count_distinct("o_custkey")).first()
    S_IO.write_summary(spark, {"rows": rows, "customers": customers, "seed": 7}, path)
    got = json.loads(spark.read.text(path).first()[0])
    return spark.createDataFrame([(k, str(v)) for k, v in got.items()], "name string, value string")


_GIVEN = "CASE o_orderkey % 7 WHEN 0 THEN 'AUC-ROC' WHEN 1 THEN 'F1 Score' WHEN 2 THEN ' auprc' WHEN 3 THEN 'Acc' WHEN 4 THEN 'Average  Precision' WHEN 5 THEN o_orderpriority ELSE concat(o_orderpriority, '/', o_orderkey % 3, ': ?') END"
_KNOWN = "CASE trim(regexp_replace(lower(trim(given)), '[^a-z0-9]+', '_', 'g'), '_') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.METRIC_NAMES.items()) + " END"


@query(f"SELECT given, {_KNOWN} AS metric, coalesce(nullif(trim(regexp_replace(given, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'unnamed') AS file, count(*) AS n FROM (SELECT {_GIVEN} AS given FROM orders) GROUP BY ALL")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of metrics, null for what is none, and of files."""
    given = read(spark, sf_dir, "orders").select(F.expr(_GIVEN).alias("given"))
    return given.groupBy("given", T.metric(F.col("given"), config.METRIC_NAMES).alias("metric"), T.file_name(F.col("given")).alias("file")).agg(F.count("*").alias("n"))


_SETS = {"structured": ("ALL", 0), "nlp": ("5", 5), "nlp ": ("ALL", 64), "rfg": ("x_5", 5), "rfg ": ("x_ALL", 64), "rfg  ": ("y_ALL", 3)}


@query(" UNION ALL ".join(f"SELECT '{k.strip()}' AS kind, '{v}' AS variant, {2 + d} AS n_columns, round(sum(vec_id + label + coalesce(list_sum(embedding[1:{d}]::DOUBLE[]), 0)), 3) AS total FROM embeddings" for k, (v, d) in _SETS.items()))
def feature_set_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of feature sets and their variants over a table: structured columns before the first components of each embedding."""
    rows = read(spark, sf_dir, "embeddings")
    size = rows.agg(F.max(F.size("embedding"))).first()[0]
    base = ("vec_id", "label")
    sets = [config.FeatureSet("s", base), config.FeatureSet("n", base, {"x": size}, (5, -1)), config.FeatureSet("r", base, {"x": size, "y": 3}, (5, -1))]
    columns = {"vec_id": F.col("vec_id").cast("double"), "label": F.col("label").cast("double")} | {f"{e}_{i}": F.col("embedding")[i].cast("double") for e in "xy" for i in range(size)}
    each = [(s.kind, v, c) for s in sets for v, c in s.variants().items()]
    # All variants are summed in one reading, then set out as rows.
    total = rows.agg(*[F.round(F.sum(sum((columns[c] for c in own), F.lit(0.0))), 3).alias(str(i)) for i, (_, _, own) in enumerate(each)])
    return total.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("variant"), F.lit(len(c)).alias("n_columns"), F.col(str(i)).alias("total")) for i, (k, v, c) in enumerate(each)])))


@query("SELECT vec_id, (unnest(range(5)))::INT AS pos, unnest(list_concat([vec_id::DOUBLE, label::DOUBLE], embedding[1:3]::DOUBLE[])) AS value FROM embeddings")
def baseline_and_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.array(F.col("vec_id").cast("double"), F.col("label").cast("double"))
    joined = F.concat(base, V.trimmed(F.col("embedding"), 3).cast("array<double>"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(joined).alias("pos", "value"))


_ODD = "CASE WHEN c_custkey % 7 = 0 THEN 'n/a' WHEN c_custkey % 5 = 0 THEN 'Infinity' WHEN c_custkey % 3 = 0 THEN '-Infinity' WHEN c_custkey % 2 = 0 THEN 'NaN' ELSE CAST(c_acctbal AS STRING) END"


@query(f"SELECT c_custkey, CASE WHEN x > '-Infinity'::DOUBLE AND x < 'Infinity'::DOUBLE THEN x END AS value FROM (SELECT c_custkey, try_cast({_ODD} AS DOUBLE) AS x FROM customer)")
def finite_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as numbers; what is none, or not finite, is null."""
    return read(spark, sf_dir, "customer").select("c_custkey", P.numeric(F.expr(_ODD)).alias("value"))


@query("SELECT * FROM (VALUES ('c_acctbal'), ('c_custkey')) t(name)")
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns left after those named, unnamed or no numbers are dropped."""
    df = read(spark, sf_dir, "customer").withColumn("Unnamed: 0", F.lit(1))
    left = P.drop_columns(df, ["c_nationkey", "absent"])
    return spark.createDataFrame([(c,) for c in sorted(S_IO.feature_columns(left, [])) if c in ("c_acctbal", "c_custkey", "c_nationkey", "Unnamed: 0")], "name string")


@query("SELECT doc_id, CASE lower(trim(mark)) WHEN 'present' THEN 1 WHEN 'absent' THEN 0 END AS flag FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Present' WHEN 1 THEN ' absent ' WHEN 2 THEN 'Not Mentioned' END AS mark FROM documents)")
def presence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    mark = F.when(k == 0, "Present").when(k == 1, " absent ").when(k == 2, "Not Mentioned")
    return read(spark, sf_dir, "documents").select("doc_id", T.presence(mark).alias("flag"))


@query("SELECT o_orderkey, stay, c_name FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS stay FROM orders) LEFT JOIN customer ON stay = c_custkey")
def nullable_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join on a key that may be null, which then meets nothing."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("stay"))
    return C.star(orders, ["stay"], read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stay"), "c_name"))


@query("SELECT c_custkey, c_acctbal AS balance FROM customer")
def generated_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written without their notes, and read back by date."""
    folder = scratch(spark, "generated-sink")
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.expr(_NOTES).alias("note"))
    S_IO.write_generated(rows, folder, "note", "1126")
    return S_IO.read_latest(spark, folder, "generated_features", "csv")


@query("SELECT event_id, CASE WHEN value - 100 > 0 THEN value - 100 ELSE 0 END AS rectified, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(value - 100) / 50.0::DOUBLE)), 6) AS squashed FROM events")
def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") - 100
    return read(spark, sf_dir, "events").select("event_id", A.relu(x).alias("rectified"), F.round(A.sigmoid(x / F.lit(50.0)), 6).alias("squashed"))


@query("SELECT vec_id, (unnest(range(64)))::INT AS pos, round(unnest(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 6) AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = A.unit(F.col("embedding").cast("array<double>"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(unit).alias("pos", "value")).withColumn("value", F.round("value", 6))
