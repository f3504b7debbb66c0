"""Text queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grades as G
from ..functions import text as T
from ..operators import decompose as D
from ..sources.work import held
from .tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: Text with URLs, an address, units and runs of marks in it, as the test texts hold few.
_NOISY = "concat('See http://x.org/a?b=1 and me@y.com, 12.5mg or 3kg!!  ', {text}, ' Done... ok??')"


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(_NOISY.format(text="text")).alias("text"))


_PLAIN = r"regexp_replace(lower(trim(text)), '[^\p{L}\p{N}_\s]', '', 'g')"


@query(f"SELECT doc_id, {_PLAIN} AS cleaned FROM documents")
def clean_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.clean_plain(F.col("text")).alias("cleaned"))


_NOISY_SQL = "(SELECT doc_id, " + _NOISY.format(text="text") + " AS text FROM documents)"


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'http\S+|www\S+|https\S+', '', 'g'), '\S+@\S+', '', 'g'),
  '(\d+\.?\d*)([a-z]{{1,3}})\b', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM {_NOISY_SQL}""")
def clean_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noisy(spark, sf_dir).select("doc_id", T.clean_units(F.col("text")).alias("cleaned"))


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'http\S+|www\S+|https\S+', '', 'g'), '\S+@\S+', '', 'g'),
  '\s+', ' ', 'g'), '[.]{{2,}}', '.', 'g'), '[!]{{2,}}', '!', 'g'), '[?]{{2,}}', '?', 'g')) AS cleaned FROM {_NOISY_SQL}""")
def clean_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noisy(spark, sf_dir).select("doc_id", T.clean_dense(F.col("text")).alias("cleaned"))


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(T.STOPWORDS) - set(T.KEPT_WORDS))) + "]"
_WORDS = rf"list_filter(string_split_regex({_PLAIN}, '\s+'), lambda w: w <> '')"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.tokens(T.clean_plain(F.col("text"))).alias("words"))


@query(f"SELECT doc_id, len(words)::INT AS n_words, len(kept)::INT AS n_kept, array_to_string(kept, ' ') AS kept FROM (SELECT doc_id, words, list_filter(words, lambda w: NOT list_contains({_STOP}, w)) AS kept FROM (SELECT doc_id, {_WORDS} AS words FROM documents))")
def stopword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _words(spark, sf_dir).withColumn("kept", T.without_stopwords(F.col("words")))
    return kept.select("doc_id", F.size("words").alias("n_words"), F.size("kept").alias("n_kept"), F.array_join("kept", " ").alias("kept"))


_GRAMS = f"""grams AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM (SELECT doc_id, list_filter({_WORDS}, lambda w: length(w) >= 2) AS w FROM documents)),
counts AS (SELECT doc_id, term, count(*) AS n FROM grams GROUP BY 1, 2)"""


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", T.joined(F.col("words")).alias("words"))


def _top(spark: SparkSession, texts: DataFrame, most: int, size: int) -> DataFrame:
    return spark.createDataFrame(T.top_terms(texts, most, size), "term string, n long")


@query(f"WITH {_GRAMS} SELECT * FROM counts WHERE n >= 2")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.term_counts(_joined(spark, sf_dir), "doc_id", F.col("words"), 2).filter("n >= 2")


@query(f"WITH {_GRAMS} SELECT term, sum(n)::BIGINT AS n FROM counts GROUP BY 1 ORDER BY n DESC, term LIMIT 1000")
def vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, held(_joined(spark, sf_dir).select("words"), "words"), 2, 1000)


_UNIGRAMS = f"""counts AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY 1, 2)"""


@query(f"""WITH {_UNIGRAMS}, df AS (SELECT term, count(*) AS df FROM counts GROUP BY 1), total AS (SELECT count(*) AS total FROM documents),
raw AS (SELECT doc_id, term, n * (ln((1.0::DOUBLE + total) / (df + 1.0::DOUBLE)) + 1.0::DOUBLE) AS w FROM counts JOIN df USING (term), total)
SELECT doc_id, count(*) AS n_terms, round(max(w / length), 6) AS top_weight, round(sum(w / length), 6) AS total_weight
FROM raw JOIN (SELECT doc_id, sqrt(sum(w * w)) AS length FROM raw GROUP BY 1) USING (doc_id) GROUP BY 1""")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    weights = T.tfidf(T.term_counts(words, "doc_id", F.array_join("words", " ")), "doc_id", words)
    return weights.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("top_weight"), F.round(F.sum("weight"), 6).alias("total_weight"))


# The whole job, beyond the samples of it above that have SQL: n-grams of 1 to NGRAMS
# words, all their counts, the VOCABULARY most frequent, and their weights.
NGRAMS, VOCABULARY = 5, 10_000


def ngram_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, term, n) of every n-gram, single ones included."""
    return T.term_counts(_joined(spark, sf_dir), "doc_id", F.col("words"), NGRAMS)


def vocab_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, n) of the most frequent n-grams."""
    return _top(spark, held(_joined(spark, sf_dir).select("words"), "words"), NGRAMS, VOCABULARY)


def _vocabulary_rows(spark: SparkSession, sf_dir: str) -> tuple[list[str], DataFrame]:
    """The most frequent n-grams in their order, and a table (doc_id, at, w) of each document's counts of them."""
    words = held(_joined(spark, sf_dir), "words")
    vocabulary = sorted(t for t, _ in T.top_terms(words.select("words"), NGRAMS, VOCABULARY))
    return vocabulary, held(T.vocabulary_counts(words, "doc_id", F.col("words"), NGRAMS, vocabulary), "vocabulary-counts")


def _cells(spark: SparkSession, vocabulary: list[str], rows: DataFrame) -> DataFrame:
    """(doc_id, term, w) of rows over a vocabulary."""
    terms = spark.createDataFrame(list(enumerate(vocabulary)), "at int, term string")  # bounded by VOCABULARY
    cells = rows.select("doc_id", F.explode(F.arrays_zip("at", "w")).alias("e")).select("doc_id", "e.at", "e.w")
    return cells.join(F.broadcast(terms), "at").select("doc_id", "term", "w")


def _vocabulary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, term, n) of the most frequent n-grams."""
    return _cells(spark, *_vocabulary_rows(spark, sf_dir)).withColumn("w", F.col("w").cast("long")).withColumnRenamed("w", "n")


def tfidf_weights_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, term, weight) over the most frequent n-grams; rows of length 1."""
    vocabulary, counts = _vocabulary_rows(spark, sf_dir)
    return _cells(spark, vocabulary, T.vocabulary_weights(counts, "doc_id", read(spark, sf_dir, "documents"))).withColumnRenamed("w", "weight")


#: Components of the embeddings of documents.
COMPONENTS = 16


def bow_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, embedding): from the notes to left singular vectors of their counts of the most frequent n-grams."""
    vocabulary, counts = _vocabulary_rows(spark, sf_dir)
    return D.embeddings(counts, "doc_id", len(vocabulary), COMPONENTS)


def tfidf_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of their weights."""
    vocabulary, counts = _vocabulary_rows(spark, sf_dir)
    weights = held(T.vocabulary_weights(counts, "doc_id", read(spark, sf_dir, "documents")), "weights")
    return D.embeddings(weights, "doc_id", len(vocabulary), COMPONENTS)


def stemmed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, stems) of the words that are no stop words."""
    kept = _words(spark, sf_dir).select("doc_id", T.without_stopwords(F.col("words")).alias("kept"))
    return kept.select("doc_id", F.array_join(T.stemmed(F.col("kept")), " ").alias("stems"))


QUERIES |= {f.__name__: f for f in (ngram_counts_all, vocab_topk_all, tfidf_weights_all, stemmed_tokens, bow_embedding, tfidf_embedding)}


_WRAP = """CASE turn % 6 WHEN 0 THEN concat('Sure. <JSON>{"a": ', turn, '}</JSON> bye') WHEN 1 THEN concat('x ```json', chr(10), '{"a": ', turn, '} ``` y')
 WHEN 2 THEN concat('z ``` [', turn, '] ``` ') WHEN 3 THEN concat('so ```text', chr(10), '{"a": ', turn, '}', chr(10), '```') WHEN 4 THEN concat('a ```python', chr(10), 'x = 1 ``` b ``` {"a": 1} ```') ELSE 'no json here' END"""


@query(rf"""SELECT conv_id, turn, coalesce(nullif(trim(regexp_extract(reply, '(?s)<JSON>(.*?)</JSON>', 1)), ''), nullif(trim(regexp_extract(reply, '(?s)```json\s*(.*?)```', 1)), ''),
  nullif(trim(regexp_extract(CASE WHEN contains(reply, '```') THEN substr(reply, strpos(reply, '```') + 3) END, '(?s)^(?:[^\n\[{{][^\n]{{0,18}}\n)?\s*([\[{{].*?)```', 1), ' ' || chr(10)), '')) AS found FROM (SELECT conv_id, turn, {_WRAP} AS reply FROM conversations)""")
def tagged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.tagged_json(F.expr(_WRAP)).alias("found"))


@query(rf"""SELECT conv_id, turn, try_cast(json_extract_string(nullif(regexp_extract(reply, '(?s)(\{{.*\}})', 1), ''), '$.a') AS INT) AS a FROM (SELECT conv_id, turn, {_WRAP} AS reply FROM conversations)""")
def brace_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json(T.brace_json(F.expr(_WRAP)), "a int")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", parsed["a"].alias("a"))


_PATTERN = "CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN '4+3=7' WHEN p_size % 5 = 0 THEN 'none' ELSE concat(3 + p_size % 3, '+', 3 + p_partkey % 3) END"
_HISTOLOGY = "CASE WHEN p_partkey % 4 = 0 THEN 'benign' WHEN p_partkey % 9 = 0 THEN NULL ELSE 'Acinar Adenocarcinoma' END"
_PART = f"(SELECT p_partkey, {_PATTERN} AS pattern, {_HISTOLOGY} AS histology FROM part)"
_PARTS = r"nullif(regexp_extract(pattern, '^(\d+)\+(\d+)', {i}), '')::INT"


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.expr(_PATTERN).alias("pattern"), F.expr(_HISTOLOGY).alias("histology"))


@query(f"SELECT p_partkey, {_PARTS.format(i=1)} AS primary_part, {_PARTS.format(i=2)} AS secondary_part FROM {_PART}")
def pattern_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pattern")
    return _patterns(spark, sf_dir).select("p_partkey", G.pattern_part(p, 1).alias("primary_part"), G.pattern_part(p, 2).alias("secondary_part"))


_MAP = "CASE pattern " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in G.GRADES.items()) + " ELSE 0 END"


@query(f"SELECT p_partkey, CASE WHEN coalesce(contains(lower(histology), 'adenocarcinoma'), false) THEN {_MAP} ELSE 0 END AS grade FROM {_PART}")
def grade_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(spark, sf_dir).select("p_partkey", G.grade(F.col("pattern"), F.col("histology")).alias("grade"))


@query(f"SELECT p_partkey, CASE WHEN p IS NOT NULL AND s IS NOT NULL THEN (CASE WHEN p >= 4 THEN p * 0.75::DOUBLE ELSE 0 END) + (CASE WHEN s >= 4 THEN s * 0.25::DOUBLE ELSE 0 END) END AS score FROM (SELECT p_partkey, {_PARTS.format(i=1)} AS p, {_PARTS.format(i=2)} AS s FROM {_PART})")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(spark, sf_dir).select("p_partkey", G.weighted_high(F.col("pattern")).alias("score"))


_REGIONS = [f"r{i}" for i in range(1, 7)]
_REGION_SQL = ", ".join(f"max(CASE WHEN l_linenumber = {i} AND l_quantity > 25 THEN l_discount * 100.0::DOUBLE WHEN l_linenumber = {i} THEN 0 END) AS r{i}" for i in range(1, 7))
_WIDE = f"(SELECT l_orderkey, {_REGION_SQL} FROM lineitem GROUP BY 1)"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, hit = F.col("l_linenumber"), F.col("l_quantity") > 25
    aggs = [F.max(F.when((n == i) & hit, F.col("l_discount") * F.lit(100.0)).when(n == i, 0.0)).alias(f"r{i}") for i in range(1, 7)]
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*aggs)


@query(f"SELECT l_orderkey, greatest({', '.join(_REGIONS)}) AS row_max, round(list_avg(list_filter([{', '.join(_REGIONS)}], lambda x: x IS NOT NULL)), 6) AS row_mean FROM {_WIDE}")
def row_max_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col(c) for c in _REGIONS]
    return _regions(spark, sf_dir).select("l_orderkey", G.row_max(cols).alias("row_max"), F.round(G.row_mean(cols), 6).alias("row_mean"))


_GROUPS = [("r1", "r2"), ("r3", "r4"), ("r5", "r6")]
_HIT = " + ".join(f"(coalesce({a} > 0, false) OR coalesce({b} > 0, false))::INT" for a, b in _GROUPS)


@query(f"SELECT l_orderkey, round(({_HIT}) * 100.0::DOUBLE / 3, 6) AS percent_positive FROM {_WIDE}")
def positive_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = G.positive_share([[F.col(a), F.col(b)] for a, b in _GROUPS])
    return _regions(spark, sf_dir).select("l_orderkey", F.round(share, 6).alias("percent_positive"))


@query(f"SELECT l_orderkey, ((coalesce(r1 > 0, false) OR coalesce(r3 > 0, false) OR coalesce(r5 > 0, false)) AND (coalesce(r2 > 0, false) OR coalesce(r4 > 0, false) OR coalesce(r6 > 0, false)))::INT AS bilateral FROM {_WIDE}")
def bilateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = [[F.col(f"r{i}") for i in side] for side in ((1, 3, 5), (2, 4, 6))]
    return _regions(spark, sf_dir).select("l_orderkey", G.bilateral(left, right).alias("bilateral"))


