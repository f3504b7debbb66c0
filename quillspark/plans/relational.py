"""Cohort and feature-table queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cohort as C
from .tables import read, scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_DX = """dx AS (SELECT DISTINCT l_orderkey AS hadm, p_type AS code FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_linenumber = 1 AND ((p_size <= 25 AND regexp_matches(p_type, '^(ECONOMY|LARGE)')) OR (p_size > 25 AND regexp_matches(p_type, '^S')))),
one_dx AS (SELECT hadm, min(code) AS code FROM dx GROUP BY 1)"""


def _diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    hit = ((F.col("p_size") <= 25) & F.col("p_type").rlike("^(ECONOMY|LARGE)")) | ((F.col("p_size") > 25) & F.col("p_type").rlike("^S"))
    lines = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_partkey")
    coded = lines.join(part.filter(hit).select("p_partkey", "p_type"), lines["l_partkey"] == part["p_partkey"])
    return coded.groupBy(F.col("l_orderkey").alias("hadm")).agg(F.min("p_type").alias("code"))


_COHORT = f"""{_DX}, adm AS (
  SELECT o_custkey AS subject, o_orderkey AS hadm, o_orderdate AS admitted, o_orderstatus AS status, code, c_mktsegment AS segment,
         c_nationkey + year(o_orderdate) - 1990 AS age,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders JOIN one_dx ON o_orderkey = hadm JOIN customer ON o_custkey = c_custkey
  WHERE c_nationkey + year(o_orderdate) - 1990 >= 18),
coh AS (SELECT subject, hadm, admitted, code, segment, age::INT AS age FROM adm WHERE rn = 1 AND status <> 'F')"""


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("hadm"), F.col("o_orderdate").alias("admitted"), F.col("o_orderstatus").alias("status"))
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("anchor"), F.col("c_mktsegment").alias("segment"))
    events = orders.join(_diagnoses(spark, sf_dir), "hadm").join(people, "subject")
    adults = events.withColumn("age", (F.col("anchor") + F.year("admitted") - 1990).cast("int")).filter("age >= 18")
    chosen = C.index_event(adults, ["subject"], [F.col("admitted").asc(), F.col("hadm").asc()], F.col("status") != "F")
    return chosen.select("subject", "hadm", "admitted", "code", "segment", "age")


@query(f"WITH {_COHORT} SELECT * FROM coh")
def cohort_index_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir)


@query("SELECT conv_id, string_agg(text, '|-----|' ORDER BY turn DESC NULLS LAST, role DESC) AS notes FROM conversations GROUP BY conv_id")
def notes_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.concat_ordered(read(spark, sf_dir, "conversations"), ["conv_id"], "text", "|-----|", "turn DESC NULLS LAST, role DESC", "notes")


@query("SELECT c.conv_id, role, n_chars FROM (SELECT conv_id::VARCHAR AS k, conv_id, role, length(text) AS n_chars FROM conversations) c JOIN (SELECT DISTINCT doc_id FROM documents) d ON c.k::BIGINT = d.doc_id")
def cast_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = read(spark, sf_dir, "conversations").select("conv_id", F.col("conv_id").cast("string").alias("k"), "role", F.length("text").cast("long").alias("n_chars"))
    docs = read(spark, sf_dir, "documents").select("doc_id").distinct()
    return notes.join(docs, notes["k"].cast("long") == docs["doc_id"]).select("conv_id", "role", "n_chars")


@query("SELECT c_custkey, n_name, (n_name > 'M')::BIGINT AS late_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey")
def demographics_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").filter("n_nationkey % 3 <> 0")
    people = read(spark, sf_dir, "customer")
    return people.join(nation, people["c_nationkey"] == nation["n_nationkey"], "left").select("c_custkey", "n_name", (F.col("n_name") > "M").cast("long").alias("late_name"))


_NEXT = "SELECT o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_date FROM orders"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.lead("o_orderdate").over(w).alias("next_date"))


@query(f"""SELECT o_orderkey,
  CASE WHEN next_date IS NOT NULL AND next_date > o_orderdate AND next_date <= o_orderdate + INTERVAL 30 DAY THEN 1 ELSE 0 END AS within_30_days,
  CASE WHEN next_date IS NOT NULL AND next_date > o_orderdate AND next_date <= o_orderdate + INTERVAL 365 DAY THEN 1 ELSE 0 END AS within_1_year
FROM ({_NEXT})""")
def outcome_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    end, event = F.col("o_orderdate"), F.col("next_date")
    return _outcomes(spark, sf_dir).select("o_orderkey", C.outcome_within(end, event, 30).alias("within_30_days"), C.outcome_within(end, event, 365).alias("within_1_year"))


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_by(read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts").asc(), F.col("event_id").asc()]).select("user_id", "event_type", "event_id", "ts")


@query("""SELECT event_id, CASE WHEN value > 45.0::DOUBLE THEN (value - 32.0::DOUBLE) * 5.0::DOUBLE / 9.0::DOUBLE ELSE value END AS celsius,
  CASE event_type WHEN 'click' THEN value WHEN 'view' THEN value * 0.453592::DOUBLE WHEN 'purchase' THEN value * 2.54::DOUBLE END AS converted FROM events""")
def unit_normalised_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = {"click": 1.0, "view": 0.453592, "purchase": 2.54}
    return read(spark, sf_dir, "events").select("event_id", C.celsius(F.col("value")).alias("celsius"), C.converted(F.col("event_type"), F.col("value"), factors).alias("converted"))


@query("SELECT user_id, round(avg(CASE WHEN value BETWEEN 20 AND 250 THEN value END), 6) AS mean_rate, round(avg(CASE WHEN value BETWEEN 50 AND 100 THEN value END), 6) AS mean_saturation, max(value) AS peak FROM events GROUP BY user_id")
def plausible_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg(C.plausible(v, 20, 250)), 6).alias("mean_rate"), F.round(F.avg(C.plausible(v, 50, 100)), 6).alias("mean_saturation"), F.max(v).alias("peak"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN l_quantity * 8.0::DOUBLE BETWEEN 30 AND 300 AND l_quantity * 4.5::DOUBLE BETWEEN 120 AND 220
  THEN l_quantity * 8.0::DOUBLE / pow(l_quantity * 4.5::DOUBLE / 100.0::DOUBLE, 2) END, 6) AS ratio FROM lineitem""")
def guarded_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = C.guarded_ratio(F.col("l_quantity") * F.lit(8.0), F.col("l_quantity") * F.lit(4.5))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(ratio, 6).alias("ratio"))


@query("""SELECT event_id, upper(event_type) AS kind, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  try_cast(CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') || ' kg' ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS k_strict FROM events""")
def safe_cast_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    mixed = F.when(F.col("event_id") % 3 == 0, F.concat(k, F.lit(" kg"))).otherwise(k)
    return read(spark, sf_dir, "events").select("event_id", F.upper("event_type").alias("kind"), k.try_cast("double").alias("k"), mixed.try_cast("double").alias("k_strict"))


def _readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("at"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("moment"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return orders, lines


_WINDOWED = "FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate BETWEEN o_orderdate - INTERVAL 365 DAY AND o_orderdate + INTERVAL 7 DAY"


@query(f"SELECT o_orderkey AS k, o_orderdate AS at, l_shipdate AS moment, l_partkey, l_suppkey, l_linenumber, l_quantity {_WINDOWED}")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _readings(spark, sf_dir)
    return C.interval_join(orders, lines, ["k"], "at", "moment", 365, 7)


@query(f"""SELECT k, moment, l_quantity FROM (SELECT o_orderkey AS k, l_shipdate AS moment, l_quantity,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)), l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn {_WINDOWED}) WHERE rn = 1""")
def nearest_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _readings(spark, sf_dir)
    ties = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return C.nearest_within(orders, lines, ["k"], "at", "moment", 365, 7, ties).select("k", "moment", "l_quantity")


_CODES = {"sodium": ("avg", [1, 2]), "potassium": ("avg", [3]), "peak": ("max", [4, 5]), "low": ("min", [6])}


def _labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = C.conditional_pivot(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity", _CODES)
    return wide.select("l_orderkey", F.round("sodium", 6).alias("sodium"), F.round("potassium", 6).alias("potassium"), "peak", "low")


_LABS = """SELECT l_orderkey, round(avg(CASE WHEN l_linenumber IN (1, 2) THEN l_quantity END), 6) AS sodium, round(avg(CASE WHEN l_linenumber = 3 THEN l_quantity END), 6) AS potassium,
  max(CASE WHEN l_linenumber IN (4, 5) THEN l_quantity END) AS peak, min(CASE WHEN l_linenumber = 6 THEN l_quantity END) AS low
FROM lineitem WHERE l_linenumber BETWEEN 1 AND 6 AND l_quantity IS NOT NULL GROUP BY l_orderkey"""


@query(_LABS)
def conditional_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labs(spark, sf_dir)


@query("SELECT l_orderkey, round(avg(l_extendedprice), 6) AS mean_price, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY 1")
def derived_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg("l_extendedprice"), 6).alias("mean_price"), F.round(F.avg("l_discount"), 6).alias("mean_discount"))


@query("SELECT l_orderkey, max(l_extendedprice) AS peak_price FROM lineitem GROUP BY 1")
def derived_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("peak_price"))


@query(f"""SELECT o_orderkey, coalesce(sodium, potassium, round(o_totalprice, 6)) AS fused, coalesce(peak, low) AS extreme FROM orders LEFT JOIN ({_LABS}) ON o_orderkey = l_orderkey""")
def priority_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    joined = orders.join(_labs(spark, sf_dir), orders["o_orderkey"] == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", C.fuse(F.col("sodium"), F.col("potassium"), F.round("o_totalprice", 6)).alias("fused"), C.fuse(F.col("peak"), F.col("low")).alias("extreme"))


_FLAGS = """SELECT l_orderkey, max(CASE WHEN starts_with(p_type, 'ECON') OR starts_with(p_type, 'PROMO') THEN 1 ELSE 0 END) AS promoted,
  max(CASE WHEN substr(p_type, 1, 3) IN ('SMA', 'MED') THEN 1 ELSE 0 END) AS smallish FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    rows = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    t = F.col("p_type")
    return C.any_flags(rows, ["l_orderkey"], {"promoted": t.startswith("ECON") | t.startswith("PROMO"), "smallish": F.substring(t, 1, 3).isin("SMA", "MED")})


@query(_FLAGS)
def any_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)


@query(f"""WITH {_COHORT} SELECT l_orderkey AS hadm, round(avg(l_extendedprice), 6) AS mean_price, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey IN (SELECT hadm FROM coh) GROUP BY 1""")
def semi_reduced_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "hadm")
    reduced = C.semi_reduce(fact, cohort(spark, sf_dir), ["hadm"])
    return reduced.groupBy("hadm").agg(F.round(F.avg("l_extendedprice"), 6).alias("mean_price"), F.count("*").alias("n"))


# -- the whole feature table: outcomes, demographics, fused vitals, fused labs, comorbidities, flags

#: Labs, each with the line numbers and statistic of its raw readings; the derived ones
#: are of lines of one return flag and another line number.
_LAB_NAMES = ("bicarbonate", "creatinine", "hemoglobin", "inr", "platelet_count", "potassium", "wbc_count", "sodium", "ntprobnp", "troponin")
_FLAG_OF = ("A", "N", "R")
_MORBID = (
    "acute_myocardial_infarction peripheral_vascular_disease cerebrovascular_disease dementia chronic_obstructive_pulmonary_disease rheumatoid_disease peptic_ulcer_disease mild_liver_disease "
    "diabetes diabetes_complications hemiplegia_paraplegia renal_disease cancer moderate_severe_liver_disease metastatic_cancer"
).split()
#: Conditions of the flags by version (sizes to 25, and over) and code.
_DX_FLAGS = {
    "HT": "(p_size <= 25 AND substr(p_type, 1, 3) IN ('ECO', 'LAR')) OR (p_size > 25 AND (p_type LIKE 'SM%' OR p_type LIKE 'ST%'))",
    "CAD": "(p_size <= 25 AND p_type LIKE 'PROMO%') OR (p_size > 25 AND p_type LIKE 'MEDIUM%')",
    "PH": "(p_size <= 25 AND p_type LIKE 'SMALL%') OR (p_size > 25 AND p_type LIKE 'PROMO%')",
    "AF": "(p_size <= 25 AND p_type LIKE 'STAN%') OR (p_size > 25 AND (p_type LIKE 'ECON%' OR p_type LIKE 'LARGE%'))",
}


def _by_event() -> dict[str, str]:
    """SQL of everything that is one aggregate over an event's lines, understood by both engines."""
    out = {}
    for i, name in enumerate(_LAB_NAMES):
        how = "max" if i >= 8 else "avg"
        out[f"{name}_raw"] = f"{how}(CASE WHEN l_linenumber IN ({i % 7 + 1}, {(i + 2) % 7 + 1}) THEN l_quantity END)"
        out[f"{name}_derived"] = f"{how}(CASE WHEN l_returnflag = '{_FLAG_OF[i % 3]}' AND l_linenumber = {(i + 3) % 7 + 1} THEN l_extendedprice END)"
    out |= {"icu_heart_rate": "avg(CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END)", "icu_systolic_bp": "avg(l_discount * CAST(1000 AS DOUBLE))", "icu_oxygen": "avg(l_tax * CAST(1000 AS DOUBLE))", "icu_temperature": "avg(CAST(36 AS DOUBLE) + l_tax)", "icu_bmi": "max(l_quantity)"}
    out |= {name: f"max(CASE WHEN p_size % 15 = {i} THEN 1 ELSE 0 END)" for i, name in enumerate(_MORBID)}
    return out | {name: f"max(CASE WHEN {cond} THEN 1 ELSE 0 END)" for name, cond in _DX_FLAGS.items()}


#: Aggregates over a subject's readings, and the first reading's figures, of one visit kind.
_ED = {
    "ed_heart_rate": "avg(CASE WHEN event_type = 'view' AND value BETWEEN 20 AND 250 THEN value END)",
    "ed_systolic_bp": "avg(CASE WHEN event_type = 'purchase' AND value BETWEEN 50 AND 250 THEN value END)",
    "ed_oxygen": "avg(CASE WHEN event_type = 'view' AND value BETWEEN 50 AND 100 THEN value END)",
    "ed_temperature": "avg(CASE WHEN event_type = 'error' AND value BETWEEN 30 AND 45 THEN value END)",
}
_TRIAGE = {"first_value": "value", "first_temperature": "CASE WHEN value > 45 THEN (value - CAST(32 AS DOUBLE)) * CAST(5 AS DOUBLE) / CAST(9 AS DOUBLE) ELSE value END"}
_FUSED = {
    "temperature": "coalesce(ed_temperature, first_temperature, icu_temperature)",
    "heart_rate": "coalesce(ed_heart_rate, first_value, icu_heart_rate)",
    "oxygen_saturation": "coalesce(ed_oxygen, first_value, icu_oxygen)",
    "systolic_bp": "coalesce(ed_systolic_bp, first_value, icu_systolic_bp)",
    "bmi": "coalesce(nearest_bmi, icu_bmi)",
}
_FUSED |= {name: f"coalesce({name}_derived, {name}_raw)" for name in _LAB_NAMES}
_FINAL = ["subject", "hadm", "within_30_days", "within_1_year", "age", "gender", *[f"round({sql}, 6) AS {name}" for name, sql in _FUSED.items()], *_MORBID, *_DX_FLAGS]
_LIST = lambda d: ", ".join(f"{sql} AS {name}" for name, sql in d.items())


@query(f"""WITH {_COHORT}, out AS (SELECT o_orderkey AS hadm,
  CASE WHEN next_date > o_orderdate AND next_date <= o_orderdate + INTERVAL 30 DAY THEN 1 ELSE 0 END AS within_30_days,
  CASE WHEN next_date > o_orderdate AND next_date <= o_orderdate + INTERVAL 365 DAY THEN 1 ELSE 0 END AS within_1_year FROM ({_NEXT})),
facts AS (SELECT l_orderkey AS hadm, {_LIST(_by_event())} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
near AS (SELECT hadm, CASE WHEN l_quantity * 8.0::DOUBLE BETWEEN 30 AND 300 AND l_quantity * 4.5::DOUBLE BETWEEN 120 AND 220 THEN l_quantity * 8.0::DOUBLE / pow(l_quantity * 4.5::DOUBLE / 100.0::DOUBLE, 2) END AS nearest_bmi FROM (SELECT o_orderkey AS hadm, l_quantity,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)), l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn {_WINDOWED}) WHERE rn = 1),
ed AS (SELECT user_id AS subject, {_LIST(_ED)} FROM events GROUP BY 1),
triage AS (SELECT user_id AS subject, {_LIST(_TRIAGE)} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'signup') WHERE rn = 1)
SELECT {', '.join(_FINAL)} FROM (SELECT *, CASE WHEN segment <> 'MACHINERY' THEN (segment > 'C')::INT END AS gender FROM coh)
LEFT JOIN out USING (hadm) LEFT JOIN facts USING (hadm) LEFT JOIN near USING (hadm) LEFT JOIN ed USING (subject) LEFT JOIN triage USING (subject)""")
def structured_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an index event, in 40 columns: outcomes, demographics, fused vitals and labs, comorbidities, flags.

    The cohort is written once. Each fact table is reduced to it, by event or by
    subject, before its rows are shuffled; the lines of an event are read once for
    the nearest reading, and once for all that is one aggregate over them.
    """
    coh = cohort(spark, sf_dir)
    path = scratch(spark, "cohort")
    coh.write.parquet(path)
    coh = spark.read.schema(coh.schema).parquet(path)
    ids, subjects = coh.select("hadm"), coh.select("subject")
    # Any event of a subject may be the next, so outcomes are reduced by subject before the window, by event after it.
    orders = C.semi_reduce(read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "subject"), subjects, ["subject"])
    w = Window.partitionBy("subject").orderBy("o_orderdate", "o_orderkey")
    later = orders.select(F.col("o_orderkey").alias("hadm"), "o_orderdate", F.lead("o_orderdate").over(w).alias("next_date"))
    end, event = F.col("o_orderdate"), F.col("next_date")
    out = C.semi_reduce(later, ids, ["hadm"]).select("hadm", C.outcome_within(end, event, 30).alias("within_30_days"), C.outcome_within(end, event, 365).alias("within_1_year"))
    lines = C.semi_reduce(read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "hadm"), ids, ["hadm"])
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    facts = lines.join(part, lines["l_partkey"] == part["p_partkey"]).groupBy("hadm").agg(*[F.expr(sql).alias(name) for name, sql in _by_event().items()])
    ties = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    near = C.nearest_within(coh.select("hadm", "admitted"), lines.withColumnRenamed("l_shipdate", "moment"), ["hadm"], "admitted", "moment", 365, 7, ties)
    near = near.select("hadm", C.guarded_ratio(F.col("l_quantity") * F.lit(8.0), F.col("l_quantity") * F.lit(4.5)).alias("nearest_bmi"))
    events = C.semi_reduce(read(spark, sf_dir, "events").withColumn("subject", F.col("user_id").cast("long")), subjects, ["subject"])
    ed = events.groupBy("subject").agg(*[F.expr(sql).alias(name) for name, sql in _ED.items()])
    triage = C.first_by(events.filter("event_type = 'signup'"), ["subject"], [F.col("ts").asc(), F.col("event_id").asc()]).selectExpr("subject", *[f"{sql} AS {name}" for name, sql in _TRIAGE.items()])
    driver = coh.withColumn("gender", F.when(F.col("segment") != "MACHINERY", (F.col("segment") > "C").cast("int")))
    return C.star(C.star(driver, ["subject"], ed, triage), ["hadm"], out, facts, near).selectExpr(*_FINAL)
