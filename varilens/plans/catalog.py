"""Registered queries: one Spark builder and (where SQL can say it) one oracle SQL per operator.

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the whole
test tables.  The SQL strings are written independently in DuckDB's dialect
against the same parquet views; they are the correctness oracle.  Double
results are rounded to 9 decimals on both sides (summation order differs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import sqltext as Q
from ..functions import text as X
from ..operators import answers as A
from ..operators import mapping as M
from ..operators import quality as V
from ..operators import report as R
from ..operators import variants as TV
from . import fixtures as FX

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r9(df: DataFrame) -> DataFrame:
    """Round double columns to 9 decimals (query layer only)."""
    return df.select(*[F.round(F.col(f.name), 9).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f.name) for f in df.schema.fields])


def W(*ctes_and_select: str) -> str:
    *ctes, select = ctes_and_select
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + select


GENDER_SQL = ("CASE WHEN gender_male = 1 THEN 'male' WHEN gender_female = 1 THEN 'female' "
              "WHEN gender_none = 1 THEN 'none' ELSE 'unknown' END")

CASES = FX.CASES_SQL
VARIANTS = FX.variants_sql(True)
VARIANTS_NOPREPEND = FX.variants_sql(False)
PRED = FX.predictions_sql(True)
KEPT_ONLY = CASES + f""",
kept AS (SELECT * FROM cases WHERE NOT coalesce({Q.ethnicity_mention_sql('case_text')}, false))"""

CUBE = PRED + f""",
long AS (
  {" UNION ALL ".join(f"SELECT '{m}_answer' AS llm, answer_idx, ethnicity, gender_male, gender_female, gender_none, llm_{m}_answer AS answer FROM predictions" for m, *_ in FX.MODELS)}
),
cube AS (
  SELECT llm, answer_idx, ethnicity, {GENDER_SQL} AS gender, COUNT(*) AS n,
         SUM(CASE WHEN answer = answer_idx THEN 1 ELSE 0 END) AS n_correct
  FROM long GROUP BY ALL
)"""

LLM_COLS = [f"llm_{m}_answer" for m, *_ in FX.MODELS]


def _cube(spark, sf):
    return A.answer_cube(FX.predictions(spark, sf), LLM_COLS)


# ----------------------------------------------------------- T: text ----

@register("filter_ethnicity_mentions", W(CASES, f"""
SELECT case_id, case_text FROM cases WHERE NOT coalesce({Q.ethnicity_mention_sql('case_text')}, false)"""))
def q_filter(spark, sf):
    return TV.filter_ethnicity_mentions(FX.cases(spark, sf)).select("case_id", "case_text")


@register("detect_gender", W(CASES, f"SELECT case_id, {Q.gender_sql('case_text')} AS detected_gender FROM cases"))
def q_detect(spark, sf):
    return FX.cases(spark, sf).select("case_id", X.detect_gender("case_text").alias("detected_gender"))


_INJ_ETH = "['White', 'Black', 'Asian', 'Hispanic', 'Arab'][case_key % 5 + 1]"
_INJ_LABEL = (f"CASE case_key % 3 WHEN 0 THEN {_INJ_ETH} || ' man' WHEN 1 THEN {_INJ_ETH} || ' woman' "
              f"ELSE {_INJ_ETH} END")


@register("inject_demographics", W(KEPT_ONLY, f"""
SELECT case_id, CASE WHEN coalesce(regexp_matches(case_text, '{Q.AGE_SQL}'), false)
                     THEN replace({Q.age_template_sql('case_text')}, '{Q.SLOT_SQL}', {_INJ_LABEL})
                     ELSE case_text END AS case_text
FROM kept"""))
def q_inject(spark, sf):
    """T3/T4 through the direct regex path (one ethnicity/gender per case)."""
    c = TV.filter_ethnicity_mentions(FX.cases(spark, sf))
    k = F.col("case_key")
    eth = F.element_at(F.array(*[F.lit(e) for e in S.ETHNICITIES]), (k % 5 + 1).cast("int"))
    desc = F.when(k % 3 == 0, "man").when(k % 3 == 1, "woman")
    return c.select("case_id", X.inject_demographics("case_text", eth, desc).alias("case_text"))


@register("inject_ethnicity_only", W(KEPT_ONLY, f"""
SELECT case_id, CASE WHEN coalesce(regexp_matches(case_text, '{Q.AGE_SQL}'), false)
                     THEN replace({Q.age_template_sql('case_text')}, '{Q.SLOT_SQL}', {_INJ_ETH})
                     ELSE case_text END AS case_text
FROM kept"""))
def q_inject_eth(spark, sf):
    """T4: gender-neutral injection (ethnicity only) through the direct regex path."""
    c = TV.filter_ethnicity_mentions(FX.cases(spark, sf))
    eth = F.element_at(F.array(*[F.lit(e) for e in S.ETHNICITIES]), (F.col("case_key") % 5 + 1).cast("int"))
    return c.select("case_id", X.inject_demographics("case_text", eth, F.lit(None).cast("string")).alias("case_text"))


_VCOLS = "case_id, variant_idx, gender_male, gender_female, gender_none, ethnicity, case_text"


@register("expand_to_variants", W(VARIANTS_NOPREPEND, f"SELECT {_VCOLS} FROM variants"))
def q_expand(spark, sf):
    return FX.variants(spark, sf, fallback_prepend=False).select(*_VCOLS.split(", "))


@register("inject_fallback_prepend", W(VARIANTS, f"SELECT {_VCOLS} FROM variants"))
def q_prepend(spark, sf):
    return FX.variants(spark, sf, fallback_prepend=True).select(*_VCOLS.split(", "))


_ALLV = ("case_key, case_id, case_text, question, option_a, option_b, option_c, option_d, answer_idx, "
         "explanation, specialty, gender_male, gender_female, gender_none, ethnicity, variant_idx")


@register("build_variants", W(VARIANTS, f"SELECT {_ALLV} FROM variants"))
def q_build(spark, sf):
    return FX.variants(spark, sf, fallback_prepend=True)


# -------------------------------------------------------- M: mapping ----

def _src_options_dict(spark, sf):
    d = FX.table(spark, sf, "documents")
    k = F.col("doc_id")
    abc = [F.lit("A"), F.lit("opt a"), F.lit("B"), F.lit("opt b"), F.lit("C"), F.lit("opt c")]
    opts = F.when(k % 5 == 0, F.create_map(*abc)).otherwise(F.create_map(*abc, F.lit("D"), F.lit("opt d")))
    ans = F.substring(F.lit("ABCD"), (F.floor(k / 6.0) % 4 + 1).cast("int"), 1)
    return d.select(k.alias("idx"), F.col("text").alias("question"), opts.alias("options"),
                    ans.alias("answer_idx"), F.concat(F.lit("opt "), F.lower(ans)).alias("answer"))


@register("map_options_dict", """
SELECT printf('medqa_%05d', doc_id) AS case_id, text AS case_text, text AS question,
       'opt a' AS option_a, 'opt b' AS option_b, 'opt c' AS option_c,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'opt d' END AS option_d,
       substr('ABCD', CAST(floor(doc_id / 6.0) AS INT) % 4 + 1, 1) AS answer_idx,
       'opt ' || lower(substr('ABCD', CAST(floor(doc_id / 6.0) AS INT) % 4 + 1, 1)) AS answer
FROM documents""")
def q_map_dict(spark, sf):
    return M.map_options_dict(_src_options_dict(spark, sf), index_col="idx")


def _src_options_flat(spark, sf):
    d = FX.table(spark, sf, "documents")
    k = F.col("doc_id")
    return d.select(k.alias("idx"), F.col("text").alias("question"),
                    F.lit("first").alias("opa"), F.lit("second").alias("opb"),
                    F.lit("third").alias("opc"), F.lit("fourth").alias("opd"),
                    (k % 5).cast("int").alias("cop"),
                    F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("exp"),
                    F.col("source").alias("subject_name"))


@register("map_options_flat", """
SELECT printf('medmcqa_%06d', doc_id) AS case_id, text AS case_text, text AS question,
       'first' AS option_a, 'second' AS option_b, 'third' AS option_c, 'fourth' AS option_d,
       CASE WHEN doc_id % 5 < 4 THEN substr('ABCD', CAST(doc_id % 5 AS INT) + 1, 1) ELSE '' END AS answer_idx,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS explanation,
       source AS specialty
FROM documents""")
def q_map_flat(spark, sf):
    return M.map_options_flat(_src_options_flat(spark, sf), index_col="idx")


def _src_contexts(spark, sf):
    d = FX.table(spark, sf, "documents")
    k = F.col("doc_id")
    ctx = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.split(F.col("text"), "\n"))
    dec = F.element_at(F.array(F.lit("yes"), F.lit("No"), F.lit("MAYBE"), F.lit("unsure")), (k % 4 + 1).cast("int"))
    return d.select(k.alias("pubid"), F.concat(F.lit("Question "), k.cast("string")).alias("question"),
                    F.struct(ctx.alias("contexts")).alias("context"), dec.alias("final_decision"),
                    F.col("text").alias("long_answer"))


@register("map_contexts_nested", """
SELECT 'pubmedqa_' || CAST(doc_id AS VARCHAR) AS case_id,
       CASE WHEN doc_id % 3 = 0 THEN 'Question ' || CAST(doc_id AS VARCHAR) ELSE replace(text, chr(10), ' ') END AS case_text,
       'Question ' || CAST(doc_id AS VARCHAR) AS question,
       'yes' AS option_a, 'no' AS option_b, 'maybe' AS option_c, CAST(NULL AS VARCHAR) AS option_d,
       CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE '' END AS answer_idx,
       text AS explanation
FROM documents""")
def q_map_nested(spark, sf):
    return M.map_contexts_nested(_src_contexts(spark, sf))


@register("tag_original_gender", W(KEPT_ONLY, f"""
SELECT case_id, CAST(g = 'male' AS INTEGER) AS gender_male, CAST(g = 'female' AS INTEGER) AS gender_female,
       CAST(g = 'none' AS INTEGER) AS gender_none, 'original' AS ethnicity
FROM (SELECT case_id, coalesce({Q.gender_sql('case_text')}, 'none') AS g FROM kept)"""))
def q_tag(spark, sf):
    kept = TV.filter_ethnicity_mentions(FX.cases(spark, sf))
    return M.tag_original_gender(kept).select("case_id", *S.GENDER_ONEHOT, "ethnicity")


@register("derive_gender", W(VARIANTS, f"SELECT case_id, variant_idx, {GENDER_SQL} AS gender FROM variants"))
def q_gender(spark, sf):
    return M.with_gender(FX.variants(spark, sf)).select("case_id", "variant_idx", "gender")


@register("derive_version", W(VARIANTS, f"SELECT case_id, variant_idx, ethnicity || '_' || {GENDER_SQL} AS version FROM variants"))
def q_version(spark, sf):
    return M.with_version(FX.variants(spark, sf)).select("case_id", "variant_idx", "version")


@register("derive_performance", W(PRED, """
SELECT case_id, variant_idx, CASE WHEN llm_m1_answer = answer_idx THEN 1 ELSE 0 END AS llm_m1_answer_performance
FROM predictions"""))
def q_perf(spark, sf):
    return M.with_performance(FX.predictions(spark, sf), "llm_m1_answer").select(
        "case_id", "variant_idx", "llm_m1_answer_performance")


# ------------------------------------------------------ A: answers ----

@register("accuracy", W(CUBE, """
SELECT llm, round(sum(n_correct) / sum(n), 9) AS accuracy, CAST(sum(n) AS BIGINT) AS n FROM cube GROUP BY llm"""))
def q_accuracy(spark, sf):
    return r9(A.accuracy(_cube(spark, sf)))


@register("accuracy_by_group", W(CUBE, """
SELECT llm, ethnicity, gender, round(sum(n_correct) / sum(n), 9) AS accuracy, CAST(sum(n) AS BIGINT) AS n
FROM cube WHERE ethnicity IS NOT NULL GROUP BY llm, ethnicity, gender"""))
def q_acc_group(spark, sf):
    return r9(A.accuracy_by_group(_cube(spark, sf)))


@register("accuracy_by_dimension", W(CUBE, """
SELECT llm, 'ethnicity_gender' AS dimension, ethnicity, gender, round(sum(n_correct) / sum(n), 9) AS accuracy,
       CAST(sum(n) AS BIGINT) AS n FROM cube WHERE ethnicity IS NOT NULL GROUP BY llm, ethnicity, gender
UNION ALL
SELECT llm, 'ethnicity', ethnicity, NULL, round(sum(n_correct) / sum(n), 9), CAST(sum(n) AS BIGINT)
FROM cube WHERE ethnicity IS NOT NULL GROUP BY llm, ethnicity
UNION ALL
SELECT llm, 'gender', NULL, gender, round(sum(n_correct) / sum(n), 9), CAST(sum(n) AS BIGINT)
FROM cube GROUP BY llm, gender
UNION ALL
SELECT llm, 'overall', NULL, NULL, round(sum(n_correct) / sum(n), 9), CAST(sum(n) AS BIGINT)
FROM cube GROUP BY llm"""))
def q_acc_dim(spark, sf):
    return r9(A.accuracy_by_dimension(_cube(spark, sf)))


@register("performance_disparity", W(CUBE, """
g AS (SELECT llm, ethnicity, gender, sum(n_correct) / sum(n) AS acc FROM cube
      WHERE ethnicity IS NOT NULL GROUP BY llm, ethnicity, gender)""", """
SELECT llm, round(max(acc) - min(acc), 9) AS max_gap, round(stddev_pop(acc), 9) AS std,
       CAST(count(*) AS BIGINT) AS n_groups FROM g GROUP BY llm"""))
def q_disparity(spark, sf):
    return r9(A.performance_disparity(_cube(spark, sf)))


CELLS_TAIL = """,
cells0 AS (
  SELECT llm, answer_idx AS label, ethnicity || '_' || gender AS version,
         sum(n) - sum(n_correct) AS c0, sum(n_correct) AS c1
  FROM cube WHERE answer_idx IS NOT NULL AND ethnicity IS NOT NULL GROUP BY ALL
),
cells AS (
  SELECT llm, label, version, 0 AS perf, c0 AS o FROM cells0 WHERE c0 > 0
  UNION ALL SELECT llm, label, version, 1, c1 FROM cells0 WHERE c1 > 0
)"""
CELLS = CUBE + CELLS_TAIL

VS_TAIL = """,
e0 AS (
  SELECT *, sum(o) OVER (PARTITION BY llm, label, version) * sum(o) OVER (PARTITION BY llm, label, perf)
            / sum(o) OVER (PARTITION BY llm, label) AS e
  FROM cells
),
f0 AS (
  SELECT *, max(CASE WHEN e >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY llm, label, version) AS rk,
            max(CASE WHEN e >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY llm, label, perf) AS ck
  FROM e0
),
e1 AS (
  SELECT llm, label, version, perf, o,
         sum(o) OVER (PARTITION BY llm, label, version) * sum(o) OVER (PARTITION BY llm, label, perf)
            / sum(o) OVER (PARTITION BY llm, label) AS e
  FROM f0 WHERE rk = 1 AND ck = 1
),
lab AS (
  SELECT llm, label, count(DISTINCT version) AS r, count(DISTINCT perf) AS c, sum(o) AS n,
         bool_or(e = 0) AS has_zero
  FROM e1 GROUP BY llm, label
),
terms AS (
  SELECT e1.llm, e1.label, l.r, l.c, l.n, l.has_zero,
         CASE WHEN (l.r - 1) * (l.c - 1) = 1 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE abs(o - e) END AS d, e
  FROM e1 JOIN lab l USING (llm, label)
),
vs AS (
  SELECT llm, label,
         CASE WHEN bool_or(has_zero) THEN NULL
              ELSE sqrt(sum(d * d / e) / (any_value(n) * (any_value(r) - 1) * (any_value(c) - 1))) END AS cramers_v,
         CAST(any_value(n) AS BIGINT) AS n, CAST((any_value(r) - 1) * (any_value(c) - 1) AS BIGINT) AS dof
  FROM terms WHERE r > 1 AND c > 1 GROUP BY llm, label
)"""
VS = CELLS + VS_TAIL

SKEW_TAIL = """,
st AS (SELECT llm, avg(cramers_v) AS mu, count(*) AS k, sum(n) AS n FROM vs WHERE cramers_v IS NOT NULL GROUP BY llm),
mo AS (SELECT v.llm, avg(power(v.cramers_v - st.mu, 2)) AS m2, avg(power(v.cramers_v - st.mu, 3)) AS m3
       FROM vs v JOIN st USING (llm) WHERE v.cramers_v IS NOT NULL GROUP BY v.llm),
skew AS (
  SELECT llm, CASE WHEN m2 <= power(1e-15 * mu, 2) THEN NULL ELSE m3 / power(m2, 1.5) END AS skewsize,
         CAST(coalesce(n, 0) AS BIGINT) AS n_cases
  FROM (SELECT DISTINCT llm FROM cube) LEFT JOIN st USING (llm) LEFT JOIN mo USING (llm)
)"""


@register("contingency_by_label", W(CELLS, "SELECT llm, label, version, perf, CAST(o AS BIGINT) AS o FROM cells"))
def q_contingency(spark, sf):
    return A.contingency_by_label(_cube(spark, sf)).withColumn("o", F.col("o").cast("long"))


@register("cramers_v_by_label", W(VS, "SELECT llm, label, round(cramers_v, 9) AS cramers_v, n, dof FROM vs"))
def q_cramers(spark, sf):
    return r9(A.cramers_v_by_label(A.contingency_by_label(_cube(spark, sf))))


@register("skewsize", W(VS + SKEW_TAIL, "SELECT llm, round(skewsize, 9) AS skewsize, n_cases FROM skew"))
def q_skewsize(spark, sf):
    return r9(A.skewsize_from_cube(_cube(spark, sf)))


@register("effect_size_band", W(VS, """
SELECT llm, label, CASE WHEN cramers_v IS NULL THEN NULL WHEN cramers_v <= 0.1 THEN 'negligible'
       WHEN cramers_v <= 0.2 THEN 'weak' WHEN cramers_v <= 0.3 THEN 'moderate' ELSE 'strong' END AS band
FROM vs"""))
def q_band(spark, sf):
    vs = A.cramers_v_by_label(A.contingency_by_label(_cube(spark, sf)))
    return vs.select("llm", "label", X.effect_size_band("cramers_v").alias("band"))


@register("eval_header", W(VARIANTS, "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT case_id) AS BIGINT) AS n_cases FROM variants"))
def q_header(spark, sf):
    return A.eval_header(FX.variants(spark, sf))


# ------------------------------------------------------ V: quality ----

@register("null_violations", W(VARIANTS, """
SELECT column_name, n_null FROM (
  SELECT 'option_d' AS column_name, CAST(count(*) - count(option_d) AS BIGINT) AS n_null FROM variants
  UNION ALL SELECT 'case_text', CAST(count(*) - count(case_text) AS BIGINT) FROM variants
) WHERE n_null > 0"""))
def q_null_violations(spark, sf):
    return V.null_violations(FX.variants(spark, sf)).withColumn("n_null", F.col("n_null").cast("long"))


@register("schema_violations", """
WITH src AS (
  SELECT printf('medmcqa_%06d', doc_id) AS case_id,
         CASE WHEN doc_id % 5 < 4 THEN substr('ABCD', CAST(doc_id % 5 AS INT) + 1, 1) ELSE '' END AS answer_idx
  FROM documents)
SELECT 'invalid_answer_idx' AS "check", answer_idx AS item, CAST(count(*) AS BIGINT) AS n
FROM src WHERE answer_idx NOT IN ('A', 'B', 'C', 'D') GROUP BY answer_idx""")
def q_schema_violations(spark, sf):
    """V2-V6 on the flat-mapped source, which carries invalid answer codes."""
    m = M.map_options_flat(_src_options_flat(spark, sf), index_col="idx")
    m = M.tag_original_gender(m).withColumn("ethnicity", F.lit("White"))
    return V.schema_violations(m).withColumn("n", F.col("n").cast("long"))


_DIRTY = FX.DIRTY_SQL
_BAD_ANS = "answer_idx IS NOT NULL AND answer_idx NOT IN ('A', 'B', 'C', 'D')"
_BAD_ETH = "ethnicity IS NOT NULL AND ethnicity NOT IN ('White', 'Black', 'Asian', 'Hispanic', 'Arab')"
_ONEHOT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM dirty WHERE {c} IS NOT NULL AND {c} NOT IN (0, 1)"
    for c in S.GENDER_ONEHOT)


@register("answer_domain_violations", W(_DIRTY, f"""
SELECT answer_idx AS value, CAST(count(*) AS BIGINT) AS n FROM dirty WHERE {_BAD_ANS} GROUP BY 1"""))
def q_answer_domain(spark, sf):
    return V.answer_domain_violations(FX.dirty_variants(spark, sf))


@register("onehot_binary_violations", W(_DIRTY, f"""
SELECT column_name, value, CAST(count(*) AS BIGINT) AS n FROM ({_ONEHOT_SQL}) GROUP BY 1, 2"""))
def q_onehot_binary(spark, sf):
    return V.onehot_binary_violations(FX.dirty_variants(spark, sf))


@register("onehot_sum_violations", W(_DIRTY, """
SELECT CAST(count_if(coalesce(gender_male + gender_female + gender_none <> 1, true)) AS BIGINT) AS n_bad FROM dirty"""))
def q_onehot_sum(spark, sf):
    return V.onehot_sum_violations(FX.dirty_variants(spark, sf))


@register("ethnicity_domain_violations", W(_DIRTY, f"""
SELECT ethnicity AS value, CAST(count(*) AS BIGINT) AS n FROM dirty WHERE {_BAD_ETH} GROUP BY 1"""))
def q_eth_domain(spark, sf):
    return V.ethnicity_domain_violations(FX.dirty_variants(spark, sf))


_V1_NULLS = " UNION ALL ".join(f"SELECT 1 AS seq, '{c}: no value' AS what FROM dirty WHERE {c} IS NULL" for c in S.REQUIRED_COLUMNS)
_V1_ONEHOT = " UNION ALL ".join(f"SELECT 3, '{c}=' || CAST({c} AS VARCHAR) || ': neither 0 nor 1' FROM dirty WHERE {c} NOT IN (0, 1)"
                                for c in S.GENDER_ONEHOT)


@register("validate_schema", W(_DIRTY, f"""
broken AS (
  {_V1_NULLS} UNION ALL {_V1_ONEHOT}
  UNION ALL SELECT 2, 'answer_idx: unknown label "' || answer_idx || '"' FROM dirty WHERE {_BAD_ANS}
  UNION ALL SELECT 4, 'gender: not exactly one flag is set' FROM dirty
  WHERE coalesce(gender_male + gender_female + gender_none <> 1, true)
  UNION ALL SELECT 5, 'ethnicity: unknown label "' || ethnicity || '"' FROM dirty WHERE {_BAD_ETH})""", """
SELECT seq, what || ' in ' || CAST(count(*) AS VARCHAR) || ' rows' AS message FROM broken GROUP BY seq, what"""))
def q_validate(spark, sf):
    """V1: the validation messages, one row per violated check and item."""
    return V.validation_messages(FX.dirty_variants(spark, sf))


@register("gender_counts", W(VARIANTS, f"SELECT {GENDER_SQL} AS gender, CAST(count(*) AS BIGINT) AS n FROM variants GROUP BY 1"))
def q_gender_counts(spark, sf):
    return V.gender_counts(FX.variants(spark, sf))


@register("ethnicity_counts", W(VARIANTS, "SELECT ethnicity, CAST(count(*) AS BIGINT) AS n FROM variants WHERE ethnicity IS NOT NULL GROUP BY 1"))
def q_eth_counts(spark, sf):
    return V.ethnicity_counts(FX.variants(spark, sf))


@register("gender_ethnicity_crosstab", W(VARIANTS, f"""
SELECT {GENDER_SQL} AS gender, ethnicity, CAST(count(*) AS BIGINT) AS n FROM variants
WHERE ethnicity IS NOT NULL GROUP BY 1, 2"""))
def q_crosstab(spark, sf):
    return V.gender_ethnicity_crosstab(FX.variants(spark, sf))


@register("variants_per_case", W(VARIANTS, "SELECT case_id, CAST(count(*) AS BIGINT) AS n_variants FROM variants GROUP BY 1"))
def q_vpc(spark, sf):
    return V.variants_per_case(FX.variants(spark, sf))


@register("variant_counts_valid", W(VARIANTS, """
n AS (SELECT count(DISTINCT ethnicity) AS k FROM variants),
per AS (SELECT case_id, count(*) AS c FROM variants GROUP BY 1)""", """
SELECT CAST((SELECT k FROM n) AS BIGINT) AS n_ethnicities,
       CAST(coalesce(bool_and(c = 2 * (SELECT k FROM n) OR c = 3 * (SELECT k FROM n)), true) AS INTEGER) AS all_valid
FROM per"""))
def q_vcv(spark, sf):
    return V.variant_counts_valid(FX.variants(spark, sf))


_NULL_COLS = _ALLV.split(", ")
_DTYPES = {"case_key": "bigint", "gender_male": "int", "gender_female": "int", "gender_none": "int",
           "variant_idx": "int"}


@register("null_profile", W(VARIANTS, "SELECT column_name, n_null FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM variants" for c in _NULL_COLS) + ")"))
def q_null_profile(spark, sf):
    return V.null_profile(FX.variants(spark, sf).select(*_NULL_COLS)).withColumn("n_null", F.col("n_null").cast("long"))


@register("answer_distribution", W(VARIANTS, "SELECT answer_idx, CAST(count(*) AS BIGINT) AS n FROM variants WHERE answer_idx IS NOT NULL GROUP BY 1"))
def q_answer_dist(spark, sf):
    return V.answer_distribution(FX.variants(spark, sf))


@register("shape_profile", W(VARIANTS, f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, {len(_NULL_COLS)} AS n_columns,
       '{",".join(f"{c}:{_DTYPES.get(c, 'string')}" for c in _NULL_COLS)}' AS dtypes FROM variants"""))
def q_shape(spark, sf):
    return V.shape_profile(FX.variants(spark, sf).select(*_NULL_COLS))


@register("auto_null_option_d", W(VARIANTS, "SELECT CAST(count(option_d) = 0 AS INTEGER) AS allow_null_option_d FROM variants"))
def q_auto_null(spark, sf):
    return V.auto_null_option_d(FX.variants(spark, sf))


_RULES_SQL = W(VARIANTS, f"""
base AS (
  SELECT
    count_if(coalesce(trim(question) = '', false)) AS question_nonempty,
    count_if(coalesce(trim(option_a) = '', false)) AS option_a_nonempty,
    count_if(coalesce(trim(option_b) = '', false)) AS option_b_nonempty,
    count_if(coalesce(trim(option_c) = '', false)) AS option_c_nonempty,
    count_if(NOT coalesce(answer_idx IN ('A', 'B', 'C', 'D'), false)) AS answer_idx_valid,
    count_if(coalesce(gender_male + gender_female + gender_none <> 1, true)) AS onehot_sum_one,
    count_if(option_d IS NULL) AS option_d_never_null,
    count_if(NOT coalesce(regexp_matches(case_id, '^doc_\\d+$'), false)) AS case_id_format,
    count_if(NOT coalesce(strpos(case_text, ethnicity) > 0, false)) AS ethnicity_in_case_text,
    max(gender_male) AS m, max(gender_female) AS f, max(gender_none) AS nn,
    count(DISTINCT ethnicity) AS n_eth,
    count(DISTINCT CASE WHEN ethnicity NOT IN ('White', 'Black', 'Asian', 'Hispanic', 'Arab') THEN ethnicity END) AS extra,
    {" + ".join(f"(1 - coalesce(max(CASE WHEN ethnicity = '{e}' THEN 1 ELSE 0 END), 0))" for e in S.ETHNICITIES)} AS missing,
    count(*) AS n,
    avg(CASE WHEN coalesce(trim(explanation) <> '', false) THEN 1.0 ELSE 0.0 END) AS expl,
    count_if(coalesce(trim(specialty) <> '', false)) AS spec
  FROM variants
)""", """
SELECT rule, CAST(n_bad AS BIGINT) AS n_bad, CAST(n_bad = 0 AS INTEGER) AS ok FROM (
  SELECT 'question_nonempty' AS rule, question_nonempty AS n_bad FROM base
  UNION ALL SELECT 'option_a_nonempty', option_a_nonempty FROM base
  UNION ALL SELECT 'option_b_nonempty', option_b_nonempty FROM base
  UNION ALL SELECT 'option_c_nonempty', option_c_nonempty FROM base
  UNION ALL SELECT 'answer_idx_valid', answer_idx_valid FROM base
  UNION ALL SELECT 'onehot_sum_one', onehot_sum_one FROM base
  UNION ALL SELECT 'option_d_never_null', option_d_never_null FROM base
  UNION ALL SELECT 'case_id_format', case_id_format FROM base
  UNION ALL SELECT 'ethnicity_in_case_text', ethnicity_in_case_text FROM base
  UNION ALL SELECT 'male_present', CASE WHEN m = 1 THEN 0 ELSE 1 END FROM base
  UNION ALL SELECT 'female_present', CASE WHEN f = 1 THEN 0 ELSE 1 END FROM base
  UNION ALL SELECT 'none_present', CASE WHEN nn = 1 THEN 0 ELSE 1 END FROM base
  UNION ALL SELECT 'ethnicity_set_equal', extra + missing FROM base
  UNION ALL SELECT 'row_count_multiple', n % greatest(n_eth, 1) FROM base
  UNION ALL SELECT 'explanation_mostly_nonempty', CASE WHEN coalesce(expl, 0) >= 0.95 THEN 0 ELSE 1 END FROM base
  UNION ALL SELECT 'specialty_not_all_empty', CASE WHEN spec > 0 THEN 0 ELSE 1 END FROM base
)""")


@register("quality_rules", _RULES_SQL)
def q_rules(spark, sf):
    return V.quality_rules(FX.variants(spark, sf), option_d="never_null", case_id_pattern=r"^doc_\d+$")


# ------------------------------------------------------- R: report ----

@register("dataset_overview", W(VARIANTS, f"""
SELECT CAST(count(DISTINCT case_id) AS BIGINT) AS n_cases, CAST(count(*) AS BIGINT) AS n_rows,
       CAST((SELECT count_if(coalesce({Q.ethnicity_mention_sql('case_text')}, false)) FROM cases) AS BIGINT) AS n_dropped
FROM variants"""))
def q_overview(spark, sf):
    c = FX.cases(spark, sf)
    return R.dataset_overview(TV.build_variants(c, fallback_prepend=True), TV.count_ethnicity_mentions(c))


@register("original_gender_distribution", W(VARIANTS, """
per AS (SELECT case_id, max(gender_none) AS neutral FROM variants GROUP BY 1),
t AS (SELECT count_if(coalesce(neutral, 0) = 0) AS w, count_if(neutral = 1) AS wo, count(*) AS total FROM per)""", """
SELECT 'gender keyword present' AS category, CAST(w AS BIGINT) AS cases, round(100.0 * w / total, 1) AS pct FROM t
UNION ALL SELECT 'no gender keyword', CAST(wo AS BIGINT), round(100.0 * wo / total, 1) FROM t"""))
def q_orig_gender(spark, sf):
    return R.original_gender_distribution(FX.variants(spark, sf))


@register("variant_distribution", W(VARIANTS, f"""
SELECT 'gender' AS section, {GENDER_SQL} AS key1, CAST(NULL AS VARCHAR) AS key2, CAST(count(*) AS BIGINT) AS value
FROM variants GROUP BY 2
UNION ALL SELECT 'ethnicity', ethnicity, NULL, count(*) FROM variants WHERE ethnicity IS NOT NULL GROUP BY 2
UNION ALL SELECT 'crosstab', {GENDER_SQL}, ethnicity, count(*) FROM variants WHERE ethnicity IS NOT NULL GROUP BY 2, 3"""))
def q_var_dist(spark, sf):
    return R.variant_distribution(FX.variants(spark, sf))


@register("specialty_top20", W(VARIANTS, """
SELECT specialty, CAST(count(*) AS BIGINT) AS n FROM variants WHERE specialty IS NOT NULL
GROUP BY 1 ORDER BY n DESC, specialty ASC LIMIT 20"""))
def q_top20(spark, sf):
    return R.specialty_top20(FX.variants(spark, sf))


@register("sample_rows", W(VARIANTS, """
SELECT case_id, case_text, question, option_a, option_b, option_c, option_d, answer_idx,
       gender_male, gender_female, gender_none, ethnicity, variant_idx
FROM variants ORDER BY case_id, variant_idx LIMIT 5"""))
def q_sample(spark, sf):
    return R.sample_rows(FX.variants(spark, sf), 5)


@register("expansion_summary", W(VARIANTS, """
SELECT CAST((SELECT count(*) FROM kept) AS BIGINT) AS original_rows, CAST(count(*) AS BIGINT) AS variant_rows,
       CAST(floor(count(*) / (SELECT count(*) FROM kept)) AS BIGINT) AS expansion_factor,
       11 AS original_columns, 16 AS variant_columns
FROM variants"""))
def q_expansion(spark, sf):
    c = FX.cases(spark, sf)
    kept = TV.filter_ethnicity_mentions(c)
    return R.expansion_summary(kept, TV.expand_to_variants(kept, fallback_prepend=True))


@register("expansion_distributions", W(VARIANTS, f"""
SELECT 'gender' AS section, {GENDER_SQL} AS key1, CAST(NULL AS VARCHAR) AS key2, CAST(count(*) AS BIGINT) AS value FROM variants GROUP BY 2
UNION ALL SELECT 'ethnicity', ethnicity, NULL, CAST(count(*) AS BIGINT) FROM variants WHERE ethnicity IS NOT NULL GROUP BY 2
UNION ALL SELECT 'answer', answer_idx, NULL, CAST(count(*) AS BIGINT) FROM variants WHERE answer_idx IS NOT NULL GROUP BY 2"""))
def q_expansion_distributions(spark, sf):
    """The distributions beside the expansion summary."""
    return R.expansion_distributions(FX.variants(spark, sf, fallback_prepend=True))


@register("before_after_examples", W(VARIANTS, f"""
first AS (SELECT case_id, substr(case_text, 1, 400) AS original_snippet FROM kept ORDER BY case_id LIMIT 10)""", f"""
SELECT f.case_id, f.original_snippet, v.variant_idx, {GENDER_SQL} AS gender, v.ethnicity,
       substr(replace(substr(v.case_text, 1, 300), chr(10), ' '), 1, 120) AS variant_snippet
FROM first f JOIN variants v USING (case_id)"""))
def q_before_after(spark, sf):
    c = FX.cases(spark, sf)
    kept = TV.filter_ethnicity_mentions(c)
    return R.before_after_examples(kept, lambda c: TV.expand_to_variants(c, fallback_prepend=True), 10)


# ------------------------------------------------- B: pairwise overlap ----

from ..operators import embedding as E  # noqa: E402
from ..operators import overlap as B  # noqa: E402

def bleu_ctes(responses_cte: str) -> str:
    """BLEU oracle CTE chain over a CTE ``responses(case_id, variant_idx, response)`` (brute-force pairs)."""
    return responses_cte + f""",
resp AS (SELECT case_id, variant_idx AS idx, {Q.tokens_sql('response')} AS tokens
         FROM responses WHERE response IS NOT NULL),
grams AS (
  SELECT case_id, idx, n, array_to_string(list_slice(tokens, i, i + n - 1), ' ') AS gram
  FROM (SELECT case_id, idx, n, tokens, unnest(generate_series(1, len(tokens) - n + 1)) AS i
        FROM resp, (VALUES (1), (2), (3), (4)) v(n) WHERE len(tokens) >= n)
),
gc AS (SELECT case_id, idx, n, gram, count(*) AS c FROM grams GROUP BY ALL),
m AS (
  SELECT a.case_id, a.idx AS i, b.idx AS j,
         sum(CASE WHEN a.n = 1 THEN least(a.c, b.c) END) AS m1, sum(CASE WHEN a.n = 2 THEN least(a.c, b.c) END) AS m2,
         sum(CASE WHEN a.n = 3 THEN least(a.c, b.c) END) AS m3, sum(CASE WHEN a.n = 4 THEN least(a.c, b.c) END) AS m4
  FROM gc a JOIN gc b ON a.case_id = b.case_id AND a.n = b.n AND a.gram = b.gram AND a.idx < b.idx
  GROUP BY ALL
),
allpairs AS (
  SELECT a.case_id, a.idx AS i, b.idx AS j, len(a.tokens) AS rl, len(b.tokens) AS cl
  FROM resp a JOIN resp b ON a.case_id = b.case_id AND a.idx < b.idx
),
scored AS (
  SELECT p.case_id, p.i, p.j,
         CASE WHEN coalesce(m.m1, 0) = 0 THEN 0.0 ELSE
           (CASE WHEN p.cl > p.rl THEN 1.0 ELSE exp(1 - p.rl / p.cl) END) * exp((
             ln(CASE WHEN coalesce(m.m1, 0) > 0 THEN m.m1 ELSE 0.1 END / greatest(1, p.cl)) +
             ln(CASE WHEN coalesce(m.m2, 0) > 0 THEN m.m2 ELSE 0.1 END / greatest(1, p.cl - 1)) +
             ln(CASE WHEN coalesce(m.m3, 0) > 0 THEN m.m3 ELSE 0.1 END / greatest(1, p.cl - 2)) +
             ln(CASE WHEN coalesce(m.m4, 0) > 0 THEN m.m4 ELSE 0.1 END / greatest(1, p.cl - 3))) / 4) END AS bleu
  FROM allpairs p LEFT JOIN m USING (case_id, i, j)
),
case_bleu AS (
  SELECT c.case_id, CASE WHEN c.k < 2 THEN NULL ELSE (SELECT avg(bleu) FROM scored s WHERE s.case_id = c.case_id) END AS bleu
  FROM (SELECT case_id, count(response) AS k FROM responses GROUP BY 1) c
)"""


_BLEU_CORE = bleu_ctes(FX.RESPONSES_SQL)


@register("bleu_across_variants", W(_BLEU_CORE, "SELECT case_id, round(bleu, 9) AS bleu FROM case_bleu"))
def q_bleu(spark, sf):
    return r9(B.bleu_across_variants(FX.responses(spark, sf), response_col="response"))


@register("pair_bleu", W(_BLEU_CORE, "SELECT case_id, i AS ref_idx, j AS cand_idx, round(bleu, 9) AS bleu FROM scored WHERE bleu > 0"))
def q_pair_bleu(spark, sf):
    """B1 over every pair that shares a token (pairs without one score 0 and are not rows)."""
    return r9(B.bleu_pair_scores(FX.responses(spark, sf), response_col="response"))


@register("low_consistency_flag", W(_BLEU_CORE, "SELECT case_id, round(bleu, 9) AS bleu FROM case_bleu WHERE bleu < 0.5"))
def q_low(spark, sf):
    return r9(B.low_consistency(B.bleu_across_variants(FX.responses(spark, sf), response_col="response")))


@register("consistency_summary", W(_BLEU_CORE, """
SELECT round(avg(bleu), 9) AS mean_score, CAST(count(bleu) AS BIGINT) AS n_scored FROM case_bleu"""))
def q_consistency(spark, sf):
    from ..operators.answers import consistency_summary
    return r9(consistency_summary(B.bleu_across_variants(FX.responses(spark, sf), response_col="response"), "bleu"))


# The oracle's LCS is a reduction over rows of matches (each row a running maximum); stems come from a table of distinct words.

def _rouge_tokens_sql(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _rouge_sql(a: str, b: str) -> str:
    """ROUGE-L F of two token lists."""
    lcs = (f"list_last(list_reduce(list_concat([list_transform({b}, lambda y: 0)], "
           f"list_transform({a}, lambda x: list_transform({b}, lambda y: CAST(x = y AS INTEGER)))), "
           f"lambda acc, m: list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1), "
           f"lambda i: CASE WHEN m[i] = 1 THEN CASE WHEN i > 1 THEN acc[i - 1] ELSE 0 END + 1 ELSE acc[i] END)))))")
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE 2.0 * {lcs} / (len({a}) + len({b})) END")


def _stemmed_ctes(texts: str, keys: str, text: str) -> str:
    """CTEs ``tokens(keys, t)``: the stemmed token lists of the rows of ``texts`` (rows without a token have an empty list)."""
    return f"""
raw AS (SELECT row_number() OVER () AS r, {keys}, {_rouge_tokens_sql(text)} AS t FROM {texts}),
cut AS (SELECT r, unnest(generate_series(1, len(t))) AS pos, unnest(t) AS token FROM raw),
words AS (SELECT DISTINCT token FROM cut),
{Q.stem_ctes('words')},
tokens AS (SELECT {keys}, coalesce(s.t, []) AS t
           FROM raw LEFT JOIN (SELECT r, list(stem ORDER BY pos) AS t FROM cut JOIN stems USING (token) GROUP BY r) s USING (r))"""


# Twelve whole documents a case, and cases of many copies of short answers.

@register("bleu_load", W(bleu_ctes(FX.LOAD_RESPONSES_SQL), "SELECT case_id, round(bleu, 9) AS bleu FROM case_bleu"))
def q_bleu_load(spark, sf):
    """B2 on whole documents as responses, 66 pairs a case."""
    return r9(B.bleu_across_variants(FX.load_responses(spark, sf), response_col="response"))


@register("bleu_copies", W(bleu_ctes(FX.COPIED_RESPONSES_SQL), "SELECT case_id, round(bleu, 9) AS bleu FROM case_bleu"))
def q_bleu_copies(spark, sf):
    """B2 where most responses of a case are copies of a few texts."""
    return r9(B.bleu_across_variants(FX.copied_responses(spark, sf), response_col="response"))


@register("rouge_l_load")
def q_rouge_load(spark, sf):
    """B4 on whole documents as responses; the SQL reduction is cubic in their length, so the tests hold it against all pairs."""
    return r9(B.rouge_l_across_variants(FX.load_responses(spark, sf), response_col="response"))


@register("rouge_l_across_variants", W(FX.RESPONSES_SQL, "given AS (SELECT * FROM responses WHERE response IS NOT NULL)",
                                       _stemmed_ctes("given", "case_id, variant_idx", "response"), f"""
p AS (SELECT a.case_id, avg({_rouge_sql('a.t', 'b.t')}) AS m
      FROM tokens a JOIN tokens b ON a.case_id = b.case_id AND a.variant_idx < b.variant_idx GROUP BY 1)""", """
SELECT k.case_id, round(p.m, 9) AS rouge_l FROM (SELECT DISTINCT case_id FROM responses) k LEFT JOIN p USING (case_id)"""))
def q_rouge(spark, sf):
    return r9(B.rouge_l_across_variants(FX.responses(spark, sf), response_col="response"))


@register("pair_rouge_l", W(_stemmed_ctes("conversations", "conv_id, turn", "coalesce(text, '')"), f"""
SELECT a.conv_id, a.turn, round({_rouge_sql('a.t', 'b.t')}, 9) AS rouge_l
FROM tokens a JOIN tokens b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""))
def q_pair_rouge(spark, sf):
    """B3 on consecutive turns of each conversation (reference = earlier turn)."""
    c = FX.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    pairs = c.join(nxt, ["conv_id", "turn"])
    return r9(B.pair_rouge_l(pairs, reference_col="text", candidate_col="next_text")
              .select("conv_id", "turn", "rouge_l"))


@register("stem_words", W(f"""
raw AS (SELECT unnest({_rouge_tokens_sql("text")}) AS token FROM documents),
words AS (SELECT DISTINCT token FROM raw)""", Q.stem_ctes("words"), "SELECT token, stem FROM stems"))
def q_stems(spark, sf):
    """The stem of every distinct word of all documents."""
    words = FX.table(spark, sf, "documents").select(F.explode(B.rouge_tokens("text")).alias("token")).distinct()
    return words.select("token", F.element_at(B.stem_tokens(F.array("token")), 1).alias("stem"))


@register("pair_rouge_l_plain", f"""
WITH c AS (SELECT conv_id, turn, {_rouge_tokens_sql("coalesce(text, '')")} AS t FROM conversations)
SELECT a.conv_id, a.turn, round({_rouge_sql('a.t', 'b.t')}, 9) AS rouge_l
FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def q_pair_rouge_plain(spark, sf):
    """B3 without stemming on consecutive turns."""
    c = FX.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return r9(B.pair_rouge_l(c.join(nxt, ["conv_id", "turn"]), reference_col="text", candidate_col="next_text", stem=False)
              .select("conv_id", "turn", "rouge_l"))


@register("rouge_l_across_variants_plain", W(FX.RESPONSES_SQL, f"""
t AS (SELECT case_id, variant_idx, {_rouge_tokens_sql("response")} AS t FROM responses WHERE response IS NOT NULL)""", f"""
p AS (SELECT a.case_id, avg({_rouge_sql('a.t', 'b.t')}) AS m FROM t a JOIN t b ON a.case_id = b.case_id AND a.variant_idx < b.variant_idx
      GROUP BY 1)""", """
SELECT k.case_id, round(p.m, 9) AS rouge_l FROM (SELECT DISTINCT case_id FROM responses) k LEFT JOIN p USING (case_id)"""))
def q_rouge_plain(spark, sf):
    """B4 without stemming: tokenising, pairing, weights and the F formula against all pairs."""
    return r9(B.rouge_l_across_variants(FX.responses(spark, sf), response_col="response", stem=False))


# ----------------------------------------------------- E: embeddings ----

@register("cosine_similarity", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id, round(CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
       ELSE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) END, 9) AS cosine
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def q_cosine(spark, sf):
    e = FX.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_embedding"))
    return r9(e.join(nxt, "vec_id").select("vec_id", E.cosine_similarity("embedding", "next_embedding").alias("cosine")))


@register("cossim_across_variants", W(FX.EMBEDDED_RESPONSES_SQL, """
pairs AS (
  SELECT a.case_id, CASE WHEN list_dot_product(a.embedding, a.embedding) = 0 OR list_dot_product(b.embedding, b.embedding) = 0
         THEN 0.0 ELSE list_dot_product(a.embedding, b.embedding)
              / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))) END AS cs
  FROM embedded a JOIN embedded b ON a.case_id = b.case_id AND a.vec_id < b.vec_id)""", """
SELECT c.case_id, round(CASE WHEN c.k < 2 THEN NULL ELSE (SELECT avg(cs) FROM pairs p WHERE p.case_id = c.case_id) END, 9) AS cossim
FROM (SELECT case_id, count(*) AS k FROM embedded WHERE embedding IS NOT NULL GROUP BY 1) c"""))
def q_cossim(spark, sf):
    return r9(E.cossim_across_variants(FX.embedded_responses(spark, sf)))


_PAIRS_SQL = FX.SCORED_CASES_SQL + """,
pairs AS (SELECT f.vec_id AS pid, CAST(f.embedding AS DOUBLE[]) AS fe, CAST(m.embedding AS DOUBLE[]) AS me
          FROM embeddings f JOIN embeddings m ON m.vec_id = f.vec_id + 1 WHERE f.vec_id % 2 = 0),
dd AS (SELECT pid, unnest(generate_series(1, len(fe))) AS dim, unnest(fe) AS fv, unnest(me) AS mv FROM pairs)"""

_SCORES_SQL = """,
gn AS (SELECT sqrt(sum(gv * gv)) AS norm FROM g),
ed AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS dim, unnest(embedding) AS ev FROM scored_cases),
scores AS (
  SELECT s.*, (SELECT sum(ed.ev * g.gv) FROM ed JOIN g USING (dim) WHERE ed.vec_id = s.vec_id) / (SELECT norm FROM gn)
         AS gender_bias_score
  FROM scored_cases s
),
labeled AS (SELECT *, CASE WHEN gender_male = 1 THEN 'male' WHEN gender_female = 1 THEN 'female'
                         WHEN gender_none = 1 THEN 'none' ELSE 'unknown' END AS gender FROM scores)"""

_DIRECTION_SQL = _PAIRS_SQL + """,
g AS (SELECT dim, avg(fv - mv) AS gv FROM dd GROUP BY dim)""" + _SCORES_SQL

# The first principal component by a recursive CTE: covariance rows, then products until the vector stands still.
_PCA_SQL = _PAIRS_SQL + """,
centred AS (SELECT pid, dim, fv - mv - avg(fv - mv) OVER (PARTITION BY dim) AS z FROM dd),
products AS (SELECT a.dim AS i, b.dim AS j, sum(a.z * b.z) AS c FROM centred a JOIN centred b USING (pid) GROUP BY a.dim, b.dim),
matrix AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM products GROUP BY i)),
iterated AS (
  SELECT 0 AS k, list_transform(range(1, len(m) + 1), lambda i: 1.0::DOUBLE / i) AS v, 1.0::DOUBLE AS gap FROM matrix
  UNION ALL
  SELECT k + 1, w, list_distance(v, w) FROM (
    SELECT k, v, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS w FROM (
      SELECT k, v, list_transform(m, lambda r: list_dot_product(r, v)) AS u FROM iterated, matrix WHERE gap > 1e-14 AND k < 20000))
),
component AS (SELECT v FROM iterated ORDER BY k DESC LIMIT 1),
loadings AS (SELECT unnest(generate_series(1, len(v))) AS dim, unnest(v) AS x FROM component),
g AS (SELECT dim, x * (SELECT CASE WHEN arg_max(x, abs(x)) < 0 THEN -1 ELSE 1 END FROM loadings) AS gv FROM loadings)""" + _SCORES_SQL


def WR(*parts: str) -> str:
    return W(*parts).replace("WITH", "WITH RECURSIVE", 1)


def _scored_rows(spark, sf):
    # d floats (bounded by the embedding dimension), used as a literal array.
    direction = E.gender_direction_mean(FX.sentence_pairs(spark, sf)).first()["direction"]
    return E.gender_bias_score(FX.scored_cases(spark, sf), direction)


@register("gender_bias_score", W(_DIRECTION_SQL, "SELECT vec_id, round(gender_bias_score, 9) AS gender_bias_score FROM scores"))
def q_bias_score(spark, sf):
    return r9(_scored_rows(spark, sf).select("vec_id", "gender_bias_score"))


@register("gender_bias_by_gender", W(_DIRECTION_SQL, """
SELECT gender, round(avg(gender_bias_score), 9) AS mean, round(stddev_samp(gender_bias_score), 9) AS std
FROM labeled WHERE gender_bias_score IS NOT NULL GROUP BY gender"""))
def q_bias_gender(spark, sf):
    return r9(E.bias_by_gender(_scored_rows(spark, sf)))


@register("gender_bias_by_ethnicity", W(_DIRECTION_SQL, """
SELECT ethnicity, round(avg(gender_bias_score), 9) AS mean, round(stddev_samp(gender_bias_score), 9) AS std
FROM labeled WHERE gender_bias_score IS NOT NULL AND ethnicity IS NOT NULL GROUP BY ethnicity"""))
def q_bias_eth(spark, sf):
    return r9(E.bias_by_ethnicity(_scored_rows(spark, sf)))


@register("gender_bias_crosstab", W(_DIRECTION_SQL, """
SELECT gender, ethnicity, round(avg(gender_bias_score), 9) AS mean
FROM labeled WHERE gender_bias_score IS NOT NULL AND ethnicity IS NOT NULL GROUP BY gender, ethnicity"""))
def q_bias_x(spark, sf):
    return r9(E.bias_crosstab(_scored_rows(spark, sf)))


@register("median_bias", W(_DIRECTION_SQL, "SELECT round(median(gender_bias_score), 9) AS mb FROM scores"))
def q_median(spark, sf):
    return r9(E.median_bias(_scored_rows(spark, sf)))


@register("original_bias", W(_DIRECTION_SQL, """
SELECT gender, 'original' AS ethnicity, round(avg(gender_bias_score), 9) AS mean,
       round(stddev_samp(gender_bias_score), 9) AS std
FROM labeled WHERE gender_bias_score IS NOT NULL GROUP BY gender"""))
def q_original_bias(spark, sf):
    """The bias summary of unexpanded rows tagged with ethnicity 'original'."""
    return r9(E.original_bias(_scored_rows(spark, sf)))


# E4 with E5-E9 on it: pairs -> principal component -> scores in one plan.

def _pca_rows(spark, sf):
    direction = E.gender_direction(FX.sentence_pairs(spark, sf)).select("direction").scalar()
    return E.gender_bias_score(FX.scored_cases(spark, sf).withColumn("_g", direction), F.col("_g"))


@register("gender_direction", WR(_PCA_SQL, "SELECT CAST(dim - 1 AS INTEGER) AS dim, round(gv, 9) AS loading FROM g"))
def q_direction(spark, sf):
    """First principal component of the sentence-pair differences, by power iteration."""
    return r9(E.gender_direction(FX.sentence_pairs(spark, sf)).select(F.posexplode("direction").alias("dim", "loading")))


@register("gender_bias_score_pca", WR(_PCA_SQL, "SELECT vec_id, round(gender_bias_score, 9) AS gender_bias_score FROM scores"))
def q_bias_score_pca(spark, sf):
    return r9(_pca_rows(spark, sf).select("vec_id", "gender_bias_score"))


@register("gender_bias_by_ethnicity_pca", WR(_PCA_SQL, """
SELECT ethnicity, round(avg(gender_bias_score), 9) AS mean, round(stddev_samp(gender_bias_score), 9) AS std
FROM labeled WHERE gender_bias_score IS NOT NULL AND ethnicity IS NOT NULL GROUP BY ethnicity"""))
def q_bias_eth_pca(spark, sf):
    return r9(E.bias_by_ethnicity(_pca_rows(spark, sf)))


@register("original_bias_pca", WR(_PCA_SQL, """
SELECT gender, 'original' AS ethnicity, round(avg(gender_bias_score), 9) AS mean,
       round(stddev_samp(gender_bias_score), 9) AS std
FROM labeled WHERE gender_bias_score IS NOT NULL GROUP BY gender"""))
def q_original_bias_pca(spark, sf):
    return r9(E.original_bias(_pca_rows(spark, sf)))


# ---------------------------------------------------------- P: prompts ----

from ..operators import prompts as P  # noqa: E402


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_OPTS_SQL = ("concat_ws(chr(10), 'A. ' || option_a, 'B. ' || option_b, 'C. ' || option_c, 'D. ' || option_d)")
_BIND_SQL = {"CLINICAL_CASE": "case_text", "QUESTION": "question", "OPTIONS": _OPTS_SQL, "SOLUTION": "answer_idx",
             "SPECIFIC": "''", "question": "question", "answer_choices": _OPTS_SQL, "few-shot examples": "''"}


def _render_sql(template: str) -> str:
    parts = [_sql_lit(v) if k == "lit" else f"coalesce({_BIND_SQL[v]}, '')" for k, v in P.split_template(template)]
    return " || ".join(parts)


@register("options_block", W(KEPT_ONLY, f"SELECT case_id, {_OPTS_SQL} AS options FROM kept"))
def q_options(spark, sf):
    kept = TV.filter_ethnicity_mentions(FX.cases(spark, sf))
    return kept.select("case_id", P.options_block().alias("options"))


@register("render_prompt", W(KEPT_ONLY, f"SELECT case_id, {_render_sql(P.TEMPLATES['p1'])} AS prompt FROM kept"))
def q_render(spark, sf):
    kept = TV.filter_ethnicity_mentions(FX.cases(spark, sf))
    return P.render_prompt(kept, P.TEMPLATES["p1"]).select("case_id", "prompt")


@register("prompt_grid", W(KEPT_ONLY, " UNION ALL ".join(
    f"SELECT case_id, '{pid}' AS prompt_id, {_render_sql(t)} AS prompt FROM kept" for pid, t in P.TEMPLATES.items())))
def q_grid(spark, sf):
    kept = TV.filter_ethnicity_mentions(FX.cases(spark, sf))
    return P.prompt_grid(kept).select("case_id", "prompt_id", "prompt")


# The specific question and the few-shot block bound to columns, over every variant; digests instead of whole prompts.
_GRID_SQL = {"SPECIFIC": "'Think of ' || specialty", "few-shot examples": "'Example: ' || question"}


@register("prompt_grid_variants", W(VARIANTS, " UNION ALL ".join(
    f"SELECT case_id, variant_idx, '{pid}' AS prompt_id, md5("
    + " || ".join(_sql_lit(v) if k == "lit" else f"coalesce({_GRID_SQL.get(v, _BIND_SQL[v])}, '')" for k, v in P.split_template(t))
    + ") AS prompt_md5 FROM variants" for pid, t in P.TEMPLATES.items())))
def q_grid_variants(spark, sf):
    """Every variant x every prompt condition with SPECIFIC and few-shot columns bound."""
    bound = {"SPECIFIC": F.concat(F.lit("Think of "), "specialty"), "few-shot examples": F.concat(F.lit("Example: "), "question")}
    grid = P.prompt_grid(FX.variants(spark, sf, fallback_prepend=True), bindings=bound)
    return grid.select("case_id", "variant_idx", "prompt_id", F.md5("prompt").alias("prompt_md5"))


_SHOTS = 3
_SHOT_TEXT = f"'Question: ' || question || chr(10) || {_OPTS_SQL} || chr(10) || 'Answer: ' || coalesce(answer_idx, '')"


def _few_shot_ctes(rows: str, key: str) -> str:
    """CTE ``shots(key, ids, texts)``: the chosen examples of every row of ``rows``, by ranking all cases of its specialty."""
    return f"""
ranked AS (
  SELECT {key}, k.case_id AS example, {_SHOT_TEXT.replace('question', 'k.question').replace('option_', 'k.option_').replace('answer_idx', 'k.answer_idx')} AS shot,
         row_number() OVER (PARTITION BY {key} ORDER BY left(md5(k.case_id), 1) <> left(md5(r.case_id), 1), md5(k.case_id), k.case_id) AS n
  FROM {rows} r JOIN kept k ON k.specialty = r.specialty AND k.case_id <> r.case_id),
shots AS (SELECT {key.replace('r.', '')}, string_agg(example, ',' ORDER BY n) AS ids, string_agg(shot, chr(10) || chr(10) ORDER BY n) AS texts
          FROM ranked WHERE n <= {_SHOTS} GROUP BY ALL)"""


@register("few_shot_examples", W(KEPT_ONLY, _few_shot_ctes("kept", "r.case_id"), """
SELECT kept.case_id, coalesce(ids, '') AS example_ids, md5(coalesce(texts, '')) AS examples_md5 FROM kept LEFT JOIN shots USING (case_id)"""))
def q_few_shot(spark, sf):
    """Three worked examples of the same specialty for every case."""
    kept = TV.filter_ethnicity_mentions(FX.cases(spark, sf))
    return P.few_shot_examples(kept, kept, _SHOTS).select(
        "case_id", F.array_join("few_shot_ids", ",").alias("example_ids"), F.md5("few_shot").alias("examples_md5"))


def _messages_sql(templates: dict) -> str:
    bound = {**_BIND_SQL, "SPECIFIC": "'ethnicity'", "few-shot examples": "coalesce(texts, '')"}
    whole = lambda t: " || ".join(_sql_lit(v) if k == "lit" else f"coalesce({bound[v]}, '')" for k, v in P.split_template(t))
    return " UNION ALL ".join(f"SELECT variants.case_id, variant_idx, '{i}' AS prompt_id, md5({whole(P.SYSTEM_TEMPLATES[i])}) AS system_md5, "
                              f"md5({whole(t)}) AS prompt_md5 FROM variants LEFT JOIN shots USING (case_id)" for i, t in templates.items())


@register("prompt_messages", W(VARIANTS, _few_shot_ctes("kept", "r.case_id"), _messages_sql(P.TEMPLATES)))
def q_messages(spark, sf):
    """System and user text of every variant x prompt condition, with few-shot examples and an attribute bound."""
    kept = TV.filter_ethnicity_mentions(FX.cases(spark, sf))
    shots = P.few_shot_examples(FX.variants(spark, sf, fallback_prepend=True), kept, _SHOTS)
    grid = P.prompt_messages(shots, {"SPECIFIC": F.lit("ethnicity"), "few-shot examples": F.col("few_shot")})
    return grid.select("case_id", "variant_idx", "prompt_id", F.md5("system").alias("system_md5"), F.md5("prompt").alias("prompt_md5"))


@register("relevance_prompts", W(VARIANTS, " UNION ALL ".join(
    f"SELECT case_id, variant_idx, '{a}' AS attribute, md5("
    + " || ".join(_sql_lit(v) if k == "lit" else f"coalesce({dict(_BIND_SQL, SPECIFIC=_sql_lit(a))[v]}, '')"
                  for k, v in P.split_template(P.RELEVANCE_TEMPLATE)) + ") AS prompt_md5 FROM variants" for a in P.ATTRIBUTES)))
def q_relevance(spark, sf):
    """The relevance question on each attribute for every variant."""
    rows = P.relevance_prompts(FX.variants(spark, sf, fallback_prepend=True))
    return rows.select("case_id", "variant_idx", "attribute", F.md5("prompt").alias("prompt_md5"))


@register("parse_answer", r"""
SELECT conv_id, turn, nullif(regexp_extract(text, '(^|[^\pL\pN_])([A-D])([^\pL\pN_]|$)', 2), '') AS parsed_answer
FROM conversations""")
def q_parse(spark, sf):
    c = FX.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.parse_answer("text").alias("parsed_answer"))


def _compare_sql(prompts) -> str:
    long = FX.prompt_outputs_sql(prompts) + """,
long AS (
  """ + " UNION ALL ".join(
        f"SELECT '{p}' AS llm, answer_idx, ethnicity, gender_male, gender_female, gender_none, answer_{p} AS answer "
        f"FROM prompt_outputs" for p in prompts) + f"""
),
cube AS (
  SELECT llm, answer_idx, ethnicity, {GENDER_SQL} AS gender, COUNT(*) AS n,
         SUM(CASE WHEN answer = answer_idx THEN 1 ELSE 0 END) AS n_correct
  FROM long GROUP BY ALL
)""" + CELLS_TAIL + VS_TAIL + SKEW_TAIL + ",\n" + bleu_ctes("""responses AS (
  """ + " UNION ALL ".join(
        f"SELECT '{p}|' || case_id AS case_id, variant_idx, explanation_{p} AS response FROM prompt_outputs"
        for p in prompts) + """
)""")
    return W(long, """
pb AS (SELECT split_part(case_id, '|', 1) AS prompt_id, avg(bleu) AS mean_pairwise_bleu FROM case_bleu GROUP BY 1)""", """
SELECT coalesce(s.llm, pb.prompt_id) AS prompt_id, round(s.skewsize, 9) AS cramers_v_skew,
       round(pb.mean_pairwise_bleu, 9) AS mean_pairwise_bleu, s.n_cases
FROM skew s FULL JOIN pb ON s.llm = pb.prompt_id""")


def _compared(spark, sf, prompts):
    return r9(P.compare_prompts(FX.prompt_outputs(spark, sf, prompts), answer_cols={p: f"answer_{p}" for p in prompts},
                                explanation_cols={p: f"explanation_{p}" for p in prompts}))


@register("compare_prompts", _compare_sql(FX.PROMPT_IDS))
def q_compare(spark, sf):
    return _compared(spark, sf, FX.PROMPT_IDS)


@register("compare_prompts_all", _compare_sql(list(P.TEMPLATES)))
def q_compare_all(spark, sf):
    """P5 over all eight prompt conditions."""
    return _compared(spark, sf, list(P.TEMPLATES))


# ------------------------------------------------------ H: page extraction ----

from ..operators import extract as H  # noqa: E402


def _pages(spark, sf):
    return H.extract_pages(FX.table(spark, sf, "pages"))


@register("extract_listing")
def q_listing(spark, sf):
    return H.extract_listing(_pages(spark, sf))


@register("filter_year_cutoff")
def q_year(spark, sf):
    """H2, variant that keeps undated links and reports the year."""
    return H.filter_year_cutoff(H.extract_listing(_pages(spark, sf)), keep_undated=True, as_year=True)


@register("extract_answer_key")
def q_answer_key(spark, sf):
    return H.extract_answer_key(_pages(spark, sf))


@register("extract_sections")
def q_sections(spark, sf):
    return _pages(spark, sf).select("page_id", "paragraphs", "diagnosis", "chosen_option", "case_paras",
                                    "discussion_paras")


@register("has_image")
def q_has_image(spark, sf):
    return _pages(spark, sf).select("page_id", "has_image")


@register("article_type")
def q_article_type(spark, sf):
    return _pages(spark, sf).select("page_id", "article_type", "super_class")


@register("extract_mcq")
def q_mcq(spark, sf):
    return _pages(spark, sf).select("page_id", "mcq_title", "mcq_answers")


@register("assemble_raw_cases")
def q_assemble(spark, sf):
    """H8 + J4: link index joined with the extracted pages by URL."""
    return H.assemble_raw_cases(_pages(spark, sf), FX.link_index(spark, sf))


# The same operators on pages that carry dates, figures and section marks.

def _marked(spark, sf):
    return H.extract_pages(FX.marked_pages(spark, sf))


_CASE_SQL = "CASE WHEN long1 THEN [t] ELSE [] END"
_DISCUSSION_SQL = "CASE WHEN long2 THEN [t2] ELSE [] END"


@register("filter_year_cutoff_dated", W(FX.MARKED_SQL, f"""
SELECT k AS page_id, 0 AS pos, '/a/' || ks AS link,
       {FX.MONTHS!r}[k % 12 + 1] || ' ' || CAST(k % 28 + 1 AS VARCHAR) || ', ' || CAST(k % 12 + 2008 AS VARCHAR) AS date_text,
       printf('%02d_%d', k % 12 + 1, k % 12 + 2008) AS publication_year
FROM parts WHERE k % 12 + 2008 >= 2013"""))
def q_year_dated(spark, sf):
    return H.filter_year_cutoff(H.extract_listing(_marked(spark, sf)))


@register("extract_sections_marked", W(FX.MARKED_SQL, f"""
SELECT k AS page_id, 'Dx ' || ks AS diagnosis, CASE WHEN k % 2 = 0 THEN 'Option ' ELSE 'Dx ' END || ks AS chosen_option,
       md5(array_to_string(list_concat({_CASE_SQL}, {_DISCUSSION_SQL}), '|')) AS paragraphs,
       md5(array_to_string({_CASE_SQL}, '|')) AS case_paras, md5(array_to_string({_DISCUSSION_SQL}, '|')) AS discussion_paras
FROM parts"""))
def q_sections_marked(spark, sf):
    """H4 on marked pages; paragraph lists as digests."""
    digest = lambda c: F.md5(F.array_join(c, "|")).alias(c)
    return _marked(spark, sf).select("page_id", "diagnosis", "chosen_option", digest("paragraphs"), digest("case_paras"),
                                     digest("discussion_paras"))


@register("has_image_marked", W(FX.MARKED_SQL, "SELECT k AS page_id, CASE WHEN k % 4 = 0 THEN 'Yes' ELSE 'No' END AS has_image FROM parts"))
def q_image_marked(spark, sf):
    return _marked(spark, sf).select("page_id", "has_image")


@register("article_type_marked", W(FX.MARKED_SQL, """
SELECT k AS page_id, 'Title ' || ks AS article_type, CASE WHEN k % 5 < 3 THEN 'Class ' || CAST(k % 5 AS VARCHAR) END AS super_class FROM parts"""))
def q_article_type_marked(spark, sf):
    """H6 on marked pages: the article's type and, where the page has one, its super class."""
    return _marked(spark, sf).select("page_id", "article_type", "super_class")


@register("extract_answer_key_marked", W(FX.MARKED_SQL, """
SELECT k AS page_id, url, CASE WHEN k % 3 <> 0 THEN 'A' ELSE 'B' END AS answer_idx,
       CASE WHEN k % 3 <> 0 THEN 'first choice' ELSE 'second' END AS answer
FROM parts"""))
def q_answer_key_marked(spark, sf):
    return H.extract_answer_key(_marked(spark, sf))


@register("extract_mcq_marked", W(FX.MARKED_SQL, """
SELECT k AS page_id, 'Title ' || ks AS mcq_title, md5(array_to_string(list_concat(['Case', t, 'Diagnosis', 'Dx ' || ks],
       CASE WHEN k % 2 = 0 THEN ['What to Do Next', 'Option ' || ks] ELSE [] END,
       ['Discussion', t2, CASE WHEN k % 3 <> 0 THEN 'A. first choice' ELSE 'No key' END, 'B. second']), '|')) AS mcq_answers
FROM parts"""))
def q_mcq_marked(spark, sf):
    """H7 on marked pages; the answers as a digest."""
    return _marked(spark, sf).select("page_id", "mcq_title", F.md5(F.array_join("mcq_answers", "|")).alias("mcq_answers"))


@register("assemble_raw_cases_marked", W(FX.MARKED_SQL, """
SELECT p.url AS link, CAST(NULL AS VARCHAR) AS publication_year, substr('ABCD', CAST(l.page_id % 4 AS INT) + 1, 1) AS answer_idx,
       'answer ' || CAST(l.page_id AS VARCHAR) AS answer, md5(CASE WHEN long1 THEN t ELSE '' END || ' Title ' || ks) AS question,
       'Case' AS opa, md5(t) AS opb, 'Diagnosis' AS opc, 'Dx ' || ks AS opd, 'Dx ' || ks AS diagnosis,
       md5(CASE WHEN long2 THEN t2 ELSE '' END) AS explanation, 'Title ' || ks AS field,
       CASE WHEN k % 4 = 0 THEN 'Yes' ELSE 'No' END AS has_image
FROM parts p JOIN pages l ON l.url = p.url"""))
def q_assemble_marked(spark, sf):
    """H8 on marked pages; long texts as digests."""
    cases = H.assemble_raw_cases(_marked(spark, sf), FX.link_index(spark, sf))
    return cases.withColumns({c: F.md5(c) for c in ("question", "opb", "explanation")})


# ------------------------------------------- sources, report sections, facade ----

from ..sources import readers as SR  # noqa: E402


@register("load_parquet", "SELECT doc_id, lang, source, n_chars FROM documents")
def q_load_parquet(spark, sf):
    """Declared-schema read; only the projected columns reach the scan."""
    from pyspark.sql import types as T2
    schema = T2.StructType([T2.StructField("doc_id", T2.LongType()), T2.StructField("lang", T2.StringType()),
                            T2.StructField("source", T2.StringType()), T2.StructField("n_chars", T2.LongType())])
    return SR.load(spark, f"{sf}/documents.parquet", schema=schema)


from ..sources import writers as SW  # noqa: E402
from ..session import scratch_path  # noqa: E402

_CSV_COLS = ["case_id", "case_text", "question", "option_d", "answer_idx", "explanation", "specialty"]
_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in _CSV_COLS])


@register("load_csv", W(CASES, f"SELECT {', '.join(_CSV_COLS)} FROM cases"))
def q_load_csv(spark, sf):
    """Cases (whole, multi-line texts) written as CSV and read back through the ``load`` dispatch."""
    path = scratch_path(spark, "cases") + ".csv"
    SW.write_raw_csv(FX.cases(spark, sf).select(*_CSV_COLS), path)
    return SR.load(spark, path, schema=_CSV_SCHEMA)


@register("read_link_index", """
SELECT page_id AS id, url AS link, CAST(NULL AS VARCHAR) AS publication_year, substr('ABCD', CAST(page_id % 4 + 1 AS INTEGER), 1) AS answer_idx,
       'answer ' || CAST(page_id AS VARCHAR) AS answer
FROM pages""")
def q_link_index(spark, sf):
    """The link index over all pages, written as JSON arrays and read back in byte ranges."""
    path = scratch_path(spark, "links")
    SW.write_json_array(FX.link_index(spark, sf), path)
    return SR.read_link_index(spark, path)


@register("load_csv_inferred", W(CASES, f"SELECT {', '.join(_CSV_COLS)} FROM cases"))
def q_load_csv_inferred(spark, sf):
    """S2/S3 without a schema: names from the header, types from the values."""
    path = scratch_path(spark, "cases") + ".csv"
    SW.write_raw_csv(FX.cases(spark, sf).select(*_CSV_COLS), path)
    return SR.load(spark, path)


@register("raw_json", W(CASES, f"SELECT {', '.join(_CSV_COLS)} FROM cases"))
def q_raw_json(spark, sf):
    """Cases written as JSON lines and read back with their schema."""
    path = scratch_path(spark, "cases") + ".json"
    SW.write_raw_json(FX.cases(spark, sf).select(*_CSV_COLS), path)
    return spark.read.schema(_CSV_SCHEMA).json(path)


@register("load_snapshot", "SELECT conv_id, turn, role, text FROM conversations")
def q_load_snapshot(spark, sf):
    """The conversations staged as a dataset snapshot and loaded by dataset, config and split."""
    root = scratch_path(spark, "snapshots")
    SW.write_variants(FX.table(spark, sf, "conversations"), f"{root}/org__talks/default/train")
    return SR.load(spark, "org/talks", "default", "train", snapshot_root=root).select("conv_id", "turn", "role", "text")


@register("write_variants", W(VARIANTS, f"SELECT {_VCOLS} FROM variants"))
def q_write_variants(spark, sf):
    """The variant table written partitioned by ethnicity and read back as parquet."""
    path = scratch_path(spark, "variants")
    SW.write_variants(FX.variants(spark, sf, fallback_prepend=True), path, partition_by="ethnicity")
    return SR.load_parquet(spark, path).select(*_VCOLS.split(", "))


@register("results_json", W(CUBE, """
SELECT llm, ethnicity, gender, round(sum(n_correct) / sum(n), 9) AS accuracy, CAST(sum(n) AS BIGINT) AS n
FROM cube WHERE ethnicity IS NOT NULL GROUP BY llm, ethnicity, gender"""))
def q_results_json(spark, sf):
    """An evaluation table written as JSON (NaN -> null) and read back with its schema."""
    df = r9(A.accuracy_by_group(_cube(spark, sf)))
    path = scratch_path(spark, "results")
    SW.write_results({"accuracy_by_group": df}, path)
    return spark.read.schema(df.schema).json(f"{path}/accuracy_by_group")


@register("schema_table", W(VARIANTS, "SELECT column_name, dtype, n_null FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{_DTYPES.get(c, 'string')}' AS dtype, "
    f"CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM variants" for c in _NULL_COLS) + ")"))
def q_schema_table(spark, sf):
    """R2: column, Spark type and null count of the variant table (one aggregate pass)."""
    return R.schema_table(FX.variants(spark, sf).select(*_NULL_COLS))


@register("report_answer_distribution", W(VARIANTS, "SELECT answer_idx, CAST(count(*) AS BIGINT) AS n FROM variants WHERE answer_idx IS NOT NULL GROUP BY 1"))
def q_report_answers(spark, sf):
    """R5 (same numbers as V14)."""
    return V.answer_distribution(FX.variants(spark, sf))


@register("bias_sections", W(_DIRECTION_SQL, """
SELECT 'by_gender' AS section, gender AS key1, CAST(NULL AS VARCHAR) AS key2, round(avg(gender_bias_score), 9) AS mean,
       round(stddev_samp(gender_bias_score), 9) AS std FROM labeled WHERE gender_bias_score IS NOT NULL GROUP BY gender
UNION ALL
SELECT 'by_ethnicity', ethnicity, NULL, round(avg(gender_bias_score), 9), round(stddev_samp(gender_bias_score), 9)
FROM labeled WHERE gender_bias_score IS NOT NULL AND ethnicity IS NOT NULL GROUP BY ethnicity
UNION ALL
SELECT 'crosstab', gender, ethnicity, round(avg(gender_bias_score), 9), NULL
FROM labeled WHERE gender_bias_score IS NOT NULL AND ethnicity IS NOT NULL GROUP BY gender, ethnicity
UNION ALL
SELECT 'median', NULL, NULL, round(median(gender_bias_score), 9), NULL FROM scores"""))
def q_bias_sections(spark, sf):
    """E6-E9 as one long table."""
    return r9(R.bias_sections(_scored_rows(spark, sf)))


@register("report_table", W(VARIANTS, f"""
per AS (SELECT case_id, max(gender_none) AS neutral FROM variants GROUP BY 1)""", f"""
SELECT 'overview' AS section, 'n_cases' AS key1, CAST(NULL AS VARCHAR) AS key2, CAST(count(DISTINCT case_id) AS DOUBLE) AS value FROM variants
UNION ALL SELECT 'overview', 'n_rows', NULL, CAST(count(*) AS DOUBLE) FROM variants
UNION ALL SELECT 'overview', 'n_dropped', NULL,
  CAST((SELECT count_if(coalesce({Q.ethnicity_mention_sql('case_text')}, false)) FROM cases) AS DOUBLE)
UNION ALL SELECT 'null_count', column_name, NULL, CAST(n_null AS DOUBLE) FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM variants" for c in _NULL_COLS) + f""")
UNION ALL SELECT 'original_gender', 'gender keyword present', NULL, CAST(count_if(coalesce(neutral, 0) = 0) AS DOUBLE) FROM per
UNION ALL SELECT 'original_gender', 'no gender keyword', NULL, CAST(count_if(neutral = 1) AS DOUBLE) FROM per
UNION ALL SELECT 'gender', {GENDER_SQL}, NULL, CAST(count(*) AS DOUBLE) FROM variants GROUP BY 2
UNION ALL SELECT 'ethnicity', ethnicity, NULL, CAST(count(*) AS DOUBLE) FROM variants WHERE ethnicity IS NOT NULL GROUP BY 2
UNION ALL SELECT 'crosstab', {GENDER_SQL}, ethnicity, CAST(count(*) AS DOUBLE) FROM variants WHERE ethnicity IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'answer', answer_idx, NULL, CAST(count(*) AS DOUBLE) FROM variants WHERE answer_idx IS NOT NULL GROUP BY 2"""))
def q_report_table(spark, sf):
    """The report sections as one long table."""
    c = FX.cases(spark, sf)
    return R.report_table(TV.build_variants(c, fallback_prepend=True), TV.count_ethnicity_mentions(c))


@register("evaluate_summary", W(CUBE + CELLS_TAIL + VS_TAIL + SKEW_TAIL, """
g AS (SELECT llm, ethnicity, gender, sum(n_correct) / sum(n) AS acc FROM cube
      WHERE ethnicity IS NOT NULL GROUP BY llm, ethnicity, gender),
d AS (SELECT llm, max(acc) - min(acc) AS max_gap, stddev_pop(acc) AS std FROM g GROUP BY llm),
a AS (SELECT llm, sum(n_correct) / sum(n) AS accuracy FROM cube GROUP BY llm)""", """
SELECT a.llm, round(a.accuracy, 9) AS accuracy, round(d.max_gap, 9) AS max_gap, round(d.std, 9) AS std,
       round(s.skewsize, 9) AS skewsize, s.n_cases
FROM a JOIN d USING (llm) LEFT JOIN skew s USING (llm)"""))
def q_evaluate(spark, sf):
    """The scalar part of an evaluation bundle, one row per model, from one cube."""
    from .evaluate import evaluate
    return r9(evaluate(FX.predictions(spark, sf), llm_col=LLM_COLS).summary())


# One table of the bundle's gender-bias metrics, from sentence pairs to scores.
@register("evaluate_gender_bias", WR(_PCA_SQL, """
SELECT 'by_gender' AS metric, gender AS key1, CAST(NULL AS VARCHAR) AS key2, round(avg(gender_bias_score), 9) AS mean,
       round(stddev_samp(gender_bias_score), 9) AS std FROM labeled WHERE gender_bias_score IS NOT NULL GROUP BY gender
UNION ALL
SELECT 'crosstab', gender, ethnicity, round(avg(gender_bias_score), 9), NULL
FROM labeled WHERE gender_bias_score IS NOT NULL AND ethnicity IS NOT NULL GROUP BY gender, ethnicity
UNION ALL
SELECT 'median', NULL, NULL, round(median(gender_bias_score), 9), NULL FROM scores"""))
def q_evaluate_bias(spark, sf):
    """A7 with E4: the facade learns the direction from pairs and scores the rows, all in one plan a table."""
    from .evaluate import evaluate
    rows = FX.scored_cases(spark, sf).select("*", F.lit("A").alias("answer_idx"), F.lit("A").alias("llm_m_answer"))
    res = evaluate(rows, llm_col="llm_m_answer", case_embedding_col="embedding", gender_pairs=FX.sentence_pairs(spark, sf))
    none = F.lit(None).cast("string")
    b = res.gender_bias
    return r9(b["by_gender"].select(F.lit("by_gender").alias("metric"), F.col("gender").alias("key1"), none.alias("key2"), "mean", "std")
              .unionAll(b["crosstab"].select(F.lit("crosstab"), "gender", "ethnicity", "mean", F.lit(None).cast("double")))
              .unionAll(b["median"].select(F.lit("median"), none, none, "mb", F.lit(None).cast("double"))))


_EMBED_SQL = FX.RESPONSES_SQL + f""",
tok AS (SELECT response, md5(t) AS h FROM (
          SELECT response, unnest({Q.tokens_sql('response')}) AS t FROM (SELECT DISTINCT response FROM responses WHERE response IS NOT NULL))),
hashed AS (SELECT response, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS dim, sum(CASE WHEN substr(h, 9, 1) < '8' THEN -1.0 ELSE 1.0 END) AS x
           FROM tok GROUP BY 1, 2),
vectors AS (SELECT response, sqrt(sum(x * x)) AS norm FROM hashed GROUP BY 1),
rows_ AS (SELECT row_number() OVER () AS r, case_id, response FROM responses WHERE response IS NOT NULL),
unit AS (SELECT case_id, r, dim, CASE WHEN norm = 0 THEN 0.0 ELSE x / norm END AS u FROM rows_ JOIN hashed USING (response) JOIN vectors USING (response)),
sums AS (SELECT case_id, dim, sum(u) AS s FROM unit GROUP BY 1, 2),
total AS (SELECT case_id, sum(s * s) AS sq FROM sums GROUP BY 1),
own AS (SELECT case_id, sum(u * u) AS sq FROM unit GROUP BY 1),
k AS (SELECT case_id, count(*) AS k FROM rows_ GROUP BY 1)"""


@register("embed_dedup", W(_EMBED_SQL, """
SELECT k.case_id, round(CASE WHEN k >= 2 THEN (coalesce(total.sq, 0) - coalesce(own.sq, 0)) / (k * (k - 1)) END, 9) AS cossim
FROM k LEFT JOIN total USING (case_id) LEFT JOIN own USING (case_id)"""))
def q_embed_dedup(spark, sf):
    """Every distinct response text embedded once (feature-hashing embedder as a stand-in model)."""
    from ..operators.embedding import embed_distinct
    from ..functions.hashing import hashing_embedder
    resp = FX.responses(spark, sf)
    out = embed_distinct(resp, "response", hashing_embedder(64))
    return r9(E.cossim_across_variants(out.where(F.col("embedding").isNotNull())))


# Regex-expressible page fields get an oracle (the test pages use plain tags).
_UNESCAPE = ("replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
             "'&#39;', ''''), '&amp;', '&')")

ORACLE["extract_listing"] = """
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, """ + _UNESCAPE.format(x="links[pos]") + """ AS link,
       CAST(NULL AS VARCHAR) AS date_text
FROM (SELECT page_id, links, unnest(generate_series(1, len(links))) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS links FROM pages)
      WHERE len(links) > 0)"""

ORACLE["article_type"] = """
SELECT page_id, """ + _UNESCAPE.format(x="regexp_extract(html, '<h1>(.*?)</h1>', 1)") + """ AS article_type,
       CAST(NULL AS VARCHAR) AS super_class
FROM pages"""

# H2 over the test pages: their listings carry no dates, so with undated links
# kept every non-null link passes and the year is NULL (date parsing itself is
# covered by pytest on a page that has dates).
ORACLE["filter_year_cutoff"] = """
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, """ + _UNESCAPE.format(x="links[pos]") + """ AS link,
       CAST(NULL AS VARCHAR) AS date_text, CAST(NULL AS VARCHAR) AS publication_year
FROM (SELECT page_id, links, unnest(generate_series(1, len(links))) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS links FROM pages)
      WHERE len(links) > 0)"""


# H3-H8 on the raw pages.  The oracle reads tags and texts as positions of one regular expression; an element ends where
# the running depth of its tag falls back (an unclosed one with the article around it).
def _clean_text_sql(x: str) -> str:
    return _UNESCAPE.format(x=x)


_RAW_PAGES = r"""
tokens AS (
  SELECT page_id, url, i, tok FROM (
    SELECT page_id, url, toks, unnest(generate_series(1, len(toks))) AS i, unnest(toks) AS tok FROM (
      SELECT page_id, url, regexp_extract_all(regexp_replace(html,
               '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'), '<[^>]*>|[^<]+') AS toks
      FROM pages))),
depths AS (
  SELECT *, sum(CASE WHEN regexp_matches(tok, '^<p[ />]') THEN 1 WHEN tok = '</p>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth
  FROM tokens),
article AS (SELECT page_id, min(i) FILTER (tok LIKE '<article%') AS a0, min(i) FILTER (tok = '</article>') AS a1 FROM tokens GROUP BY 1),
opened AS (
  SELECT o.page_id, o.i, coalesce((SELECT min(c.i) FROM depths c WHERE c.page_id = o.page_id AND c.i > o.i AND c.tok = '</p>' AND c.depth = o.depth - 1),
                                  a.a1) AS j, o.i > a.a0 AND o.i < a.a1 AS inside
  FROM depths o JOIN article a USING (page_id) WHERE regexp_matches(o.tok, '^<p[ />]')),
paras AS (
  SELECT o.page_id, o.i, any_value(o.inside) AS inside, """ + _clean_text_sql("coalesce(string_agg(t.tok, '' ORDER BY t.i), '')") + r""" AS text
  FROM opened o LEFT JOIN tokens t ON t.page_id = o.page_id AND t.i > o.i AND t.i < o.j AND t.tok NOT LIKE '<%' GROUP BY o.page_id, o.i),
titles AS (SELECT page_id, url, """ + _clean_text_sql("regexp_extract(html, '<h1>(.*?)</h1>', 1)") + r""" AS title FROM pages),
texts AS (SELECT page_id, list(text ORDER BY i) FILTER (inside) AS ps, list(trim(text, E' \t\n\r') ORDER BY i) AS keys FROM paras GROUP BY 1),
raw AS (SELECT page_id, url, title, coalesce(ps, []) AS ps, coalesce(keys, []) AS keys, list_filter(coalesce(ps, []),
               lambda x: len(x) - len(replace(x, ' ', '')) + 1 >= 8) AS long FROM titles LEFT JOIN texts USING (page_id))"""

_RAW_IMAGE = """CASE WHEN regexp_matches(html, '<div class="figure-table-image"[^>]*>(<[^>]*>|[^<])*<img') THEN 'Yes' ELSE 'No' END"""

ORACLE["has_image"] = f"SELECT page_id, {_RAW_IMAGE} AS has_image FROM pages"

ORACLE["extract_answer_key"] = W(_RAW_PAGES, """
SELECT page_id, url, left(k, 1) AS answer_idx, substr(k, 4) AS answer
FROM (SELECT page_id, url, list_filter(keys, lambda x: regexp_matches(x, '^[A-D]\\.'))[1] AS k FROM raw)""")

ORACLE["assemble_raw_cases"] = W(_RAW_PAGES, f"""
SELECT r.url AS link, CAST(NULL AS VARCHAR) AS publication_year, substr('ABCD', CAST(l.page_id % 4 + 1 AS INTEGER), 1) AS answer_idx,
       'answer ' || CAST(l.page_id AS VARCHAR) AS answer, ' ' || title AS question, ps[1] AS opa, ps[2] AS opb, ps[3] AS opc, ps[4] AS opd,
       '' AS diagnosis, '' AS explanation, title AS field, {_RAW_IMAGE} AS has_image
FROM pages l JOIN raw r ON r.url = l.url JOIN pages h ON h.page_id = r.page_id""".replace("matches(html", "matches(h.html"))


def _listed(df, *cols):
    return df.select("page_id", *[F.md5(F.array_join(c, "|")).alias(f"{c}_md5") for c in cols])


@register("extract_sections_raw", W(_RAW_PAGES, """
SELECT page_id, md5(array_to_string(long, '|')) AS paragraphs_md5, md5('') AS case_paras_md5, md5('') AS discussion_paras_md5 FROM raw"""))
def q_sections_raw(spark, sf):
    """H4 on the raw pages, lists as digests (the pages hold no section marks)."""
    return _listed(_pages(spark, sf), "paragraphs", "case_paras", "discussion_paras")


@register("extract_mcq_raw", W(_RAW_PAGES, "SELECT page_id, title AS mcq_title, md5(array_to_string(ps, '|')) AS mcq_answers_md5 FROM raw"))
def q_mcq_raw(spark, sf):
    """H7 on the raw pages, the answers as a digest."""
    return _pages(spark, sf).select("page_id", "mcq_title", F.md5(F.array_join("mcq_answers", "|")).alias("mcq_answers_md5"))
