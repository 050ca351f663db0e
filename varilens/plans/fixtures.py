"""Adapters that derive variant-model inputs from the driver's test tables.

Each adapter exists twice: as a DataFrame builder (what the queries run)
and as SQL text (what the DuckDB oracle runs).  Both read whole tables and
whole texts; the arithmetic on ids only decides which text branch a row
exercises, it never drops rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import variants as V
from ..session import INPUT_PARTITIONS
from ..sources.readers import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table.  Each is one row group; a local session (tests, bench) asks for the rows to be spread."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    partitions = spark.conf.get(INPUT_PARTITIONS, None)
    return spread(df, int(partitions)) if partitions else df


# ---------------------------------------------------------------- cases ----

def _opening(doc_id):
    age = (F.lit(18) + doc_id % 70).cast("string")
    k = doc_id % 6
    return (F.when(k == 0, F.concat(F.lit("A "), age, F.lit("-year-old patient presents. ")))
            .when(k == 1, F.lit("An 80-year-old man presents. "))
            .when(k == 2, F.concat(F.lit("a "), age, F.lit("-year-old woman presents. ")))
            .when(k == 3, F.lit("No opening. "))
            .when(k == 4, F.lit("The Hispanic patient presents. "))
            .otherwise(F.lit("A 30-year-old Patient. Later a 31-year-old patient returned. ")))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case table from ``documents`` (one case per document, whole text)."""
    d = table(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    return d.select(
        doc_id.alias("case_key"),
        F.format_string("doc_%06d", doc_id).alias("case_id"),
        F.concat(_opening(doc_id), F.col("text")).alias("case_text"),
        F.concat(F.lit("Question "), doc_id.cast("string")).alias("question"),
        F.lit("opt a").alias("option_a"), F.lit("opt b").alias("option_b"),
        F.lit("opt c").alias("option_c"),
        F.when(doc_id % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit("opt d")).alias("option_d"),
        F.substring(F.lit("ABCD"), (F.floor(doc_id / 6.0) % 4 + 1).cast("int"), 1).alias("answer_idx"),
        F.col("text").alias("explanation"),
        F.col("source").alias("specialty"),
    )


CASES_SQL = """
cases AS (
  SELECT doc_id AS case_key,
         printf('doc_%06d', doc_id) AS case_id,
         CASE doc_id % 6
           WHEN 0 THEN 'A ' || CAST(18 + doc_id % 70 AS VARCHAR) || '-year-old patient presents. '
           WHEN 1 THEN 'An 80-year-old man presents. '
           WHEN 2 THEN 'a ' || CAST(18 + doc_id % 70 AS VARCHAR) || '-year-old woman presents. '
           WHEN 3 THEN 'No opening. '
           WHEN 4 THEN 'The Hispanic patient presents. '
           ELSE 'A 30-year-old Patient. Later a 31-year-old patient returned. '
         END || text AS case_text,
         'Question ' || CAST(doc_id AS VARCHAR) AS question,
         'opt a' AS option_a, 'opt b' AS option_b, 'opt c' AS option_c,
         CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'opt d' END AS option_d,
         substr('ABCD', CAST(floor(doc_id / 6.0) AS INT) % 4 + 1, 1) AS answer_idx,
         text AS explanation,
         source AS specialty
  FROM documents
)"""


def variants(spark: SparkSession, sf_dir: str, *, fallback_prepend: bool = True) -> DataFrame:
    """Filtered + expanded variants of ``cases``."""
    return V.build_variants(cases(spark, sf_dir), fallback_prepend=fallback_prepend)


# ------------------------------------------------------------ predictions ----

def _answer(case_key, variant_idx, mult_k: int, mult_v: int, cut: int, null_mod: int):
    shift = F.when((case_key * mult_k + variant_idx * mult_v) % 10 < cut, 0).otherwise(1)
    letter = F.substring(F.lit("ABCD"), ((F.floor(case_key / 6.0).cast("int") + shift) % 4 + 1).cast("int"), 1)
    return F.when((case_key + variant_idx) % null_mod == 0, F.lit(None).cast("string")).otherwise(letter)


# (name, mult_k, mult_v, cut, null_mod): two synthetic models with different error profiles.
MODELS = [("m1", 7, 3, 7, 97), ("m2", 3, 5, 6, 89)]


def predictions(spark: SparkSession, sf_dir: str, *, fallback_prepend: bool = True) -> DataFrame:
    """Variants plus ``llm_<model>_answer`` for the synthetic models."""
    v = variants(spark, sf_dir, fallback_prepend=fallback_prepend)
    return v.withColumns({f"llm_{m}_answer": _answer(F.col("case_key"), F.col("variant_idx"), a, b, c, n)
                          for m, a, b, c, n in MODELS})


def _variant_values_sql(ethnicities=None) -> str:
    rows = []
    for i, g, e, d in V.variant_spec(ethnicities):
        rows.append(f"({i}, '{g}', '{e}', {('NULL' if d is None else repr(d))})")
    return ",\n    ".join(rows)


def variants_sql(fallback_prepend: bool = True, ethnicities=None) -> str:
    """CTE chain cases -> kept -> variants (DuckDB dialect, Unicode-aware word boundaries)."""
    from ..functions.sqltext import ethnicity_mention_sql, gender_sql, age_template_sql, AGE_SQL
    n2 = 2 * len(ethnicities or S.ETHNICITIES)
    label = "CASE WHEN v.descriptor IS NULL THEN v.ethnicity ELSE v.ethnicity || ' ' || v.descriptor END"
    no_age = ("'Patient: ' || " + label + " || '.\n' || k.case_text") if fallback_prepend else "k.case_text"
    return CASES_SQL + f""",
kept AS (
  SELECT *, {gender_sql('case_text')} AS _gender,
         coalesce(regexp_matches(case_text, '{AGE_SQL}'), false) AS _age,
         {age_template_sql('case_text')} AS _tpl
  FROM cases WHERE NOT coalesce({ethnicity_mention_sql('case_text')}, false)
),
spec(variant_idx, gender, ethnicity, descriptor) AS (VALUES
    {_variant_values_sql(ethnicities)}
),
variants AS (
  SELECT k.case_key, k.case_id,
         CASE WHEN k._age THEN replace(k._tpl, chr(57344) || chr(57345), {label}) ELSE {no_age} END AS case_text,
         k.question, k.option_a, k.option_b, k.option_c, k.option_d, k.answer_idx,
         k.explanation, k.specialty,
         CAST(v.gender = 'male' AS INTEGER) AS gender_male,
         CAST(v.gender = 'female' AS INTEGER) AS gender_female,
         CAST(v.gender = 'none' AS INTEGER) AS gender_none,
         v.ethnicity, v.variant_idx
  FROM kept k JOIN spec v ON v.variant_idx < {n2} OR k._gender IS NULL
)"""


def _answer_sql(mult_k, mult_v, cut, null_mod) -> str:
    return (f"CASE WHEN (case_key + variant_idx) % {null_mod} = 0 THEN NULL "
            f"ELSE substr('ABCD', (CAST(floor(case_key / 6.0) AS INT) + CASE WHEN "
            f"(case_key * {mult_k} + variant_idx * {mult_v}) % 10 < {cut} THEN 0 ELSE 1 END) % 4 + 1, 1) END")


def predictions_sql(fallback_prepend: bool = True) -> str:
    cols = ",\n         ".join(f"{_answer_sql(a, b, c, n)} AS llm_{m}_answer" for m, a, b, c, n in MODELS)
    return variants_sql(fallback_prepend) + f""",
predictions AS (
  SELECT *,
         {cols}
  FROM variants
)"""


# -------------------------------------------------------------- responses ----

def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-case responses for the pairwise metrics: assistant turns of ``conversations``."""
    c = table(spark, sf_dir, "conversations")
    return (c.where(F.col("role") == "assistant")
             .select(F.format_string("conv_%06d", F.col("conv_id")).alias("case_id"),
                     F.col("turn").cast("int").alias("variant_idx"),
                     F.col("text").alias("response")))


RESPONSES_SQL = """
responses AS (
  SELECT printf('conv_%06d', conv_id) AS case_id, CAST(turn AS INTEGER) AS variant_idx, text AS response
  FROM conversations WHERE role = 'assistant'
)"""


#: Responses of a case in the load table: the variants of one case with a gendered text.
LOAD_RESPONSES = 12


def load_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load table for the pairwise metrics: twelve whole documents are the responses of one case."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.format_string("load_%06d", F.floor(F.col("doc_id") / LOAD_RESPONSES)).alias("case_id"),
                    (F.col("doc_id") % LOAD_RESPONSES).cast("int").alias("variant_idx"), F.col("text").alias("response"))


LOAD_RESPONSES_SQL = f"""
responses AS (
  SELECT printf('load_%06d', doc_id // {LOAD_RESPONSES}) AS case_id, CAST(doc_id % {LOAD_RESPONSES} AS INTEGER) AS variant_idx,
         text AS response
  FROM documents
)"""


def copied_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with many copies: all documents of a source and language answer with one of their first words."""
    d = table(spark, sf_dir, "documents")
    first = F.array_join(F.slice(F.split("text", " "), F.lit(1), (1 + F.col("doc_id") % 5).cast("int")), " ")
    return d.select(F.concat_ws("/", "source", "lang").alias("case_id"), F.col("doc_id").cast("int").alias("variant_idx"),
                    F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("the answer is "), F.substring(F.lit("ABCD"), (F.col("doc_id") % 4 + 1).cast("int"), 1)))
                    .when(F.col("doc_id") % 3 == 1, F.lit("no answer is given here at all")).otherwise(first).alias("response"))


COPIED_RESPONSES_SQL = """
responses AS (
  SELECT source || '/' || lang AS case_id, CAST(doc_id AS INTEGER) AS variant_idx,
         CASE doc_id % 3 WHEN 0 THEN 'the answer is ' || substr('ABCD', doc_id % 4 + 1, 1) WHEN 1 THEN 'no answer is given here at all'
              ELSE array_to_string(list_slice(string_split(text, ' '), 1, 1 + doc_id % 5), ' ') END AS response
  FROM documents
)"""


def embedded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response embeddings grouped into cases by ``label``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.format_string("case_%03d", F.col("label")).alias("case_id"),
                    F.col("vec_id"), F.col("embedding"))


EMBEDDED_RESPONSES_SQL = """
embedded AS (
  SELECT printf('case_%03d', label) AS case_id, vec_id, CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings
)"""


def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, female, male) embeddings: even vec_id = female, vec_id + 1 = male."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    f = e.where(F.col("vec_id") % 2 == 0).select((F.col("vec_id") / 2).cast("long").alias("pair_id"),
                                                  F.col("embedding").alias("female"))
    m = e.where(F.col("vec_id") % 2 == 1).select(((F.col("vec_id") - 1) / 2).cast("long").alias("pair_id"),
                                                  F.col("embedding").alias("male"))
    return f.join(m, "pair_id")


def scored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows tagged with a gender one-hot and an ethnicity (case-embedding fixture)."""
    e = table(spark, sf_dir, "embeddings")
    g = F.col("vec_id") % 3
    eth = F.element_at(F.array(*[F.lit(x) for x in S.ETHNICITIES]), (F.col("vec_id") % 5 + 1).cast("int"))
    return e.select(F.format_string("case_%03d", F.col("label")).alias("case_id"), "vec_id", "embedding",
                    (g == 0).cast("int").alias("gender_male"), (g == 1).cast("int").alias("gender_female"),
                    (g == 2).cast("int").alias("gender_none"), eth.alias("ethnicity"))


SCORED_CASES_SQL = """
scored_cases AS (
  SELECT printf('case_%03d', label) AS case_id, vec_id, CAST(embedding AS DOUBLE[]) AS embedding,
         CAST(vec_id % 3 = 0 AS INTEGER) AS gender_male,
         CAST(vec_id % 3 = 1 AS INTEGER) AS gender_female,
         CAST(vec_id % 3 = 2 AS INTEGER) AS gender_none,
         ['White', 'Black', 'Asian', 'Hispanic', 'Arab'][vec_id % 5 + 1] AS ethnicity
  FROM embeddings
)"""


# --------------------------------------------------------- prompt outputs ----

# Prompt conditions compared in the prompt-comparison fixture (answers shift by 3 per prompt).
PROMPT_IDS = ["p0", "p1", "p2"]


def prompt_outputs(spark: SparkSession, sf_dir: str, prompts=None) -> DataFrame:
    """Variants with one answer and one explanation per prompt condition."""
    v = variants(spark, sf_dir, fallback_prepend=True)
    m, a, b, c, n = MODELS[0]
    cols = {}
    g = (F.when(F.col("gender_male") == 1, "male").when(F.col("gender_female") == 1, "female")
         .when(F.col("gender_none") == 1, "none").otherwise("unknown"))
    for k, p in enumerate(prompts or PROMPT_IDS):
        ans = _answer(F.col("case_key"), F.col("variant_idx") + 3 * k, a, b, c, n)
        cols[f"answer_{p}"] = ans
        cols[f"explanation_{p}"] = F.concat_ws(" ", F.lit("The answer is"), ans, F.lit("for this"),
                                               F.col("ethnicity"), g, F.lit("patient."))
    return v.withColumns(cols)


def prompt_outputs_sql(prompts=None) -> str:
    m, a, b, c, n = MODELS[0]
    g = ("CASE WHEN gender_male = 1 THEN 'male' WHEN gender_female = 1 THEN 'female' "
         "WHEN gender_none = 1 THEN 'none' ELSE 'unknown' END")
    cols = []
    for k, p in enumerate(prompts or PROMPT_IDS):
        ans = _answer_sql(a, b, c, n).replace("variant_idx", f"(variant_idx + {3 * k})")
        cols.append(f"{ans} AS answer_{p}")
        cols.append(f"concat_ws(' ', 'The answer is', {ans}, 'for this', ethnicity, {g}, 'patient.') AS explanation_{p}")
    return variants_sql(True) + """,
prompt_outputs AS (
  SELECT *, """ + ",\n         ".join(cols) + """
  FROM variants
)"""


# ------------------------------------------------- pages with marks and dates ----

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
DATE_CLASS, FIGURE_CLASS, CLASS_CLASS = "article--date meta-item no-wrap", "figure-table-image", "meta-super-class"


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article pages that carry each page's whole text between section marks, with a dated link and a figure."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    text = F.concat(F.lit("Text "), F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[&<>]", " "))
    ks = k.cast("string")
    date = F.concat(F.element_at(F.array(*[F.lit(m) for m in MONTHS]), (k % 12 + 1).cast("int")), F.lit(" "),
                    (k % 28 + 1).cast("string"), F.lit(", "), (k % 12 + 2008).cast("string"))

    def para(*parts):
        return F.concat(F.lit("<p>"), *[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("</p>"))

    html = F.concat(
        F.lit("<article>"), F.when(k % 5 < 3, F.concat(F.lit(f"<div class='{CLASS_CLASS}'>Class "), (k % 5).cast("string"), F.lit("</div>")))
        .otherwise(F.lit("")), F.lit("<h1>Title "), ks, F.lit("</h1><li><a href='/a/"), ks, F.lit(f"'>x</a><div class='{DATE_CLASS}'>"), date,
        F.lit("</div></li>"), F.when(k % 4 == 0, F.lit(f"<div class='{FIGURE_CLASS}'><img src='f'></div>"))
        .when(k % 4 == 1, F.lit(f"<div class='{FIGURE_CLASS}'>none</div>")).otherwise(F.lit("")),
        para("Case"), para(text), para("Diagnosis"), para("Dx ", ks),
        F.when(k % 2 == 0, F.concat(para("What to Do Next"), para("Option ", ks))).otherwise(F.lit("")),
        para("Discussion"), para("Because ", text), F.when(k % 3 != 0, para("A. first choice")).otherwise(para("No key")),
        para("B. second"), F.lit("</article>"))
    return p.select("page_id", "url", html.alias("html"))


MARKED_SQL = """
marked AS (
  SELECT page_id AS k, url, 'Text ' || regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[&<>]', ' ', 'g') AS t
  FROM pages),
parts AS (
  SELECT k, url, t, 'Because ' || t AS t2, CAST(k AS VARCHAR) AS ks,
         length(t) - length(replace(t, ' ', '')) + 1 >= 8 AS long1, length(t) - length(replace(t, ' ', '')) + 2 >= 8 AS long2
  FROM marked)"""


# -------------------------------------------------------------- link index ----

def link_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link index over ``pages``: id, link (= url), publication_year, answer key."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    return p.select(k.alias("id"), F.col("url").alias("link"), F.lit(None).cast("string").alias("publication_year"),
                    F.substring(F.lit("ABCD"), (k % 4 + 1).cast("int"), 1).alias("answer_idx"),
                    F.concat(F.lit("answer "), k.cast("string")).alias("answer"))


# ---------------------------------------------------------- dirty variants ----

_DIRTY_ETHNICITIES = S.ETHNICITIES + ["Martian", "white"]


def dirty_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant-shaped rows over ``documents`` carrying every kind of schema violation (V1-V6)."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    null_s = F.lit(None).cast("string")
    gm = F.when(k % 13 == 0, 2).when((k % 4 == 0) | (k % 4 == 3), 1).otherwise(0)
    gf = F.when(k % 17 == 0, F.lit(None)).when((k % 4 == 1) | (k % 4 == 3), 1).otherwise(0)
    gn = F.when(k % 4 == 2, 1).otherwise(0)
    ans = F.when(k % 29 == 0, null_s).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in ["A", "B", "C", "D", "E", ""]]), (k % 6 + 1).cast("int")))
    eth = F.when(k % 19 == 0, null_s).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in _DIRTY_ETHNICITIES]), (k % 7 + 1).cast("int")))
    return d.select(
        F.format_string("doc_%06d", k).alias("case_id"), F.col("text").alias("case_text"),
        F.concat(F.lit("Question "), k.cast("string")).alias("question"),
        F.when(k % 23 == 0, null_s).otherwise(F.lit("opt a")).alias("option_a"),
        F.lit("opt b").alias("option_b"), F.lit("opt c").alias("option_c"),
        F.when(k % 5 == 0, null_s).otherwise(F.lit("opt d")).alias("option_d"),
        ans.alias("answer_idx"), gm.cast("int").alias("gender_male"), gf.cast("int").alias("gender_female"),
        gn.cast("int").alias("gender_none"), eth.alias("ethnicity"))


DIRTY_SQL = """
dirty AS (
  SELECT printf('doc_%06d', doc_id) AS case_id, text AS case_text, 'Question ' || CAST(doc_id AS VARCHAR) AS question,
         CASE WHEN doc_id % 23 = 0 THEN NULL ELSE 'opt a' END AS option_a,
         'opt b' AS option_b, 'opt c' AS option_c,
         CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'opt d' END AS option_d,
         CASE WHEN doc_id % 29 = 0 THEN NULL ELSE ['A', 'B', 'C', 'D', 'E', ''][doc_id % 6 + 1] END AS answer_idx,
         CAST(CASE WHEN doc_id % 13 = 0 THEN 2 WHEN doc_id % 4 IN (0, 3) THEN 1 ELSE 0 END AS INTEGER) AS gender_male,
         CAST(CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 4 IN (1, 3) THEN 1 ELSE 0 END AS INTEGER) AS gender_female,
         CAST(CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END AS INTEGER) AS gender_none,
         CASE WHEN doc_id % 19 = 0 THEN NULL
              ELSE ['White', 'Black', 'Asian', 'Hispanic', 'Arab', 'Martian', 'white'][doc_id % 7 + 1] END AS ethnicity
  FROM documents
)"""
