"""M1-M7: map source QA layouts to the case schema and derive label columns.

All mappings are projections (narrow, no shuffle).  Case ids come from a
stable source key column, never from ``monotonically_increasing_id`` or a
global ``row_number`` (which would funnel the table through one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import text as X

_CASE_COLS = ["case_id", "case_text", "question", "option_a", "option_b", "option_c",
              "option_d", "answer_idx"]


def map_options_dict(df: DataFrame, *, index_col: str, prefix: str = "medqa",
                     width: int = 5, question_col: str = "question", options_col: str = "options",
                     answer_idx_col: str = "answer_idx", answer_col: str | None = "answer") -> DataFrame:
    """M1: ``options`` map/struct with keys A-D (missing key -> "") -> option_a..option_d."""
    opt = F.col(options_col)
    dt = df.schema[options_col].dataType
    if isinstance(dt, T.MapType):
        # Only a missing key defaults to ""; a key present with a NULL value stays NULL.
        pick = lambda k: F.when(F.map_contains_key(opt, k), opt.getItem(k)).otherwise(F.lit(""))
    else:
        names = {f.name for f in dt.fields}
        pick = lambda k: opt.getField(k) if k in names else F.lit("")
    opts = [pick(k).alias(f"option_{k.lower()}") for k in S.VALID_ANSWER_IDX]
    cols = [F.format_string(f"{prefix}_%0{width}d", F.col(index_col)).alias("case_id"),
            F.col(question_col).alias("case_text"), F.col(question_col).alias("question"),
            *opts, F.col(answer_idx_col).alias("answer_idx")]
    if answer_col:
        cols.append(F.col(answer_col).alias("answer"))
    return df.select(*cols)


def map_options_flat(df: DataFrame, *, index_col: str, prefix: str = "medmcqa", width: int = 6,
                     question_col: str = "question", option_cols=("opa", "opb", "opc", "opd"),
                     cop_col: str = "cop", explanation_col: str = "exp",
                     specialty_col: str = "subject_name") -> DataFrame:
    """M2: flat options + integer answer code 0-3 (anything else -> "")."""
    cop = F.col(cop_col)
    letter = F.when(cop.between(0, 3) & (cop == F.floor(cop)),
                    F.substring(F.lit(S.COP_LETTERS), (cop + 1).cast("int"), 1)).otherwise(F.lit(""))
    return df.select(
        F.format_string(f"{prefix}_%0{width}d", F.col(index_col)).alias("case_id"),
        F.col(question_col).alias("case_text"), F.col(question_col).alias("question"),
        *[F.col(c).alias(f"option_{k.lower()}") for c, k in zip(option_cols, S.VALID_ANSWER_IDX)],
        letter.alias("answer_idx"),
        F.col(explanation_col).alias("explanation"),
        F.col(specialty_col).alias("specialty"))


def map_contexts_nested(df: DataFrame, *, id_col: str = "pubid", prefix: str = "pubmedqa",
                        question_col: str = "question", context_col: str = "context",
                        decision_col: str = "final_decision",
                        explanation_col: str = "long_answer") -> DataFrame:
    """M3: joined context sentences (or the question when empty), yes/no/maybe -> A/B/C."""
    ctx = F.col(context_col).getField("contexts")
    text = F.when(F.coalesce(F.size(ctx), F.lit(0)) > 0, F.array_join(ctx, " ")).otherwise(F.col(question_col))
    decision = F.lower(F.col(decision_col))
    letter = None
    for k, v in S.DECISION_LETTERS.items():
        letter = F.when(decision == k, v) if letter is None else letter.when(decision == k, v)
    letter = letter.otherwise(F.lit(""))
    a, b, c = S.DECISION_OPTIONS
    return df.select(
        F.concat(F.lit(prefix + "_"), F.col(id_col).cast("string")).alias("case_id"),
        text.alias("case_text"), F.col(question_col).alias("question"),
        F.lit(a).alias("option_a"), F.lit(b).alias("option_b"), F.lit(c).alias("option_c"),
        F.lit(None).cast("string").alias("option_d"),
        letter.alias("answer_idx"),
        F.col(explanation_col).alias("explanation"))


def tag_original_gender(df: DataFrame, text_col: str = "case_text") -> DataFrame:
    """M4: one-hot of the detected gender on the unexpanded table, ethnicity 'original'."""
    g = F.coalesce(X.detect_gender(text_col), F.lit("none"))
    return df.withColumns({
        "gender_male": (g == "male").cast("int"),
        "gender_female": (g == "female").cast("int"),
        "gender_none": (g == "none").cast("int"),
        "ethnicity": F.lit("original"),
    })


def with_gender(df: DataFrame, out_col: str = "gender") -> DataFrame:
    """M5 as a column; absent one-hot columns count as 0."""
    cols = [F.col(c) if c in df.columns else F.lit(0) for c in S.GENDER_ONEHOT]
    return df.withColumn(out_col, X.derive_gender(*cols))


def with_version(df: DataFrame, out_col: str = "version") -> DataFrame:
    """M6: ethnicity + '_' + derived gender."""
    return df.withColumn(out_col, X.derive_version("ethnicity", X.derive_gender()))


def with_performance(df: DataFrame, llm_col: str, llm_name: str | None = None) -> DataFrame:
    """M7: adds ``llm_<name>_performance`` (name = column without the ``llm_`` prefix)."""
    name = llm_name or (llm_col[4:] if llm_col.startswith("llm_") else llm_col)
    return df.withColumn(f"llm_{name}_performance", X.performance(llm_col))
