"""Schema validation and profiling as distributed aggregates.

Every check is a column expression inside one ``agg`` (or one grouped
aggregate), so a profile is one scan with map-side partial aggregation.
Results are small tidy DataFrames; ``validate_schema`` renders them as a list
of messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import text as X


def null_count(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    isnull = F.col(c).isNull()
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        isnull = isnull | F.isnan(c)
    return F.sum(isnull.cast("long"))


def null_profile(df: DataFrame, columns=None) -> DataFrame:
    """Null count (NaN counts as null for float columns) per column, one pass."""
    cols = list(columns or df.columns)
    wide = df.agg(*[null_count(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n_null"))
        for i, c in enumerate(cols)])))


def null_violations(df: DataFrame, allow_null_option_d: bool = False) -> DataFrame:
    """V2: required columns with at least one null."""
    cols = [c for c in S.REQUIRED_COLUMNS if not (allow_null_option_d and c == "option_d")]
    return null_profile(df, cols).where(F.col("n_null") > 0)


def answer_domain_violations(df: DataFrame, col: str = "answer_idx") -> DataFrame:
    """V3: distinct non-null answer labels outside A-D, with their row counts."""
    a = F.col(col)
    return (df.where(a.isNotNull() & ~a.isin(*S.VALID_ANSWER_IDX))
            .groupBy(a.alias("value")).agg(F.count(F.lit(1)).alias("n")))


def onehot_binary_violations(df: DataFrame) -> DataFrame:
    """V4: ``(column_name, value, n)`` for one-hot gender values outside {0, 1}."""
    onehot = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
        for c in S.GENDER_ONEHOT])))
    return (onehot.where(F.col("value").isNotNull() & ~F.col("value").isin(0.0, 1.0))
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def onehot_sum_violations(df: DataFrame) -> DataFrame:
    """V5: one row, the number of rows whose one-hots do not sum to 1 (a NULL one-hot counts)."""
    s = sum(F.col(c) for c in S.GENDER_ONEHOT)
    return df.agg(F.count_if(F.coalesce(s != 1, F.lit(True))).alias("n_bad"))


def ethnicity_domain_violations(df: DataFrame, ethnicities=None) -> DataFrame:
    """V6: distinct non-null ethnicities outside the expected set, with their row counts."""
    e = F.col("ethnicity")
    return (df.where(e.isNotNull() & ~e.isin(*list(ethnicities or S.ETHNICITIES)))
            .groupBy(e.alias("value")).agg(F.count(F.lit(1)).alias("n")))


def row_violations(df: DataFrame, allow_null_option_d: bool = False, ethnicities=None):
    """V2-V6 of one row as a column: ``array<struct<check, item>>``, empty for a valid row."""
    cols = [c for c in S.REQUIRED_COLUMNS if not (allow_null_option_d and c == "option_d")]
    answer, ethnicity = F.col("answer_idx"), F.col("ethnicity")
    total = sum(F.col(c) for c in S.GENDER_ONEHOT)

    def broken(check: str, when, item):
        return F.when(when, F.struct(F.lit(check).alias("check"), item.cast("string").alias("item")))

    found = [broken("null_values", F.isnull(c) | (F.isnan(c) if df.schema[c].dataType.typeName() in ("float", "double") else F.lit(False)),
                    F.lit(c)) for c in cols]
    found.append(broken("invalid_answer_idx", answer.isNotNull() & ~answer.isin(*S.VALID_ANSWER_IDX), answer))
    for c in S.GENDER_ONEHOT:
        value = F.col(c).cast("double")
        found.append(broken("non_binary_onehot", value.isNotNull() & ~value.isin(0.0, 1.0), F.concat_ws("=", F.lit(c), _num_text(value))))
    found.append(broken("onehot_sum", F.coalesce(total != 1, F.lit(True)), F.lit(None)))
    found.append(broken("invalid_ethnicity", ethnicity.isNotNull() & ~ethnicity.isin(*list(ethnicities or S.ETHNICITIES)), ethnicity))
    return F.array_compact(F.array(*found))


def schema_violations(df: DataFrame, allow_null_option_d: bool = False,
                      ethnicities=None) -> DataFrame:
    """V2-V6 as rows ``(check, item, n)`` from one pass; empty when the table is valid.

    Every row lists what it violates; one partial aggregate counts the list.
    """
    listed = df.select(F.inline(row_violations(df, allow_null_option_d, ethnicities)))
    return listed.groupBy("check", "item").agg(F.count(F.lit(1)).alias("n"))


def _num_text(v):
    """A double as text: integral values without a fraction."""
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


_CHECKS = ("null_values", "invalid_answer_idx", "non_binary_onehot", "onehot_sum", "invalid_ethnicity")


def validation_messages(df: DataFrame, *, allow_null_option_d: bool = False, ethnicities=None) -> DataFrame:
    """V1 as rows ``(seq, message)``: one per violated check and item, ``seq`` numbers the check.

    Missing columns short-circuit on the driver (a schema check, no job).
    """
    missing = [c for c in S.REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame([(0, f"columns not in the table: {', '.join(missing)}")], "seq int, message string")
    item, rows = F.col("item"), F.concat(F.lit(" in "), F.col("n").cast("string"), F.lit(" rows"))
    text = (F.when(F.col("check") == "null_values", F.concat(item, F.lit(": no value")))
            .when(F.col("check") == "invalid_answer_idx", F.concat(F.lit('answer_idx: unknown label "'), item, F.lit('"')))
            .when(F.col("check") == "non_binary_onehot", F.concat(item, F.lit(": neither 0 nor 1")))
            .when(F.col("check") == "onehot_sum", F.lit("gender: not exactly one flag is set"))
            .otherwise(F.concat(F.lit('ethnicity: unknown label "'), item, F.lit('"'))))
    seq = F.array_position(F.array(*[F.lit(c) for c in _CHECKS]), F.col("check")).cast("int")
    return schema_violations(df, allow_null_option_d, ethnicities).select(seq.alias("seq"), F.concat(text, rows).alias("message"))


def validate_schema(df: DataFrame, *, allow_null_option_d: bool = False, most: int = 1000) -> list[str]:
    """V1: the first ``most`` messages, empty when the table is valid (``validation_messages`` has all)."""
    rows = validation_messages(df, allow_null_option_d=allow_null_option_d).orderBy("seq", "message").limit(most).collect()
    return [r["message"] for r in rows]


def gender_counts(df: DataFrame) -> DataFrame:
    """V7: rows per derived gender label."""
    return df.groupBy(X.derive_gender().alias("gender")).agg(F.count(F.lit(1)).alias("n"))


def ethnicity_counts(df: DataFrame) -> DataFrame:
    """V8: rows per ethnicity (NULL not counted)."""
    return df.where(F.col("ethnicity").isNotNull()).groupBy("ethnicity").agg(F.count(F.lit(1)).alias("n"))


def gender_ethnicity_crosstab(df: DataFrame, ethnicities=None) -> DataFrame:
    """V9: rows per (gender, ethnicity); every gender of the table meets every ethnicity, absent cells are 0.

    The known ethnicities and those of the table are the columns.  One scan:
    the second aggregate works on the cells.
    """
    cells = df.groupBy(X.derive_gender().alias("gender"), "ethnicity").agg(F.count(F.lit(1)).alias("n"))
    known = F.array(*[F.lit(e) for e in ethnicities or S.ETHNICITIES])
    # The set of labels is bounded by the cells, not by the rows.
    per_gender = cells.groupBy("gender").agg(F.map_from_entries(F.collect_list(F.when(
        F.col("ethnicity").isNotNull(), F.struct("ethnicity", "n")))).alias("have"))
    return (per_gender.select("gender", "have", F.explode(F.array_union(known, F.map_keys("have"))).alias("ethnicity"))
            .select("gender", "ethnicity", F.coalesce(F.try_element_at("have", F.col("ethnicity")), F.lit(0)).alias("n")))


def variants_per_case(df: DataFrame, group_col: str = "case_id") -> DataFrame:
    """V10."""
    return df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n_variants"))


def variant_counts_valid(df: DataFrame, group_col: str = "case_id") -> DataFrame:
    """Every group has 2N or 3N rows, N = distinct non-null ethnicities (empty table -> true).

    N enters as a scalar subquery, so the check stays one distributed plan.
    """
    n = df.agg(F.countDistinct("ethnicity")).scalar()
    per = variants_per_case(df, group_col)
    bad = ~((F.col("n_variants") == 2 * n) | (F.col("n_variants") == 3 * n))
    return per.agg(F.count_if(bad).alias("n_bad")).select(
        n.alias("n_ethnicities"), (F.col("n_bad") == 0).cast("int").alias("all_valid"))


def answer_distribution(df: DataFrame, col: str = "answer_idx") -> DataFrame:
    """Rows per answer label (NULL not counted), sorted by label."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(col))


def auto_null_option_d(df: DataFrame) -> DataFrame:
    """Allow nulls in option_d iff option_d is entirely null."""
    return df.agg((F.count("option_d") == 0).cast("int").alias("allow_null_option_d"))


def shape_profile(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_columns, dtypes)``; dtypes lists ``name:type`` in column order."""
    dtypes = ",".join(f"{c}:{t}" for c, t in df.dtypes)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"),
                                                            F.lit(dtypes).alias("dtypes"))


def quality_rules(df: DataFrame, *, ethnicities=None, option_d: str = "any",
                  constant_options: bool = False, case_id_pattern: str | None = None,
                  min_explanation_rate: float = 0.95, age_rows_only: bool = False) -> DataFrame:
    """The dataset test-suite rules as one aggregate -> rows ``(rule, n_bad, ok)``.

    ``option_d``: 'never_null', 'always_null' or 'any'.  The ethnicity
    containment rule checks every row (``age_rows_only`` restricts it to rows
    whose text has a case-sensitive age phrase).
    """
    eths = list(ethnicities or S.ETHNICITIES)
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(False))
    rules = {
        "question_nonempty": F.count_if(blank("question")),
        "option_a_nonempty": F.count_if(blank("option_a")),
        "option_b_nonempty": F.count_if(blank("option_b")),
        "option_c_nonempty": F.count_if(blank("option_c")),
        "answer_idx_valid": F.count_if(~F.coalesce(F.col("answer_idx").isin(*S.VALID_ANSWER_IDX), F.lit(False))),
        "onehot_sum_one": F.count_if(F.coalesce(sum(F.col(c) for c in S.GENDER_ONEHOT) != 1, F.lit(True))),
    }
    if option_d == "never_null":
        rules["option_d_never_null"] = F.count_if(F.col("option_d").isNull())
    elif option_d == "always_null":
        rules["option_d_always_null"] = F.count_if(F.col("option_d").isNotNull())
    if constant_options:
        a, b, c = S.DECISION_OPTIONS
        rules["constant_options"] = F.count_if(~F.coalesce((F.col("option_a") == a) & (F.col("option_b") == b)
                                                           & (F.col("option_c") == c), F.lit(False)))
    if case_id_pattern:
        rules["case_id_format"] = F.count_if(~F.coalesce(F.col("case_id").rlike(case_id_pattern), F.lit(False)))
    contains = F.coalesce(F.instr(F.col("case_text"), F.col("ethnicity")) > 0, F.lit(False))
    scope = F.coalesce(F.col("case_text").rlike(r"(?:A|An) \d+-year-old"), F.lit(False)) if age_rows_only else F.lit(True)
    rules["ethnicity_in_case_text"] = F.count_if(scope & ~contains)
    agg = {f"r_{k}": v for k, v in rules.items()}
    agg["_n"] = F.count(F.lit(1))
    # A set of labels instead of distinct counts, which would copy every text-bearing row.
    agg["_labels"] = F.collect_set("ethnicity")
    for i, e in enumerate(eths):
        agg[f"_has{i}"] = F.max((F.col("ethnicity") == e).cast("int"))
    agg["_male"] = F.max("gender_male")
    agg["_female"] = F.max("gender_female")
    agg["_none"] = F.max("gender_none")
    if "explanation" in df.columns:
        agg["_expl"] = F.avg(F.coalesce(F.trim(F.col("explanation")) != "", F.lit(False)).cast("double"))
    if "specialty" in df.columns:
        agg["_spec"] = F.count_if(F.coalesce(F.trim(F.col("specialty")) != "", F.lit(False)))
    one = df.agg(*[v.alias(k) for k, v in agg.items()])
    rows = [F.struct(F.lit(k).alias("rule"), F.col(f"r_{k}").cast("long").alias("n_bad")) for k in rules]
    rows += [
        F.struct(F.lit("male_present").alias("rule"), F.when(F.col("_male") == 1, 0).otherwise(1).cast("long").alias("n_bad")),
        F.struct(F.lit("female_present").alias("rule"), F.when(F.col("_female") == 1, 0).otherwise(1).cast("long").alias("n_bad")),
        F.struct(F.lit("none_present").alias("rule"), F.when(F.col("_none") == 1, 0).otherwise(1).cast("long").alias("n_bad")),
        F.struct(F.lit("ethnicity_set_equal").alias("rule"),
                 (F.size(F.array_except("_labels", F.array(*[F.lit(e) for e in eths]))) + sum(1 - F.coalesce(F.col(f"_has{i}"), F.lit(0)) for i in range(len(eths))))
                 .cast("long").alias("n_bad")),
        F.struct(F.lit("row_count_multiple").alias("rule"),
                 (F.col("_n") % F.greatest(F.size("_labels"), F.lit(1))).cast("long").alias("n_bad")),
    ]
    if "explanation" in df.columns:
        rows.append(F.struct(F.lit("explanation_mostly_nonempty").alias("rule"),
                             F.when(F.coalesce(F.col("_expl"), F.lit(0.0)) >= min_explanation_rate, 0).otherwise(1)
                             .cast("long").alias("n_bad")))
    if "specialty" in df.columns:
        rows.append(F.struct(F.lit("specialty_not_all_empty").alias("rule"),
                             F.when(F.col("_spec") > 0, 0).otherwise(1).cast("long").alias("n_bad")))
    return one.select(F.inline(F.array(*rows))).withColumn("ok", (F.col("n_bad") == 0).cast("int"))
