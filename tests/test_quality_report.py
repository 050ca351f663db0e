"""Validation, profiling and report tables."""
import pytest

from varilens.operators import quality as Q
from varilens.operators import report as R
from varilens.operators import variants as V


def _variants(spark):
    df = spark.createDataFrame([("c1", "A 30-year-old man.", "q", "a", "b", "c", "d", "A"),
                                ("c2", "A 30-year-old patient.", "q", "a", "b", "c", None, "E")],
                               "case_id string, case_text string, question string, option_a string, option_b string, "
                               "option_c string, option_d string, answer_idx string")
    return V.expand_to_variants(df)


def test_validate_schema_messages(spark):
    v = _variants(spark)
    msgs = Q.validate_schema(v)
    assert "option_d: no value in 15 rows" in msgs
    assert 'answer_idx: unknown label "E" in 15 rows' in msgs
    assert Q.validate_schema(v.drop("ethnicity")) == ["columns not in the table: ethnicity"]
    assert all("option_d" not in m for m in Q.validate_schema(v, allow_null_option_d=True))


def test_counts_and_variant_validity(spark):
    v = _variants(spark)
    g = {r.gender: r.n for r in Q.gender_counts(v).collect()}
    assert g == {"male": 10, "female": 10, "none": 5}
    ok = Q.variant_counts_valid(v).first()
    assert ok.n_ethnicities == 5 and ok.all_valid == 1
    assert Q.variant_counts_valid(v.where("variant_idx <> 3")).first().all_valid == 0


def test_original_gender_distribution(spark):
    rows = {r.category: (r.cases, r.pct) for r in R.original_gender_distribution(_variants(spark)).collect()}
    assert rows["gender keyword present"] == (1, 50.0) and rows["no gender keyword"] == (1, 50.0)


def test_quality_rules_flags_bad_answer(spark):
    rules = {r.rule: r.n_bad for r in Q.quality_rules(_variants(spark), option_d="never_null").collect()}
    assert rules["answer_idx_valid"] == 15 and rules["option_d_never_null"] == 15
    assert rules["ethnicity_in_case_text"] == 0 and rules["ethnicity_set_equal"] == 0


def test_domain_violation_tables_and_messages(spark):
    df = spark.createDataFrame(
        [("c1", "t", "q", "a", "b", "c", "d", "A", 1, 0, 0, "White"),
         ("c2", "t", "q", "a", "b", "c", "d", "E", 2, 0, 0, "Martian"),
         ("c3", "t", "q", "a", "b", "c", "d", "", 1, 1, 0, "White"),
         ("c4", "t", "q", "a", "b", "c", "d", "B", 0, None, 1, None)],
        "case_id string, case_text string, question string, option_a string, option_b string, option_c string, "
        "option_d string, answer_idx string, gender_male int, gender_female int, gender_none int, ethnicity string")
    assert {(r.value, r.n) for r in Q.answer_domain_violations(df).collect()} == {("E", 1), ("", 1)}
    assert [(r.column_name, r.value, r.n) for r in Q.onehot_binary_violations(df).collect()] == [("gender_male", 2.0, 1)]
    assert Q.onehot_sum_violations(df).first().n_bad == 3
    assert [(r.value, r.n) for r in Q.ethnicity_domain_violations(df).collect()] == [("Martian", 1)]
    assert Q.validate_schema(df) == [
        "ethnicity: no value in 1 rows",
        "gender_female: no value in 1 rows",
        'answer_idx: unknown label "" in 1 rows',
        'answer_idx: unknown label "E" in 1 rows',
        "gender_male=2: neither 0 nor 1 in 1 rows",
        "gender: not exactly one flag is set in 3 rows",
        'ethnicity: unknown label "Martian" in 1 rows',
    ]
    shape = Q.shape_profile(df).first()
    assert (shape.n_rows, shape.n_columns) == (4, 12) and shape.dtypes.startswith("case_id:string,") and "gender_male:int" in shape.dtypes
    cells = {(r.gender, r.ethnicity): r.n for r in Q.gender_ethnicity_crosstab(df).collect()}
    assert cells["none", "White"] == 0 and cells["male", "White"] == 2 and cells["male", "Asian"] == 0 and sum(cells.values()) == 3
