"""Property checks on the real fixture (sf0.001) and facade / writer round trips."""
import json
import os

import pytest
from pyspark.sql import functions as F

from varilens import schema as S
from varilens.operators import answers as A
from varilens.plans import fixtures as FX
from tests.conftest import SF_SMALL

GENERATED = {"case_text", "gender_male", "gender_female", "gender_none", "ethnicity", "variant_idx"}


def test_row_count_identity(spark):
    v = FX.variants(spark, SF_SMALL)
    per = v.groupBy("case_id").agg(F.count(F.lit(1)).alias("k"), F.max("gender_none").alias("neutral")).collect()
    n = len(S.ETHNICITIES)
    with_g = sum(1 for r in per if r.neutral == 0)
    without = sum(1 for r in per if r.neutral == 1)
    assert v.count() == 2 * n * with_g + 3 * n * without
    assert all(r.k == (3 * n if r.neutral else 2 * n) for r in per)


def test_variants_differ_only_in_generated_columns(spark):
    v = FX.variants(spark, SF_SMALL)
    other = [c for c in v.columns if c not in GENERATED]
    distinct = v.groupBy("case_id").agg(*[F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("<null>"))).alias(c)
                                          for c in other if c != "case_id"])
    for r in distinct.collect():
        assert all(r[c] == 1 for c in other if c != "case_id"), r


def test_every_variant_text_names_its_ethnicity(spark):
    v = FX.variants(spark, SF_SMALL, fallback_prepend=True)
    assert v.where(F.instr("case_text", F.col("ethnicity")) == 0).count() == 0


def test_evaluate_facade_and_writers(spark, scratch):
    from varilens.plans.evaluate import evaluate
    from varilens.sources import writers
    p = FX.predictions(spark, SF_SMALL).withColumn("expl", F.concat_ws(" ", F.lit("answer"), "llm_m1_answer",
                                                                       "ethnicity"))
    res = evaluate(p, llm_col="llm_m1_answer", explanation_col="expl")
    acc = res.accuracy.first()
    cube = A.answer_cube(p, ["llm_m1_answer"])
    assert acc.accuracy == pytest.approx(A.accuracy(cube).first().accuracy)
    assert res.bleu.count() == p.select("case_id").distinct().count()
    writers.write_results(res.tables(), f"{scratch}/res")
    assert os.path.isdir(f"{scratch}/res/skewsize")
    doc = writers.results_document({"accuracy": res.accuracy, "bleu": res.bleu}).collect()
    assert [json.loads(r.value)["llm"] for r in doc if r.metric == "accuracy"] == ["m1_answer"]
    assert sum(r.metric == "bleu" for r in doc) == res.bleu.count()
    res.close()


def test_evaluate_several_models_names_and_groups(spark):
    from varilens.plans.evaluate import evaluate
    p = FX.predictions(spark, SF_SMALL)
    cols = [c for c in p.columns if c.startswith("llm_")]
    with evaluate(p, llm_col=cols) as res:
        assert {r.llm for r in res.summary().collect()} == {c[4:] for c in cols}
    with evaluate(p, llm_col=cols[0], llm_name="mine", hue="gender_male") as res:
        assert [r.llm for r in res.accuracy.collect()] == ["mine"] and res.skewsize.first().llm == "mine"
    with pytest.raises(ValueError):
        evaluate(p, llm_col=cols, llm_name="mine")
    pairs = FX.sentence_pairs(spark, SF_SMALL)
    rows = FX.scored_cases(spark, SF_SMALL).withColumns({"answer_idx": F.lit("A"), "llm_x": F.lit("A")})
    with evaluate(rows, llm_col="llm_x", case_embedding_col="embedding", gender_pairs=pairs) as res:
        assert res.gender_bias["by_gender"].count() == 3 and res.gender_bias["median"].first().mb is not None


def test_identical_long_pair_bleu_is_one(spark):
    from varilens.operators import overlap as B
    df = spark.createDataFrame([("c", 0, "w x y z v"), ("c", 1, "w x y z v"), ("c", 2, "w x y z v")],
                               "case_id string, variant_idx int, response string")
    assert B.bleu_across_variants(df, response_col="response").first().bleu == pytest.approx(1.0)
