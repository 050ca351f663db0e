"""Embedding metrics against explicit numpy computations."""
from itertools import combinations

import numpy as np
import pytest

from varilens.operators import embedding as E
from tests.conftest import SF_SMALL


def _cos(a, b):
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return 0.0 if na == 0 or nb == 0 else float(a @ b / (na * nb))


def test_cossim_closed_form_equals_pairs(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("a", [1.0, 1.0]), ("a", [0.0, 0.0]),
            ("b", [1.0, 2.0]), ("c", None)]
    df = spark.createDataFrame(rows, "case_id string, embedding array<double>")
    got = {r.case_id: r.cossim for r in E.cossim_across_variants(df).collect()}
    vecs = [np.array(v) for c, v in rows if c == "a"]
    exp = np.mean([_cos(x, y) for x, y in combinations(vecs, 2)])
    assert got["a"] == pytest.approx(exp, abs=1e-12)
    assert got["b"] is None and "c" not in got


def test_pca_direction_matches_numpy(spark):
    from varilens.plans import fixtures as FX
    pairs = FX.sentence_pairs(spark, SF_SMALL)
    g = np.array(E.gender_direction_pca(pairs))
    rows = pairs.collect()
    d = np.array([np.array(r.female, float) - np.array(r.male, float) for r in rows])
    d = d - d.mean(0)
    _, _, vt = np.linalg.svd(d, full_matrices=False)
    ref = vt[0]
    if ref[np.argmax(np.abs(ref))] < 0:
        ref = -ref
    assert np.allclose(g, ref, atol=1e-8)


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "female array<double>, male array<double>")


@pytest.mark.parametrize("seed, n, d", [(1, 300, 5), (2, 40, 16), (3, 2, 3), (4, 6, 12), (5, 3000, 2)])
def test_power_iteration_matches_svd(spark, seed, n, d):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, d)) * (1 + np.arange(d)) + 50  # a mean far from zero
    got = E.gender_direction(_pairs(spark, [(v.tolist(), [0.0] * d) for v in x]).repartition(3)).first()
    ref = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0]
    ref = ref if ref[np.argmax(np.abs(ref))] > 0 else -ref
    assert np.allclose(got.direction, ref, atol=1e-8)
    assert got.gap <= 1e-14 and 0 < got.steps < 20_000
    up = E.gender_direction(_pairs(spark, [(v.tolist(), [0.0] * d) for v in x]), orient="female_positive").first().direction
    assert np.allclose(up, ref * (1 if ref @ x.mean(0) >= 0 else -1), atol=1e-8)


def test_direction_of_odd_pairs(spark):
    assert E.gender_direction(_pairs(spark, [])).first().direction is None
    assert E.gender_direction_pca(_pairs(spark, [])) is None
    for rows in ([([1.0, 2.0], [0.0, 0.0])], [([1.0, 0.1], [0.3, 0.7])] * 3):
        assert E.gender_direction(_pairs(spark, rows)).first().direction is None
    good = [([1.0, 0.0], [0.0, 0.0]), ([0.0, 0.5], [1.0, 0.5]), ([2.0, 1.0], [2.0, 1.0])]
    bad = [(None, [1.0, 2.0]), ([1.0, None], [0.0, 0.0]), ([1.0], [0.0, 0.0]), ([float("nan"), 1.0], [0.0, 0.0]),
           ([float("inf"), 1.0], [0.0, 0.0])]
    want = E.gender_direction(_pairs(spark, good)).first().direction
    assert np.allclose(want, [1.0, 0.0], atol=1e-12)
    assert E.gender_direction(_pairs(spark, good + bad)).first().direction == pytest.approx(want)
    with pytest.raises(ValueError):
        E.gender_direction(_pairs(spark, good), method="median")


def test_evaluate_goes_from_pairs_to_scores_without_a_job(spark):
    from varilens.plans import fixtures as FX
    from varilens.plans.evaluate import evaluate
    pairs, rows = FX.sentence_pairs(spark, SF_SMALL), FX.scored_cases(spark, SF_SMALL)
    df = rows.selectExpr("*", "'A' as answer_idx", "'A' as llm_m_answer")
    tracker, before = spark.sparkContext.statusTracker(), None
    spark.sparkContext.setJobGroup("lazy", "evaluate")
    try:
        before = len(tracker.getJobIdsForGroup("lazy"))
        with evaluate(df, llm_col="llm_m_answer", case_embedding_col="embedding", gender_pairs=pairs) as res:
            assert len(tracker.getJobIdsForGroup("lazy")) == before
            got = {r.gender: r.mean for r in res.gender_bias["by_gender"].collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    g = np.array(E.gender_direction_pca(pairs))
    by = {}
    for r in rows.collect():
        name = "male" if r.gender_male else "female" if r.gender_female else "none"
        by.setdefault(name, []).append(np.array(r.embedding, float) @ g / np.linalg.norm(g))
    assert got == {k: pytest.approx(np.mean(v), abs=1e-9) for k, v in by.items()}


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).normal(size=2001).tolist() + [float("nan")], np.random.default_rng(2).normal(size=300).tolist(),
    [1.0, 2.0, 10.0, 4.0], [2.5] * 7, [3.0], [1.0, 1.0, 2.0, 2.0], [float("inf"), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0],
    [float("-inf"), float("-inf"), 1.0], [5.0, float("inf")], [0.0] * 500 + [1.0] * 500])
def test_median_is_exact_and_one_lazy_plan(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "gender_bias_score double")
    fine = [v for v in values if v == v]
    exp = pytest.approx(float(np.median(fine)))
    assert E.median_bias(df).first().mb == exp
    assert E.median_bias(df, accuracy=20).first().mb == exp  # a wide bracket


def test_median_of_nothing(spark):
    for rows in ([], [(None,)], [(float("nan"),)]):
        assert E.median_bias(spark.createDataFrame(rows, "gender_bias_score double")).first().mb is None


def test_cossim_leaves_out_null_cases(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), ("a", [1.0, 0.0]), ("a", [0.0, 0.0]), ("b", [1.0, 1.0])],
                               "case_id string, embedding array<double>")
    assert {r.case_id: r.cossim for r in E.cossim_across_variants(df).collect()} == {"a": 0.0, "b": None}


def test_hashing_embedder_is_native_and_counts_tokens(spark):
    from varilens.functions.hashing import hashing_embedder
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    rows = [r[0] for r in df.select(hashing_embedder(8)(df["t"])).collect()]
    assert sum(map(abs, rows[0])) in (1.0, 3.0) and rows[1] == [0.0] * 8 and rows[2] is None


def test_bias_score_and_summaries(spark):
    df = spark.createDataFrame([([1.0, 0.0], 1, 0, 0, "White"), ([0.0, 2.0], 0, 1, 0, "White"),
                                ([3.0, 4.0], 0, 1, 0, "Black"), (None, 0, 0, 1, "Black")],
                               "embedding array<double>, gender_male int, gender_female int, gender_none int, "
                               "ethnicity string")
    s = E.gender_bias_score(df, [0.0, 2.0])
    scores = [r.gender_bias_score for r in s.collect()]
    assert scores == [0.0, 2.0, 4.0, None]
    g = {r.gender: r for r in E.bias_by_gender(s).collect()}
    assert g["female"].mean == pytest.approx(3.0) and g["male"].std is None and "none" not in g


def test_texts_are_embedded_once_under_a_filter(spark):
    """A filter on the vectors must not be pushed below the embedder, which would run it twice."""
    from pyspark.sql import functions as F
    from varilens.functions.hashing import hashing_embedder
    from varilens.operators import embedding as E
    df = spark.createDataFrame([("a b", 1), ("c", 2), (None, 3), ("a b", 4)], "text string, k int")
    out = E.embed_distinct(df, "text", hashing_embedder(20)).where(F.col("embedding").isNotNull())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    assert sorted((r.k, len(r.embedding), sum(map(abs, r.embedding))) for r in out.collect()) == [(1, 20, 2.0), (2, 20, 1.0), (4, 20, 2.0)]
