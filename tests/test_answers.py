"""Answer metrics: hand cases and closed forms."""
import math

import numpy as np
import pytest

from varilens.operators import answers as A


def _df(spark, rows):
    return spark.createDataFrame(rows, "case_id string, answer_idx string, ethnicity string, gender_male int, "
                                       "gender_female int, gender_none int, llm_x_answer string")


def test_accuracy_null_prediction_is_wrong(spark):
    df = _df(spark, [("c", "A", "White", 1, 0, 0, None), ("c", "A", "White", 0, 1, 0, "A")])
    acc = A.accuracy(A.answer_cube(df, ["llm_x_answer"])).first()
    assert acc.accuracy == 0.5 and acc.llm == "x_answer"


def test_disparity_population_std(spark):
    df = _df(spark, [("c", "A", "White", 1, 0, 0, "A"), ("c", "A", "Black", 1, 0, 0, "A"),
                     ("c", "A", "Black", 1, 0, 0, "B")])
    d = A.performance_disparity(A.answer_cube(df, ["llm_x_answer"])).first()
    assert d.max_gap == pytest.approx(0.5) and d.std == pytest.approx(0.25)


def test_accuracy_by_dimension_drops_null_keys(spark):
    df = _df(spark, [("c", "A", None, 1, 0, 0, "A"), ("c", "A", "White", 0, 1, 0, "B")])
    rows = {(r.dimension, r.ethnicity, r.gender): r for r in
            A.accuracy_by_dimension(A.answer_cube(df, ["llm_x_answer"])).collect()}
    assert ("ethnicity", "White", None) in rows
    assert ("ethnicity", None, None) not in rows
    assert rows[("gender", None, "male")].accuracy == 1.0
    assert rows[("overall", None, None)].n == 2


def _chi2_v(table, yates):
    t = np.asarray(table, float)
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    d = np.abs(t - e)
    if yates:
        d = d - np.minimum(0.5, d)
    chi2 = (d * d / e).sum()
    dof = (t.shape[0] - 1) * (t.shape[1] - 1)
    return math.sqrt(chi2 / (t.sum() * dof))


def _cells(spark, rows):
    return spark.createDataFrame(rows, "llm string, label string, version string, perf int, o long")


def test_cramers_v_yates_2x2(spark):
    table = [[20, 10], [12, 18]]
    rows = [("m", "A", v, p, table[i][p]) for i, v in enumerate(["v0", "v1"]) for p in (0, 1)]
    r = A.cramers_v_by_label(_cells(spark, rows)).first()
    assert r.cramers_v == pytest.approx(_chi2_v(table, True)) and r.dof == 1 and r.n == 60


def test_cramers_v_filters_low_expected_rows(spark):
    table = [[20, 10], [12, 18], [1, 0], [15, 14]]
    rows = [("m", "A", f"v{i}", p, table[i][p]) for i in range(4) for p in (0, 1) if table[i][p] > 0]
    r = A.cramers_v_by_label(_cells(spark, rows)).first()
    kept = [table[0], table[1], table[3]]
    assert r.cramers_v == pytest.approx(_chi2_v(kept, False)) and r.n == sum(map(sum, kept))


def test_single_column_label_skipped(spark):
    rows = [("m", "A", "v0", 1, 10), ("m", "A", "v1", 1, 12)]
    assert A.cramers_v_by_label(_cells(spark, rows)).count() == 0


def test_skewsize_closed_form_and_null_cases(spark):
    vs = spark.createDataFrame([("m", "A", 0.1, 10), ("m", "B", 0.2, 10), ("m", "C", 0.5, 10),
                                ("k", "A", 0.3, 5), ("c", "A", 0.2, 4), ("c", "B", 0.2, 4)],
                               "llm string, label string, cramers_v double, n long")
    out = {r.llm: r for r in A.skewsize(vs).collect()}
    v = np.array([0.1, 0.2, 0.5])
    m2, m3 = ((v - v.mean()) ** 2).mean(), ((v - v.mean()) ** 3).mean()
    assert out["m"].skewsize == pytest.approx(m3 / m2 ** 1.5) and out["m"].n_cases == 30
    assert out["k"].skewsize is None
    assert out["c"].skewsize is None


def test_partition_count_invariance(spark):
    from varilens.plans import catalog
    from tests.conftest import SF_SMALL
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(map(tuple, catalog.QUERIES["accuracy_by_group"](spark, SF_SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = sorted(map(tuple, catalog.QUERIES["accuracy_by_group"](spark, SF_SMALL).collect()))
    assert a == b


def test_accuracy_by_other_group_column(spark):
    df = spark.createDataFrame([("c", "A", "White", 1, 0, 0, "A", "cardio"), ("c", "A", "White", 0, 1, 0, "B", "cardio"),
                                ("d", "B", "Black", 1, 0, 0, "B", "neuro")],
                               "case_id string, answer_idx string, ethnicity string, gender_male int, gender_female int, "
                               "gender_none int, llm_x_answer string, specialty string")
    cube = A.answer_cube(df, ["llm_x_answer"], extra_keys=["specialty"])
    got = {r.specialty: (r.accuracy, r.n) for r in A.accuracy_by_group(cube, ["specialty"]).collect()}
    assert got == {"cardio": (0.5, 2), "neuro": (1.0, 1)}
