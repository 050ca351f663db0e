"""Answer accuracy, disparity and Cramér's-V skew ("SkewSize").

Design: the variant table is touched once.  ``answer_cube`` folds it into
``(llm, answer_idx, ethnicity, gender) -> n, n_correct`` with a map-side
partial aggregate, so its size is bounded by models x labels x groups no
matter how many rows (or how skewed the groups) there are.  Every metric
below is a second-level aggregate over that cube.

Several models are handled as rows (``unpivot`` of the answer columns),
not as a Python loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

CUBE_KEYS = ["llm", "answer_idx", "ethnicity", "gender"]


def long_predictions(df: DataFrame, llm_cols, *, keep=()) -> DataFrame:
    """Wide ``llm_<name>_answer`` columns -> rows ``(llm, answer)``; name = column minus ``llm_``."""
    llm_cols = [llm_cols] if isinstance(llm_cols, str) else list(llm_cols)
    names = [c[4:] if c.startswith("llm_") else c for c in llm_cols]
    base = [c for c in ("answer_idx", "ethnicity", *X_ONEHOT, *keep) if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(n).alias("llm"), F.col(c).cast("string").alias("answer"))
                      for n, c in zip(names, llm_cols)])
    return df.select(*base, F.inline(pairs))


X_ONEHOT = ["gender_male", "gender_female", "gender_none"]


def _gender_col(df: DataFrame):
    cols = [F.col(c) if c in df.columns else F.lit(0) for c in X_ONEHOT]
    return X.derive_gender(*cols)


def answer_cube(df: DataFrame, llm_cols, extra_keys=()) -> DataFrame:
    """(llm, answer_idx, ethnicity, gender, *extra_keys) -> n, n_correct.  NULL keys are kept here.

    ``extra_keys`` adds any other grouping column (e.g. ``specialty``) to the
    cube; the cube stays small as long as those columns have few values.
    """
    extra = [k for k in extra_keys if k not in CUBE_KEYS]
    long = long_predictions(df, llm_cols, keep=extra)
    eth = F.col("ethnicity") if "ethnicity" in df.columns else F.lit(None).cast("string")
    return (long
            .select("llm", "answer_idx", eth.alias("ethnicity"), _gender_col(long).alias("gender"), *extra,
                    X.performance("answer", "answer_idx").alias("correct"))
            .groupBy(*CUBE_KEYS, *extra)
            .agg(F.count(F.lit(1)).alias("n"), F.sum("correct").cast("long").alias("n_correct")))


def accuracy(cube: DataFrame) -> DataFrame:
    """A1 per model: mean correctness over all rows (NULL when empty)."""
    return cube.groupBy("llm").agg(
        F.try_divide(F.sum("n_correct"), F.sum("n")).alias("accuracy"),
        F.sum("n").alias("n"))


def accuracy_by_group(cube: DataFrame, group_cols=("ethnicity", "gender")) -> DataFrame:
    """A2: accuracy and row count per group; rows with a NULL group key are left out."""
    cols = list(group_cols)
    kept = cube
    for c in cols:
        kept = kept.where(F.col(c).isNotNull())
    return (kept.groupBy("llm", *cols)
            .agg((F.sum("n_correct") / F.sum("n")).alias("accuracy"), F.sum("n").alias("n")))


def accuracy_by_dimension(cube: DataFrame) -> DataFrame:
    """A3 breakdowns in one pass: GROUPING SETS ((ethnicity, gender), (ethnicity), (gender), ())."""
    g = (cube.cube("llm", "ethnicity", "gender")
         .agg((F.sum("n_correct") / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"),
              F.grouping_id("llm", "ethnicity", "gender").alias("_gid")))
    dim = (F.when(F.col("_gid") == 0, "ethnicity_gender").when(F.col("_gid") == 1, "ethnicity")
           .when(F.col("_gid") == 2, "gender").when(F.col("_gid") == 3, "overall"))
    # A NULL key inside a real grouping is dropped, as in a plain group-by.
    ok = (((F.col("_gid") == 0) & F.col("ethnicity").isNotNull() & F.col("gender").isNotNull())
          | ((F.col("_gid") == 1) & F.col("ethnicity").isNotNull())
          | ((F.col("_gid") == 2) & F.col("gender").isNotNull())
          | (F.col("_gid") == 3))
    return g.where(ok & dim.isNotNull()).select("llm", dim.alias("dimension"), "ethnicity", "gender",
                                                "accuracy", "n")


def performance_disparity(cube: DataFrame) -> DataFrame:
    """A3: max - min and population std of the (ethnicity x gender) accuracies, unweighted."""
    groups = accuracy_by_group(cube, ("ethnicity", "gender"))
    return groups.groupBy("llm").agg(
        (F.max("accuracy") - F.min("accuracy")).alias("max_gap"),
        F.stddev_pop("accuracy").alias("std"),
        F.count(F.lit(1)).alias("n_groups"))


# ------------------------------------------------------------ SkewSize ----

def contingency_by_label(cube: DataFrame, label_col: str = "answer_idx", hue: str | None = None) -> DataFrame:
    """A4: cells (llm, label, version, perf, o) of the version x performance crosstab per label.

    The version is ethnicity and gender, or the cube's column ``hue``.  NULL
    versions and NULL labels are not part of any crosstab.
    """
    version = F.col(hue).cast("string") if hue else X.derive_version("ethnicity", F.col("gender"))
    v = cube.where(F.col(label_col).isNotNull()).select(
        "llm", F.col(label_col).alias("label"), version.alias("version"), "n", "n_correct").where("version is not null")
    agg = v.groupBy("llm", "label", "version").agg(F.sum("n").alias("n"), F.sum("n_correct").alias("c1"))
    return (agg.select("llm", "label", "version",
                       F.inline(F.array(F.struct(F.lit(0).alias("perf"), (F.col("n") - F.col("c1")).alias("o")),
                                        F.struct(F.lit(1).alias("perf"), F.col("c1").alias("o")))))
            .where(F.col("o") > 0))


def cramers_v_by_label(cells: DataFrame, min_expected_value: float = 5) -> DataFrame:
    """A5: Cramér's V per (llm, label) after dropping rows/columns without any expected >= k.

    chi² uses the filtered table, with Yates' correction when dof = 1;
    V = sqrt(chi² / (n * (r-1)(c-1))).  Labels left with < 2 rows or < 2
    columns get no row; a zero expected cell after filtering gives V NULL.
    """
    lab = ["llm", "label"]
    w_lab, w_row, w_col = Window.partitionBy(*lab), Window.partitionBy(*lab, "version"), \
        Window.partitionBy(*lab, "perf")

    def expected(df):
        return df.withColumn("_e", F.sum("o").over(w_row) * F.sum("o").over(w_col) / F.sum("o").over(w_lab))

    e0 = expected(cells).withColumn("_ok", (F.col("_e") >= min_expected_value).cast("int"))
    kept = (e0.withColumn("_rk", F.max("_ok").over(w_row)).withColumn("_ck", F.max("_ok").over(w_col))
            .where((F.col("_rk") == 1) & (F.col("_ck") == 1)).select(*lab, "version", "perf", "o"))
    e1 = expected(kept)
    per_label = e1.groupBy(*lab).agg(
        F.countDistinct("version").alias("r"), F.countDistinct("perf").alias("c"),
        F.sum("o").alias("n"),
        F.collect_list(F.struct("o", "_e")).alias("_cells"))
    # (the cell list is bounded by versions x 2 per label)
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    diff = lambda c: F.abs(c.o - c._e)
    corr = lambda c: F.when(dof == 1, diff(c) - F.least(F.lit(0.5), diff(c))).otherwise(diff(c))
    chi2 = F.aggregate(F.col("_cells"), F.lit(0.0).cast("double"),
                       lambda acc, c: acc + F.try_divide(corr(c) * corr(c), c._e))
    has_zero = F.exists(F.col("_cells"), lambda c: c._e == 0)
    v = F.when(has_zero, F.lit(None)).otherwise(F.sqrt(chi2 / (F.col("n") * dof)))
    return (per_label.where((F.col("r") > 1) & (F.col("c") > 1))
            .select(*lab, v.alias("cramers_v"), F.col("n").cast("long").alias("n"), dof.alias("dof")))


def skewsize(vs: DataFrame) -> DataFrame:
    """Biased skewness (g1) of V over labels per model, and the number of rows evaluated.

    NULL when fewer than two defined values or the values are (nearly) constant.
    """
    valid = vs.where(F.col("cramers_v").isNotNull() & ~F.isnan("cramers_v"))
    g = valid.groupBy("llm").agg(F.skewness("cramers_v").alias("_sk"), F.var_pop("cramers_v").alias("_m2"),
                                 F.avg("cramers_v").alias("_mean"), F.sum("n").alias("n_cases"))
    near_const = F.col("_m2") <= F.pow(F.lit(1e-15) * F.col("_mean"), 2)
    out = g.select("llm", F.when(near_const, F.lit(None)).otherwise(F.col("_sk")).alias("skewsize"),
                   F.coalesce(F.col("n_cases"), F.lit(0)).cast("long").alias("n_cases"))
    return out


def skewsize_from_cube(cube: DataFrame, min_expected_value: float = 5, label_col: str = "answer_idx",
                       hue: str | None = None) -> DataFrame:
    """A6 for every model of the cube; one without a usable label has a NULL skew and 0 cases."""
    found = skewsize(cramers_v_by_label(contingency_by_label(cube, label_col, hue), min_expected_value))
    return (cube.select("llm").where(F.col("llm").isNotNull()).distinct().join(found, "llm", "left")
            .select("llm", "skewsize", F.coalesce("n_cases", F.lit(0).cast("long")).alias("n_cases")))


def eval_header(df: DataFrame) -> DataFrame:
    """Row count and distinct case count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("case_id").alias("n_cases"))


def consistency_summary(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """Mean of a per-case score series (NULL scores skipped)."""
    return scores.agg(F.avg(score_col).alias("mean_score"), F.count(score_col).alias("n_scored"))
