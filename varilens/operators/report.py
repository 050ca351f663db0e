"""Dataset report and inspection queries as small tidy DataFrames.

The Markdown rendering of the original report is not rebuilt; the numbers
are here, and ``report_table`` unions the sections into one long table
``(section, key1, key2, value)`` that ``sources.writers`` can persist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from . import embedding as E
from . import quality as Q


def dataset_overview(variants: DataFrame, n_dropped: DataFrame) -> DataFrame:
    """Cases after filtering, rows after expansion, cases dropped by the ethnicity filter."""
    head = variants.agg(F.countDistinct("case_id").alias("n_cases"), F.count(F.lit(1)).alias("n_rows"))
    return head.select("n_cases", "n_rows", n_dropped.select("n_dropped").scalar().alias("n_dropped"))


def original_gender_distribution(variants: DataFrame) -> DataFrame:
    """Cases with / without a gender word in the source text (from the neutral variants).

    Per case ``max(gender_none)`` (one grouped aggregate), then two counts
    and their share in percent, one decimal.
    """
    per_case = variants.groupBy("case_id").agg(F.max("gender_none").alias("_neutral"))
    tot = per_case.agg(
        F.count_if(F.coalesce(F.col("_neutral"), F.lit(0)) == 0).alias("with_gender"),
        F.count_if(F.col("_neutral") == 1).alias("without_gender"),
        F.count(F.lit(1)).alias("total"))
    pct = lambda c: F.round(F.try_divide(100.0 * F.col(c), F.col("total")), 1)
    return tot.select(F.inline(F.array(
        F.struct(F.lit("gender keyword present").alias("category"), F.col("with_gender").alias("cases"),
                 pct("with_gender").alias("pct")),
        F.struct(F.lit("no gender keyword").alias("category"), F.col("without_gender").alias("cases"),
                 pct("without_gender").alias("pct")))))


def variant_distribution(variants: DataFrame) -> DataFrame:
    """Gender counts, ethnicity counts and the crosstab as one long table, all from one set of cells."""
    cells = variants.groupBy(X.derive_gender().alias("gender"), "ethnicity").agg(F.count(F.lit(1)).alias("n"))
    return _sections(cells, {"gender": ("gender", None), "ethnicity": ("ethnicity", None), "crosstab": ("gender", "ethnicity")})


def _sections(cells: DataFrame, sections: dict) -> DataFrame:
    """``section, key1, key2, value``: sums of the cells' ``n`` by each section's keys (NULL keys left out)."""
    none = F.lit(None).cast("string")
    rows = []
    for name, (key1, key2) in sections.items():
        row = F.struct(F.lit(name).alias("section"), F.col(key1).alias("key1"),
                       (F.col(key2) if key2 else none).alias("key2"), "n")
        rows.append(F.when(F.col(key1).isNotNull() & (F.col(key2).isNotNull() if key2 else F.lit(True)), row))
    return (cells.select(F.inline(F.array_compact(F.array(*rows)))).groupBy("section", "key1", "key2")
            .agg(F.sum("n").alias("value")))


def specialty_top20(df: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent specialties (ties broken by name); the limit is the feature."""
    return (df.where(F.col("specialty").isNotNull()).groupBy("specialty").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("specialty")).limit(n))


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """First n rows (by case_id, variant_idx) of the required columns present."""
    cols = [c for c in S.REQUIRED_COLUMNS if c in df.columns]
    order = [c for c in ("case_id", "variant_idx") if c in df.columns]
    return df.select(*cols, *[c for c in order if c not in cols]).orderBy(*order).limit(n)


def expansion_summary(original: DataFrame, variants: DataFrame) -> DataFrame:
    """Original rows, variant rows, integer expansion factor, column counts."""
    o = original.agg(F.count(F.lit(1)).alias("original_rows"))
    v = variants.agg(F.count(F.lit(1)).alias("variant_rows"))
    vr = v.select("variant_rows").scalar()
    return o.select("original_rows", vr.alias("variant_rows"),
                    F.when(F.col("original_rows") > 0, F.floor(vr / F.col("original_rows"))).cast("long")
                    .alias("expansion_factor"),
                    F.lit(len(original.columns)).alias("original_columns"),
                    F.lit(len(variants.columns)).alias("variant_columns"))


def before_after_examples(original: DataFrame, expand, n: int = 10) -> DataFrame:
    """The first n original cases (by case_id) next to all their variants.

    ``expand`` turns cases into variants; it is applied to the n cases only.
    Display snippets as in the original tool: original text cut to 400
    characters; variant text cut to 300, newlines to spaces, then 120.
    """
    first = original.orderBy("case_id").limit(n)
    snippet = F.substring(F.replace(F.substring("case_text", 1, 300), F.lit("\n"), F.lit(" ")), 1, 120)
    kept = first.withColumn("original_snippet", F.substring("case_text", 1, 400))
    return expand(kept).select("case_id", "original_snippet", "variant_idx", X.derive_gender().alias("gender"), "ethnicity",
                               snippet.alias("variant_snippet"))


def report_table(variants: DataFrame, n_dropped: DataFrame) -> DataFrame:
    """The numeric report sections unioned into ``(section, key1, key2, value)``.

    Three scans of the variants: one profile, one aggregate per case, one set
    of (gender, ethnicity, answer) cells.
    """
    def row(section: str, key: str, value):
        return F.struct(F.lit(section).alias("section"), F.lit(key).alias("key1"), F.lit(None).cast("string").alias("key2"),
                        value.cast("double").alias("value"))

    names = list(variants.columns)
    profile = variants.agg(F.count(F.lit(1)).alias("rows"), *[Q.null_count(variants, c).alias(f"n{i}") for i, c in enumerate(names)])
    first = profile.select(F.inline(F.array(
        row("overview", "n_rows", F.col("rows")), row("overview", "n_dropped", n_dropped.select("n_dropped").scalar()),
        *[row("null_count", c, F.coalesce(F.col(f"n{i}"), F.lit(0))) for i, c in enumerate(names)])))
    per_case = variants.groupBy("case_id").agg(F.max("gender_none").alias("neutral"))
    second = per_case.agg(
        F.count("case_id").alias("cases"), F.count_if(F.coalesce("neutral", F.lit(0)) == 0).alias("gendered"),
        F.count_if(F.col("neutral") == 1).alias("plain")).select(F.inline(F.array(
            row("overview", "n_cases", F.col("cases")), row("original_gender", "gender keyword present", F.col("gendered")),
            row("original_gender", "no gender keyword", F.col("plain")))))
    cells = variants.groupBy(X.derive_gender().alias("gender"), "ethnicity", "answer_idx").agg(F.count(F.lit(1)).alias("n"))
    third = _sections(cells, {"gender": ("gender", None), "ethnicity": ("ethnicity", None),
                              "crosstab": ("gender", "ethnicity"), "answer": ("answer_idx", None)})
    return first.unionByName(second).unionByName(third.withColumn("value", F.col("value").cast("double")))


def schema_table(variants: DataFrame) -> DataFrame:
    """R2: column, Spark type and null count of the variant table (one aggregate pass)."""
    types = F.create_map(*[F.lit(x) for pair in variants.dtypes for x in pair])
    return Q.null_profile(variants).select("column_name", types[F.col("column_name")].alias("dtype"),
                                           F.col("n_null").cast("long").alias("n_null"))


def bias_sections(scored: DataFrame, score_col: str = "gender_bias_score") -> DataFrame:
    """E6-E9 as one long table ``section, key1, key2, mean, std``.

    One scan for the three groupings (every row names its groups), the
    median's own plan beside it.
    """
    rows = E.scored_rows(scored, score_col)
    none = F.lit(None).cast("string")

    def group(section, key1, key2=None):
        return F.struct(F.lit(section).alias("section"), F.col(key1).alias("key1"),
                        (F.col(key2) if key2 else none).alias("key2"), F.col(score_col).alias("score"))

    known = F.col("ethnicity").isNotNull()
    groups = F.array_compact(F.array(group("by_gender", "gender"), F.when(known, group("by_ethnicity", "ethnicity")),
                                     F.when(known, group("crosstab", "gender", "ethnicity"))))
    means = rows.select(F.inline(groups)).groupBy("section", "key1", "key2").agg(
        F.avg("score").alias("mean"), F.when(F.col("section") != "crosstab", F.stddev_samp("score")).alias("std"))
    median = E.median_bias(scored, score_col).select(F.lit("median").alias("section"), none.alias("key1"), none.alias("key2"),
                                                     F.col("mb").alias("mean"), F.lit(None).cast("double").alias("std"))
    return means.unionByName(median)


def expansion_distributions(variants: DataFrame) -> DataFrame:
    """Rows per gender, ethnicity and answer after the expansion, ``section, key1, key2, value``, from one scan."""
    cells = variants.groupBy(X.derive_gender().alias("gender"), "ethnicity", "answer_idx").agg(F.count(F.lit(1)).alias("n"))
    return _sections(cells, {"gender": ("gender", None), "ethnicity": ("ethnicity", None), "answer": ("answer_idx", None)})
