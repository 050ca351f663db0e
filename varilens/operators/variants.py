"""Ethnicity filter, gender detection and counterfactual expansion.

The expansion is a narrow plan: one projection per case (gender detection,
age-phrase template), one ``explode`` of a literal variant array, one
projection per variant.  No shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X

# Marks the injection slot in the per-case template.  Texts that already
# contain it take the exact (slower) regex path instead.
_SLOT = "\ue000\ue001"


def filter_ethnicity_mentions(df: DataFrame, text_col: str = "case_text",
                              observation: Observation | None = None) -> DataFrame:
    """Keep rows whose text names no ethnicity.

    With ``observation`` the number of dropped rows is recorded as
    ``n_dropped`` in the same pass (no second scan).
    """
    flagged = df.withColumn("_mention", X.mentions_ethnicity(text_col))
    if observation is not None:
        flagged = flagged.observe(
            observation, F.coalesce(F.sum(F.col("_mention").cast("long")), F.lit(0)).alias("n_dropped"))
    return flagged.where(~F.col("_mention")).drop("_mention")


def count_ethnicity_mentions(df: DataFrame, text_col: str = "case_text") -> DataFrame:
    """Number of rows T1 would drop, as a one-row DataFrame (``n_dropped``)."""
    return df.agg(F.count_if(X.mentions_ethnicity(text_col)).alias("n_dropped"))


def with_detected_gender(df: DataFrame, text_col: str = "case_text",
                         out_col: str = "detected_gender") -> DataFrame:
    """T2 as a column: 'male' / 'female' / NULL."""
    return df.withColumn(out_col, X.detect_gender(text_col))


def variant_spec(ethnicities=None):
    """(variant_idx, gender, ethnicity, descriptor) in expansion order."""
    eths = list(ethnicities or S.ETHNICITIES)
    spec = []
    for g in S.GENDERS:
        for e in eths:
            spec.append((len(spec), g, e, S.GENDER_DESCRIPTORS[g]))
    for e in eths:
        spec.append((len(spec), "none", e, None))
    return spec


def _spec_array(spec):
    return F.array(*[
        F.struct(F.lit(i).cast("int").alias("variant_idx"), F.lit(g).alias("gender"),
                 F.lit(e).alias("ethnicity"), F.lit(d).cast("string").alias("descriptor"))
        for i, g, e, d in spec])


def expand_to_variants(df: DataFrame, *, ethnicities=None, fallback_prepend: bool = False,
                       text_col: str = "case_text") -> DataFrame:
    """Every case -> 2N gendered variants, plus N neutral ones when no gender word occurs.

    Output keeps all input columns (``case_text`` rewritten in place), then
    ``gender_male, gender_female, gender_none, ethnicity`` (replaced in place
    when already present) and ``variant_idx``.
    """
    eths = list(ethnicities or S.ETHNICITIES)
    if not eths:
        raise ValueError("ethnicities must not be empty")
    spec = variant_spec(eths)
    n2 = 2 * len(eths)
    t = F.col(text_col)

    # Per case, before the explode: gender, age phrase, injection template.
    per_case = (df
        .withColumn("_gender", X.detect_gender(t))
        .withColumn("_age", X.has_age_phrase(t))
        .withColumn("_tpl", F.when(F.col("_age") & (F.instr(t, _SLOT) == 0),
                                   X.age_template(t, _SLOT))))
    exploded = per_case.withColumn(
        "_v", F.explode(F.when(F.col("_gender").isNull(), _spec_array(spec))
                         .otherwise(_spec_array(spec[:n2]))))

    v = F.col("_v")
    label = F.when(v.descriptor.isNull(), v.ethnicity).otherwise(
        F.concat(v.ethnicity, F.lit(" "), v.descriptor))
    if fallback_prepend:
        no_age = F.concat(F.lit("Patient: "), label, F.lit(".\n"), t)
    else:
        no_age = t
    new_text = (F.when(F.col("_tpl").isNotNull(), F.replace(F.col("_tpl"), F.lit(_SLOT), label))
                .when(F.col("_age"), X.inject_demographics(t, v.ethnicity, v.descriptor))
                .otherwise(no_age))

    new_cols = {
        "gender_male": (v.gender == "male").cast("int"),
        "gender_female": (v.gender == "female").cast("int"),
        "gender_none": (v.gender == "none").cast("int"),
        "ethnicity": v.ethnicity,
        "variant_idx": v.variant_idx,
    }
    out = []
    for c in df.columns:
        if c == text_col:
            out.append(new_text.alias(c))
        elif c in new_cols:
            out.append(new_cols.pop(c).alias(c))
        else:
            out.append(F.col(c))
    out += [e.alias(c) for c, e in new_cols.items()]
    return exploded.select(*out)


def build_variants(cases: DataFrame, *, ethnicities=None, fallback_prepend: bool = False,
                   text_col: str = "case_text", observation: Observation | None = None) -> DataFrame:
    """Filter -> expand (mapping happens before, in ``operators.mapping``)."""
    kept = filter_ethnicity_mentions(cases, text_col, observation)
    return expand_to_variants(kept, ethnicities=ethnicities, fallback_prepend=fallback_prepend,
                              text_col=text_col)
