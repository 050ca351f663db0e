"""Schemas, domains and the fixed vocabularies of the variant model.

Everything in the "fixed values" block must equal the values the original
tool uses, otherwise filtering, gender detection and injection give
different rows.  Nothing else in the package hard-codes vocabulary.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay identical for identical results)
# ---------------------------------------------------------------------------

# Default ethnicities, in expansion order.
ETHNICITIES = ["White", "Black", "Asian", "Hispanic", "Arab"]

# Genders used for the always-present variants, in expansion order.
GENDERS = ["male", "female"]

# Noun injected for each gender.
GENDER_DESCRIPTORS = {"male": "man", "female": "woman"}

# Valid answer letters.
VALID_ANSWER_IDX = ["A", "B", "C", "D"]

# The twelve columns every variant table must have.
REQUIRED_COLUMNS = [
    "case_id", "case_text", "question",
    "option_a", "option_b", "option_c", "option_d",
    "answer_idx", "gender_male", "gender_female", "gender_none", "ethnicity",
]

# A case that already mentions one of these (whole word, any case) is dropped.
ETHNICITY_KEYWORDS = [
    "White", "Black", "Asian", "Hispanic", "Arab",
    "African", "Latino", "Latina", "Caucasian",
    "Pacific Islander", "Native American",
    "Mexican", "Chinese", "Japanese", "Korean",
    "Indian", "Pakistani", "Vietnamese", "Filipino",
]

# Gender words (whole word, any case); male is tested first.
MALE_WORDS = ["man", "male", "he", "his", "him", "boy", "gentleman"]
FEMALE_WORDS = ["woman", "female", "she", "her", "girl", "lady"]

# Age phrase that receives the demographic descriptor:
# article, space, digits, "-year-old", optional " patient"; any case.
AGE_PHRASE = r"(A|An) (\d+)-year-old( patient)?"

# Option letters for integer answer codes 0..3 and for yes/no/maybe decisions.
COP_LETTERS = "ABCD"
DECISION_LETTERS = {"yes": "A", "no": "B", "maybe": "C"}
DECISION_OPTIONS = ("yes", "no", "maybe")

# Cramér's V interpretation bands (upper bounds, inclusive).
EFFECT_BANDS = [(0.10, "negligible"), (0.20, "weak"), (0.30, "moderate")]
EFFECT_BAND_TOP = "strong"

# BLEU: n-gram orders and the smoothing epsilon of "method 1".
BLEU_MAX_N = 4
BLEU_EPSILON = 0.1

# ---------------------------------------------------------------------------
# Spark schemas
# ---------------------------------------------------------------------------

CASE_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("case_text", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("option_a", T.StringType()),
    T.StructField("option_b", T.StringType()),
    T.StructField("option_c", T.StringType()),
    T.StructField("option_d", T.StringType()),
    T.StructField("answer_idx", T.StringType()),
])

VARIANT_COLUMNS = [
    T.StructField("gender_male", T.IntegerType()),
    T.StructField("gender_female", T.IntegerType()),
    T.StructField("gender_none", T.IntegerType()),
    T.StructField("ethnicity", T.StringType()),
    T.StructField("variant_idx", T.IntegerType()),
]

VARIANT_SCHEMA = T.StructType(CASE_SCHEMA.fields + VARIANT_COLUMNS)

GENDER_ONEHOT = ["gender_male", "gender_female", "gender_none"]
