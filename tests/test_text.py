"""Text operators: hand rows (filter, gender, injection, expansion) and parity with Python ``re``."""
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varilens import schema as S
from varilens.functions import text as X
from varilens.operators import variants as V


def _one(spark, rows, expr, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_filter_ethnicity_mentions(spark):
    rows = [("WHITE matter",), ("_white",), ("Native  American",), ("Indian",), (None,), ("native american x",)]
    df = spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "id int, case_text string")
    kept = sorted(r.id for r in V.filter_ethnicity_mentions(df).collect())
    assert kept == [1, 2, 4]
    assert V.count_ethnicity_mentions(df).first().n_dropped == 3


def test_detect_gender(spark):
    got = _one(spark, [("he and she",), ("women",), ("the",), ("her",), ("HIS",), (None,)], X.detect_gender("t"))
    assert got == ["male", None, None, "female", "male", None]


def test_inject_keeps_article_and_existing_noun(spark):
    rows = [("An 80-year-old Patient came", "White", "woman"),
            ("Via 45-year-old x", "Asian", None),
            ("A 45-year-old man", "Black", "man"),
            ("no age here", "Arab", "man")]
    df = spark.createDataFrame(rows, "t string, e string, d string")
    got = [r[0] for r in df.select(X.inject_demographics("t", "e", "d")).collect()]
    assert got == ["An 80-year-old White woman patient came", "Via 45-year-old Asian x",
                   "A 45-year-old Black man man", "no age here"]
    pre = [r[0] for r in df.select(X.inject_demographics("t", "e", "d", fallback_prepend=True)).collect()]
    assert pre[3] == "Patient: Arab man.\nno age here"


def test_expand_counts_and_order(spark):
    df = spark.createDataFrame([("c1", "A 30-year-old man.", "q", "a", "b", "c", "d", "A"),
                                ("c2", "A 30-year-old patient.", "q", "a", "b", "c", None, "B")],
                               "case_id string, case_text string, question string, option_a string, option_b string, "
                               "option_c string, option_d string, answer_idx string")
    out = V.expand_to_variants(df).orderBy("case_id", "variant_idx").collect()
    c1 = [r for r in out if r.case_id == "c1"]
    c2 = [r for r in out if r.case_id == "c2"]
    assert len(c1) == 10 and len(c2) == 15
    assert [r.variant_idx for r in c2] == list(range(15))
    assert c1[0].case_text == "A 30-year-old White man man." and c1[0].gender_male == 1
    assert c2[5].case_text == "A 30-year-old White woman patient." and c2[5].gender_female == 1
    assert c2[10].case_text == "A 30-year-old White patient." and c2[10].gender_none == 1
    assert all(r.gender_male + r.gender_female + r.gender_none == 1 for r in out)
    assert df.columns == V.expand_to_variants(df).columns[:len(df.columns)]


def test_expand_slot_character_uses_regex_path(spark):
    t = "A 30-year-old patient  marker"
    df = spark.createDataFrame([("c", t)], "case_id string, case_text string")
    out = V.expand_to_variants(df).orderBy("variant_idx").first()
    assert out.case_text == "A 30-year-old White man patient  marker"


def test_parse_answer(spark):
    got = _one(spark, [("The answer is B.",), ("A patient",), ("none",), ("xA B",), (None,)], X.parse_answer("t"))
    assert got == ["B", "A", None, "B", None]


# ---- parity with Python re on generated text ----
_ALPHA = st.sampled_from(["a", "A", "An", "an", " ", "-", "year", "old", "patient", "Patient", "45", "man", "he",
                          "White", "white", "é", "K", "Indian", "x", "_", "her", "Native American", "\n", ".", "\u0130", "\u0131", "\u017f",
                          "\u212a", "Pakistan\u0131", "pat\u0131ent", "Bla\u212aK", "\u017fhe", "h\u0130s", "\u00c9"])
_TEXT = st.lists(_ALPHA, max_size=25).map("".join)

_PY_FILT = re.compile(r"\b(?:" + "|".join(re.escape(k) for k in S.ETHNICITY_KEYWORDS) + r")\b", re.I)
_PY_M = re.compile(r"\b(" + "|".join(S.MALE_WORDS) + r")\b", re.I)
_PY_F = re.compile(r"\b(" + "|".join(S.FEMALE_WORDS) + r")\b", re.I)
_PY_AGE = re.compile(S.AGE_PHRASE, re.I)


def _py_inject(text, eth, desc, prepend):
    lab = eth if desc is None else f"{eth} {desc}"
    res, n = _PY_AGE.subn(lambda m: f"{m.group(1)} {m.group(2)}-year-old {lab}{' patient' if m.group(3) else ''}", text)
    if n == 0 and prepend:
        res = f"Patient: {lab}.\n{text}"
    return res


@settings(max_examples=60, deadline=None)
@given(st.lists(_TEXT, min_size=1, max_size=12))
def test_python_re_parity(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", X.mentions_ethnicity("t").alias("m"), X.detect_gender("t").alias("g"),
                     X.inject_demographics("t", F.lit("Black"), F.lit("woman"), True).alias("inj")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.m == bool(_PY_FILT.search(t)), t
        exp_g = "male" if _PY_M.search(t) else ("female" if _PY_F.search(t) else None)
        assert r.g == exp_g, t
        assert r.inj == _py_inject(t, "Black", "woman", True), t


def test_map_options_dict_missing_vs_null(spark):
    from varilens.operators import mapping as M
    df = spark.createDataFrame([(0, "q", {"A": "a", "B": "b", "C": "c"}, "A", "a"),
                                (1, "q", {"A": "a", "B": "b", "C": "c", "D": None}, "B", "b")],
                               "idx int, question string, options map<string,string>, answer_idx string, answer string")
    rows = M.map_options_dict(df, index_col="idx").orderBy("case_id").collect()
    assert rows[0].case_id == "medqa_00000" and rows[0].option_d == "" and rows[1].option_d is None


def test_first_letter_guard_keeps_matches_on_documents(spark):
    from pyspark.sql import functions as F
    from varilens import schema as S
    from varilens.functions import text as X
    from tests.conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for words in (S.ETHNICITY_KEYWORDS, S.MALE_WORDS, S.FEMALE_WORDS):
        plain = "(?iuU)\\b(?:" + X.word_alternation(words) + ")\\b"
        guarded = X.whole_word_regex(words)
        diff = docs.where(F.col("text").rlike(plain) != F.col("text").rlike(guarded)).count()
        assert diff == 0, words[:3]


def test_unknown_gender_is_refused(spark):
    df = spark.createDataFrame([("A 30-year-old patient.",)], "t string")
    got = [df.select(X.inject_gender("t", F.lit("Asian"), g)).first()[0] for g in ("male", "female", None)]
    assert [("Asian man" in x, "Asian woman" in x) for x in got] == [(True, False), (False, True), (False, False)]
    with pytest.raises(ValueError):
        X.inject_gender("t", F.lit("Asian"), "other")
