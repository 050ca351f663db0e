"""The text predicates of ``functions.text`` written for an RE2-based SQL engine.

Used only to build the independent SQL oracle.  RE2's ``\\b`` and ``\\d``
are ASCII-only, so word boundaries are spelled out with Unicode classes to
keep the semantics of the Spark (``(?U)``) expressions.
"""

from __future__ import annotations

from .. import schema as S
from .text import word_alternation

_WORD = r"[\pL\pN_]"
_NOT_WORD = r"[^\pL\pN_]"

SLOT_SQL = "\ue000\ue001"
AGE_SQL = r"(?i)(A|An) (\p{Nd}+)-year-old( patient)?"
_AGE_PATIENT_SQL = r"(?i)((?:A|An) \p{Nd}+-year-old) patient"


def _words_re(words) -> str:
    return f"(?i)(^|{_NOT_WORD})(?:{word_alternation(words)})({_NOT_WORD}|$)"


def ethnicity_mention_sql(col: str) -> str:
    return f"regexp_matches({col}, '{_words_re(S.ETHNICITY_KEYWORDS)}')"


def gender_sql(col: str) -> str:
    return (f"CASE WHEN regexp_matches({col}, '{_words_re(S.MALE_WORDS)}') THEN 'male' "
            f"WHEN regexp_matches({col}, '{_words_re(S.FEMALE_WORDS)}') THEN 'female' END")


def age_template_sql(col: str) -> str:
    inner = f"regexp_replace({col}, '{_AGE_PATIENT_SQL}', '\\1 patient', 'g')"
    return f"regexp_replace({inner}, '{AGE_SQL}', '\\1 \\2-year-old {SLOT_SQL}\\3', 'g')"


# Python str.split() whitespace, RE2 spelling.
WHITESPACE_SQL = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                  r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def tokens_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{WHITESPACE_SQL}'), lambda x: x <> '')"


# ------------------------------------------------------- Porter stems ----

def _kinds_sql(w: str) -> str:
    return (f"list_reduce(list_concat([''], string_split({w}, '')), lambda p, x: p || CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') "
            "OR (x = 'y' AND ends_with(p, 'c')) THEN 'v' ELSE 'c' END)")


def stem_ctes(words: str) -> str:
    """CTE chain over a relation ``words(token)``: ends in ``stems(token, stem)``.

    Words of up to three letters stay as they are.  One CTE a step; each has
    the word ``w`` and its pattern ``p`` of consonants and vowels.
    """
    from . import porter

    some, many = "contains({0}, 'vc')", "{0} LIKE '%vc%vc%'"
    cut = "left(w, len(w) - {0})"
    stem_p = "left(p, len(w) - {0})"
    short = "({0} = 'vc' OR (ends_with({0}, 'cvc') AND NOT regexp_matches({1}, '[wxy]$')))"

    def rules(pairs, measure):
        found = "regexp_extract(w, '(?:" + "|".join(a for a, _ in pairs) + ")$')"
        to = "CASE s " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + " END"
        return found, f"CASE WHEN s <> '' AND {measure.format(stem_p.format('len(s)'))} THEN {cut.format('len(s)')} || {to} ELSE w END"

    second, third = rules([r for r in porter._STEP2 if r[0] != "logi"], some), rules(porter._STEP3, some)
    fourth = rules([(a, "") for a in porter._STEP4], many)
    one = f"{some.format(stem_p.format(1))} AND NOT {many.format(stem_p.format(1))}"
    t, tp = cut.format("len(s)"), stem_p.format("len(s)")
    steps = [  # (suffix, new word)
        ("''", f"CASE WHEN ends_with(w, 'sses') THEN {cut.format(2)} "
               f"WHEN ends_with(w, 'ies') THEN CASE WHEN len(w) = 4 THEN {cut.format(1)} ELSE {cut.format(2)} END "
               f"WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut.format(1)} ELSE w END"),
        ("regexp_extract(w, '(?:ied|eed|ed|ing)$')",
         f"CASE s WHEN '' THEN w WHEN 'ied' THEN CASE WHEN len(w) = 4 THEN {cut.format(1)} ELSE {cut.format(2)} END "
         f"WHEN 'eed' THEN CASE WHEN {some.format(tp)} THEN {cut.format(1)} ELSE w END "
         f"ELSE CASE WHEN NOT contains({tp}, 'v') THEN w WHEN regexp_matches({t}, '(at|bl|iz)$') THEN {t} || 'e' "
         f"WHEN len({t}) > 1 AND right({t}, 1) = left(right({t}, 2), 1) AND ends_with({tp}, 'c') AND right({t}, 1) NOT IN ('l', 's', 'z') "
         f"THEN left({t}, len({t}) - 1) "
         f"WHEN {some.format(tp)} AND NOT {many.format(tp)} AND {short.format(tp, t)} THEN {t} || 'e' ELSE {t} END END"),
        ("''", f"CASE WHEN ends_with(w, 'y') AND len(w) > 2 AND left(right(p, 2), 1) = 'c' THEN {cut.format(1)} || 'i' ELSE w END"),
        ("''", f"CASE WHEN ends_with(w, 'alli') AND {some.format(stem_p.format(4))} THEN {cut.format(2)} ELSE w END"),
        (second[0], f"CASE WHEN ends_with(w, 'logi') THEN CASE WHEN {some.format(stem_p.format(3))} THEN {cut.format(1)} ELSE w END "
                    f"ELSE {second[1]} END"),
        third,
        (fourth[0], f"CASE WHEN s = 'ion' AND NOT regexp_matches(w, '[st]ion$') THEN w ELSE {fourth[1]} END"),
        ("''", f"CASE WHEN ends_with(w, 'e') AND ({many.format(stem_p.format(1))} OR ({one} AND NOT "
               f"{short.format(stem_p.format(1), cut.format(1))})) THEN {cut.format(1)} ELSE w END"),
        ("''", f"CASE WHEN ends_with(w, 'll') AND {many.format(stem_p.format(1))} THEN {cut.format(1)} ELSE w END"),
    ]
    out, last = [f"step0 AS (SELECT token, token AS w FROM {words})"], "step0"
    for k, (suffix, new) in enumerate(steps, 1):
        out.append(f"step{k} AS (SELECT token, {new} AS w FROM (SELECT token, w, {suffix} AS s, {_kinds_sql('w')} AS p FROM {last}))")
        last = f"step{k}"
    kept = "CASE token " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in porter._IRREGULAR.items()) + " END"
    out.append(f"stems AS (SELECT token, CASE WHEN len(token) <= 3 THEN token ELSE coalesce({kept}, w) END AS stem FROM {last})")
    return ",\n".join(out)
