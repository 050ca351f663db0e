"""Column expressions for the text operators (all JVM-side, codegen friendly).

Regex flags: ``(?iuU)`` = case-insensitive, Unicode case folding and
Unicode character classes, so ``\\b``, ``\\d`` and ``\\s`` behave like
Python's ``re`` on ``str`` patterns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

_FLAGS = "(?iuU)"


def _lit_regex(word: str) -> str:
    """Escape regex metacharacters in a literal word (Java and RE2 safe)."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", word)


def word_alternation(words) -> str:
    return "|".join(_lit_regex(w) for w in words)


def first_letter_guard(words) -> str:
    """Lookahead on the letters a word can start with.

    Most text positions fail this one-character test at once, so the
    alternation is only tried where a word can begin; the set of matches is
    unchanged (under the same flags a class member matches exactly what the
    literal first letter matches).
    """
    letters = sorted({w[0].lower() for w in words} | {w[0].upper() for w in words})
    return "(?=[" + "".join(_lit_regex(c) for c in letters) + "])"


def whole_word_regex(words) -> str:
    return _FLAGS + r"\b" + first_letter_guard(words) + r"(?:" + word_alternation(words) + r")\b"


ETHNICITY_MENTION_RE = whole_word_regex(S.ETHNICITY_KEYWORDS)
MALE_RE = whole_word_regex(S.MALE_WORDS)
FEMALE_RE = whole_word_regex(S.FEMALE_WORDS)
AGE_RE = _FLAGS + S.AGE_PHRASE
# Lower-cases the optional " patient" of every age phrase (first pass of the injection).
_AGE_PATIENT_RE = _FLAGS + r"((?:A|An) \d+-year-old) patient"

# Unicode whitespace exactly as Python's str.split() sees it.
WHITESPACE_CLASS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mentions_ethnicity(text) -> Column:
    """T1 predicate: true when the text names an ethnicity (NULL text -> false)."""
    return F.coalesce(col_(text).rlike(ETHNICITY_MENTION_RE), F.lit(False))


def detect_gender(text) -> Column:
    """T2: 'male' if a male word occurs, else 'female' if a female word occurs, else NULL."""
    t = col_(text)
    return (F.when(t.rlike(MALE_RE), F.lit("male"))
            .when(t.rlike(FEMALE_RE), F.lit("female")))


def has_age_phrase(text) -> Column:
    return F.coalesce(col_(text).rlike(AGE_RE), F.lit(False))


def _escape_replacement(c: Column) -> Column:
    # '$' and '\' are special in Java replacement strings.
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), r"\$", r"\\\$")


def inject_demographics(text, ethnicity, descriptor, fallback_prepend: bool = False) -> Column:
    """Rewrite every age phrase, or prepend a header when there is none.

    ``descriptor`` NULL means the gender-neutral variant (ethnicity only).
    Every match becomes ``{article} {age}-year-old {ethnicity}[ {descriptor}][ patient]``
    where the article and age keep their original spelling and " patient" is
    lower case.
    """
    t, eth, desc = col_(text), col_(ethnicity), col_(descriptor)
    label = F.when(desc.isNull(), eth).otherwise(F.concat(eth, F.lit(" "), desc))
    repl = F.concat(F.lit("$1 $2-year-old "), _escape_replacement(label), F.lit("$3"))
    normalised = F.regexp_replace(t, _AGE_PATIENT_RE, "$1 patient")
    injected = F.regexp_replace(normalised, F.lit(AGE_RE), repl)
    if not fallback_prepend:
        return injected
    header = F.concat(F.lit("Patient: "), label, F.lit(".\n"), t)
    return F.when(has_age_phrase(t), injected).otherwise(header)


def inject_gender(text, ethnicity, gender: str | None, fallback_prepend: bool = False) -> Column:
    """T3 for one gender: 'male', 'female' or None (neutral); any other is a ``ValueError``."""
    if gender is not None and gender not in S.GENDER_DESCRIPTORS:
        raise ValueError(f"no descriptor for gender {gender!r}; known: {', '.join(S.GENDER_DESCRIPTORS)}")
    descriptor = F.lit(None if gender is None else S.GENDER_DESCRIPTORS[gender]).cast("string")
    return inject_demographics(text, ethnicity, descriptor, fallback_prepend)


def derive_gender(male="gender_male", female="gender_female", none="gender_none") -> Column:
    """M5: one-hot columns -> 'male' / 'female' / 'none' / 'unknown' (first match wins)."""
    return (F.when(col_(male) == 1, "male")
            .when(col_(female) == 1, "female")
            .when(col_(none) == 1, "none")
            .otherwise("unknown"))


def derive_version(ethnicity="ethnicity", gender: Column | None = None) -> Column:
    """M6: '<ethnicity>_<gender>'; NULL ethnicity stays NULL."""
    return F.concat(col_(ethnicity), F.lit("_"), gender if gender is not None else derive_gender())


def performance(answer, gold="answer_idx") -> Column:
    """M7: 1 when the answer equals the gold letter, else 0 (NULL on either side -> 0)."""
    return F.coalesce(col_(answer) == col_(gold), F.lit(False)).cast("int")


def parse_answer(output) -> Column:
    """First stand-alone capital A-D (case-sensitive), else NULL."""
    return F.nullif(F.regexp_extract(col_(output), r"(?U)\b([A-D])\b", 1), F.lit(""))


def whitespace_tokens(text) -> Column:
    """Python ``str.split()`` as an array<string> (NULL text -> NULL)."""
    return F.filter(F.split(col_(text), WHITESPACE_CLASS + "+"), lambda x: x != F.lit(""))


def effect_size_band(v) -> Column:
    """Cramér's V -> interpretation band."""
    c = col_(v)
    out = None
    for bound, name in S.EFFECT_BANDS:
        out = F.when(c <= bound, name) if out is None else out.when(c <= bound, name)
    return F.when(c.isNull(), F.lit(None)).otherwise(out.otherwise(S.EFFECT_BAND_TOP))


def age_template(text, slot: str) -> Column:
    """Per-case template: every age phrase becomes ``{article} {age}-year-old {slot}[ patient]``.

    Each variant then only needs ``replace(template, slot, label)``.
    """
    normalised = F.regexp_replace(col_(text), _AGE_PATIENT_RE, "$1 patient")
    return F.regexp_replace(normalised, AGE_RE, "$1 $2-year-old " + slot + "$3")
