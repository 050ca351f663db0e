"""Porter stemmer (M.F. Porter, 1980) with the common NLTK-mode refinements.

The plain form of the rules, for one word on the driver or in a user's own
code; plans use the column expressions of ``stemming``, which share the rule
tables here and are tested against this function.
"""

from __future__ import annotations

from functools import lru_cache

_VOWELS = frozenset("aeiou")

# Irregular forms kept whole (fixed values of the NLTK-mode stemmer).
_IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "inning": "inning", "innings": "inning", "outing": "outing", "outings": "outing",
    "canning": "canning", "cannings": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    if c == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _m(stem: str) -> int:
    """Number of VC sequences in the stem."""
    n, prev_vowel = 0, False
    for i in range(len(stem)):
        v = not _cons(stem, i)
        if prev_vowel and not v:
            n += 1
        prev_vowel = v
    return n


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    """Ends consonant-vowel-consonant (the last not w, x, y); a whole word vowel-consonant counts too."""
    if len(w) == 2:
        return not _cons(w, 0) and _cons(w, 1)
    if len(w) < 3:
        return False
    return (_cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1)
            and w[-1] not in "wxy")


def _replace(w: str, rules, cond):
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return (stem + rep) if cond(stem) else w
    return w


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
          ("fulli", "ful"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
          ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
          "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _sorted(rules):
    return sorted(rules, key=lambda r: -len(r[0]))


_STEP2 = _sorted(_STEP2)
_STEP3 = _sorted(_STEP3)
_STEP4 = sorted(_STEP4, key=len, reverse=True)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.lower()
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    if len(w) <= 2:
        return w
    # Step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-3] + "i"
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # Step 1b
    again = False
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-3] + "i"
    elif w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _m(w) == 1 and _cvc(w):
            w += "e"
    # Step 1c
    if w.endswith("y") and len(w) > 2 and _cons(w, len(w) - 2):
        w = w[:-1] + "i"
    # Step 2-3; after "alli" the step is taken once more, "logi" counts its own l and o
    if w.endswith("alli") and _m(w[:-4]) > 0:
        w = w[:-2]
    if w.endswith("logi"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        w = _replace(w, _STEP2, lambda s: _m(s) > 0)
    w = _replace(w, _STEP3, lambda s: _m(s) > 0)
    # Step 4
    for suf in _STEP4:
        if w.endswith(suf):
            s = w[: len(w) - len(suf)]
            if _m(s) > 1 and (suf != "ion" or (s and s[-1] in "st")):
                w = s
            break
    # Step 5a
    if w.endswith("e"):
        s = w[:-1]
        if _m(s) > 1 or (_m(s) == 1 and not _cvc(s)):
            w = s
    # Step 5b
    if w.endswith("ll") and _m(w[:-1]) > 1:
        w = w[:-1]
    return w
