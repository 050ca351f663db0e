"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs,
schemes, digits and identifier cues.  A local parser for each kind expands
an anchor to both sides, up to the bounds of that kind, and validates it
(dots of an address, digit counts, Luhn and mod-97 checksums).  Parsers move
forward only and never try an anchor inside a span again, so a text takes
linear time.

Base kinds (email, ip, card, phone) equal the leftmost non-overlapping
matches of their fixed patterns, less those that fail validation.  The
expansion adds spans that these patterns lose: a card or phone inside a
longer run of digit groups, IBANs and account numbers after a cue, access
keys, and logins inside URLs.  Added spans never replace base ones.

Defined results: NULL and empty texts have no spans; offsets are code
points, end exclusive; texts of any length are read whole; repeated rows
stay repeated; columns other than id and text are ignored by ``find_spans``
and pass through ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "key", "login")
SLICE_BYTES = 8 << 20

# The contract's patterns, cut at their anchors (possessive, so that no digit is read twice).
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
DIGIT_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE_RUN = re.compile(r"[\x20().0-9-]*+")
DIGITS = re.compile(r"[0-9]++")

# Identifier cues and what may follow them.
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
AFTER_CUE = re.compile(r"(?:[\x20]?(?:number|nr|no|num|n°|#))?\.?[\x20:#=]{0,3}", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3}(?![A-Z0-9]))?")
ACCOUNT = re.compile(r"[0-9](?:[\x20-]?[0-9]){7,19}(?![0-9])")
KEY = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
LOGIN = re.compile(r"[^\s/?#@:]++:[^\s/?#@]++(?=@)")  # of any length; stops before the next scheme's slash


def _machine() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, "digit")
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("AKIA", "key")):
        found.add_word(word, kind)
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, "cue")
    found.make_automaton()
    return found


ANCHORS = _machine()


def luhn(digits: str) -> bool:
    twice = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _card(digits: str) -> bool:
    return 16 <= len(digits) <= 19 and luhn(digits)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _iban(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _cards_inside(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Cards made of whole digit groups inside a longer chain: one group, or four groups of four; no overlaps."""
    groups = [m.span() for m in DIGITS.finditer(text, start, end)]
    k = 0
    while k < len(groups):
        a, b = groups[k]
        four = groups[k:k + 4]
        if _card(text[a:b]):
            yield a, b
            k += 1
        elif len(four) == 4 and all(y - x == 4 for x, y in four) and luhn("".join(text[x:y] for x, y in four)):
            yield a, four[3][1]
            k += 4
        else:
            k += 1


def _phone_prefix(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The longest run of whole digit groups from the plus sign that is as long as a phone number."""
    total, best = 0, None
    for m in DIGITS.finditer(text, start + 1, end):
        total += m.end() - m.start()
        if total > 15:
            break
        if total >= 8:
            best = start, m.end()
    return best


def spans_of(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base, added): spans by kind, each in order of their start."""
    base: dict[str, list] = {k: [] for k in BASE}
    more: dict[str, list] = {k: [] for k in KINDS}
    past = dict.fromkeys((*KINDS, "run"), 0)  # where each parser may start again
    for last, anchor in ANCHORS.iter(text):
        if anchor == "digit":
            if last < past["run"]:
                continue
            past["run"] = DIGITS.match(text, last).end()
            if last >= past["card"] and (m := DIGIT_CHAIN.match(text, last)):
                a, b = m.span()
                past["card"] = b
                if _card("".join(DIGITS.findall(m[0]))):
                    base["card"].append((a, b))
                else:
                    more["card"].extend(_cards_inside(text, a, b))
            if last >= past["ip"] and (m := DOTTED.match(text, last)):
                past["ip"] = m.end()
                if all(map(_small, m[0].split("."))):
                    base["ip"].append(m.span())
        elif anchor == "at":
            if last < past["email"] or not (m := DOMAIN.match(text, last + 1)):
                continue
            a = last
            while a > past["email"] and text[a - 1] in LOCAL:
                a -= 1
            if a < last:
                past["email"] = m.end()
                base["email"].append((a, m.end()))
        elif anchor == "plus":
            if last < past["phone"] or not DIGITS.match(text, last + 1):
                continue
            run = PHONE_RUN.match(text, last + 2)[0].rstrip(" ().-")
            if len(run) < 2:
                continue
            end = past["phone"] = last + 2 + len(run)
            if 8 <= sum(map(len, DIGITS.findall(text, last, end))) <= 15:
                base["phone"].append((last, end))
            elif found := _phone_prefix(text, last, end):
                more["phone"].append(found)
        elif anchor == "scheme":
            if m := LOGIN.match(text, last + 1):
                more["login"].append(m.span())
        elif anchor == "key":
            a = last - 3
            if a >= past["key"] and not text[a - 1:a].isalnum() and (m := KEY.match(text, a)):
                past["key"] = m.end()
                more["key"].append(m.span())
        else:
            at = AFTER_CUE.match(text, last + 1).end()
            if at < past["account"]:
                continue
            if (m := IBAN.match(text, at)) and _iban(m[0]) or (m := ACCOUNT.match(text, at)):
                past["account"] = m.end()
                more["account"].append(m.span())
    return base, more


def _line(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans.get(kind, ())))


def mask(text: str) -> str:
    """The text with every span, base or added, replaced by its kind in brackets; overlapping spans become one."""
    base, more = spans_of(text)
    found = sorted((a, b, kind) for spans in (base, more) for kind, own in spans.items() for a, b in own)
    if not found:
        return text
    parts, done = [], 0
    a, b, kind = found[0]
    for x, y, other in [*found[1:], (len(text) + 1, 0, "")]:
        if x < b:
            b = max(b, y)
            continue
        parts += [text[done:a], f"[{kind.upper()}]"]
        done, a, b, kind = b, x, y, other
    return "".join([*parts, text[done:]])


def find_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_email, n_ip, n_card, n_phone`` (base), ``base_sha256``, ``spans`` (base and added), ``n_added``."""
    prepared(docs.sparkSession)
    names = [id_col, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                counts, digests, lines, added = [], [], [], []
                for text in part.column(1).to_pylist():
                    base, more = spans_of(text or "")
                    counts.append([len(base[k]) for k in BASE])
                    digests.append(hashlib.sha256(_line(base).encode()).hexdigest())
                    lines.append(_line({k: base.get(k, []) + more[k] for k in KINDS}))
                    added.append(sum(map(len, more.values())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)),
                     pa.array(digests, pa.string()), pa.array(lines, pa.string()), pa.array(added, pa.int64())], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with all spans masked; ``length_col``, where there is one, counts the new text's characters."""
    prepared(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, SLICE_BYTES):
                texts = [None if t is None else mask(t) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    masked = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        masked = masked.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return masked
