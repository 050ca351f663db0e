"""Longest-common-subsequence length, bit-parallel (Allison-Dix / Crochemore et al.).

One pass over ``a`` with word-parallel operations on a bitset over ``b``;
Python ints are the bitsets, so cost is O(|a| * |b| / 64) machine words.
"""

from __future__ import annotations


def lcs_length(a, b) -> int:
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict = {}
    for i, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def lcs_length_dp(a, b) -> int:
    """Quadratic reference implementation (tests only)."""
    if not a or not b:
        return 0
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def lcs_lengths(b, others) -> list[int]:
    """``lcs_length`` of ``b`` with each of ``others`` (arrays of token numbers): the bit masks of ``b`` are made once."""
    masks: dict = {}
    for i, tok in enumerate(b.tolist()):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full, out = (1 << len(b)) - 1, []
    for a in others:
        v = full
        for mask in map(masks.get, a.tolist()):
            if mask is not None:
                u = v & mask
                v = ((v + u) | (v - u)) & full
        out.append(len(b) - v.bit_count())
    return out
