"""A feature-hashing text embedder (stand-in for a sentence encoder in tests and queries).

White-space tokens are hashed by MD5 into ``dim`` buckets with a sign, all in
built-in functions; a text without tokens is the zero vector, NULL stays NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import whitespace_tokens


RANGE = 8       # buckets that share one look at the tokens


def hashing_embedder(dim: int = 64):
    """A function from a text column to its vector: hex digits 1-8 of a token's hash are its bucket, digit 9 its sign."""
    def embed(text: Column) -> Column:
        signed = F.transform(F.transform(whitespace_tokens(text), lambda t: F.md5(t)), lambda h: F.struct(
            F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim)).alias("at"),
            F.when(F.substring(h, 9, 1) < "8", F.lit(-1.0)).otherwise(F.lit(1.0)).alias("sign")))

        def total(of: Column, d: Column) -> Column:
            return F.aggregate(F.filter(of, lambda x: x["at"] == d), F.lit(0.0), lambda s, x: s + x["sign"])

        # Hashed once a token, then dealt twice: a range of buckets looks only at its own tokens.
        ranges = _bound(signed, lambda tokens: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1), F.lit(RANGE)),
            lambda low: _bound(F.filter(tokens, lambda x: (x["at"] >= low) & (x["at"] < low + RANGE)), lambda of: F.transform(
                F.sequence(low, F.least(low + RANGE, F.lit(dim)) - 1), lambda d: total(of, d)))))
        return F.when(text.isNotNull(), F.flatten(ranges))
    return embed


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)
