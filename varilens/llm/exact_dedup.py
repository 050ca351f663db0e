"""Exact deduplication by two passes over a Bloom filter with two-step counters.

Two texts are equal when they are identical without blanks (space, tab, line
feed, vertical tab, form feed, carriage return).

1. The first pass sets the bits of every text's hash in a filter that tells
   "set once" from "set again"; tasks fill their own filter and the parts are
   merged by bit range, so no task and no key gets more than its range.
2. The second pass asks the filter for every row.  A row with a bit that was
   set only once has no equal and passes straight through.  The others, the
   repeats and a few chance hits, meet by the SHA-256 of their text.

The filter takes ``BITS_PER_ROW`` bits a row and at most ``MAX_BITS``.  Beyond
that many rows it lets more rows through to the shuffle; the result does not
hang on it, as rows meet by their full digest.  What shuffles is a digest, a
length and an id, never a text (``deduplicated`` moves whole rows of possible
repeats, after each task has kept the best row of each group).  A group that
holds more than a thousandth of all rows is joined by broadcast; there are at
most a thousand of them.

Defined results: a NULL text counts as empty, so NULL, empty and blank texts
are one group; of equal texts the one with the most characters stays, then
the least id, a NULL id last; of rows that tie in all this exactly one stays;
an empty table gives an empty table; other columns are ignored by ``marked``
and kept by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import mix
from .common import prepared, staged, text_or_empty

HASHES = 4
BITS_PER_ROW = 16
MIN_BITS, MAX_BITS = 1 << 23, 1 << 28
RANGE_BITS = 1 << 15           # bits of one range, the unit that tasks merge
HOT_SHARE = 1000               # groups over 1/1000 of the rows are hot

BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: str = "text") -> Column:
    return F.translate(text_or_empty(text), BLANKS, "")


def filter_bits(rows: int) -> int:
    """Size of the filter: a power of two."""
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, rows * BITS_PER_ROW - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions, ``HASHES`` for each 64-bit hash (one row each)."""
    first = mix(hashes.astype(np.uint64))
    step = mix(first) | np.uint64(1)
    at = first[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]
    return (at & np.uint64(bits - 1)).astype(np.int64)


class TwoStepBits:
    """Bits that know whether they were set once or again."""

    def __init__(self, bits: int):
        self.once, self.again = (np.zeros(bits >> 3, np.uint8) for _ in range(2))

    @staticmethod
    def _set(bits: np.ndarray, at: np.ndarray) -> None:
        """Set the bits at ``at`` (sorted, distinct)."""
        if len(at):
            byte = at >> 3
            first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            bits[byte[first]] |= np.bitwise_or.reduceat(np.left_shift(1, at & 7).astype(np.uint8), first)

    @staticmethod
    def get(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def add(self, at: np.ndarray) -> None:
        at, times = np.unique(at, return_counts=True)
        self._set(self.again, at[(times > 1) | self.get(self.once, at)])
        self._set(self.once, at)

    def merge(self, once: np.ndarray, again: np.ndarray) -> None:
        self.again |= again | (self.once & once)
        self.once |= once


def _packed(bits: np.ndarray) -> bytes:
    """The bits of one range, as 16-bit offsets where these take less room."""
    if np.count_nonzero(bits) * 16 < len(bits):
        offsets = np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype("<u2").tobytes()
        if len(offsets) < len(bits):
            return offsets
    return bits.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    if len(packed) == RANGE_BITS >> 3:
        return np.frombuffer(packed, np.uint8)
    flags = np.zeros(RANGE_BITS, np.uint8)
    flags[np.frombuffer(packed, "<u2")] = 1
    return np.packbits(flags, bitorder="little")


def repeat_filter(hashes: DataFrame, rows: int) -> np.ndarray:
    """First pass over the one LONG column of ``hashes``: the bits set more than once, as bytes.

    At most ``MAX_BITS / 8`` bytes (32 MB) reach the driver.
    """
    bits, ranges = filter_bits(rows), filter_bits(rows) // RANGE_BITS
    schema = "part int, once binary, again binary"

    def batch(part, once, again):
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(once, pa.binary()),
                                           pa.array(again, pa.binary())], names=["part", "once", "again"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TwoStepBits(bits)
        for b in batches:
            own.add(positions(b.column(0).to_numpy(zero_copy_only=False), bits).ravel())
        once, again = (x.reshape(ranges, -1) for x in (own.once, own.again))
        used = np.flatnonzero(once.any(axis=1))
        for k in range(0, len(used), 1024):
            some = used[k:k + 1024]
            yield batch(some, [_packed(once[i]) for i in some], [_packed(again[i]) for i in some])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, TwoStepBits] = {}
        for b in batches:
            for i, once, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.setdefault(i, TwoStepBits(RANGE_BITS)).merge(_unpacked(once), _unpacked(again))
        for i, own in parts.items():
            if own.again.any():
                yield batch([i], [b""], [own.again.tobytes()])

    merged = (hashes.mapInArrow(fill, schema).repartitionById(min(ranges, 256), F.pmod("part", F.lit(min(ranges, 256))))
              .mapInArrow(merge, schema).select("part", "again"))
    again = np.zeros((ranges, RANGE_BITS >> 3), np.uint8)
    for part, own in merged.collect():
        again[part] = np.frombuffer(own, np.uint8)
    return again.ravel()


def may_repeat(df: DataFrame, hashes: Column, again: np.ndarray) -> Column:
    """Second pass: whether all bits of the row's hash were set more than once."""
    content = df.sparkSession.sparkContext.broadcast(again)

    @F.pandas_udf("boolean")
    def ask(h: pd.Series) -> pd.Series:
        return pd.Series(TwoStepBits.get(content.value, positions(h.to_numpy(), len(content.value) * 8)).all(axis=1))

    return ask(hashes)


def _order(chars: str, ident: str) -> list[Column]:
    """Sort keys, best row first."""
    return [(-F.col(chars)).alias("o_chars"), F.col(ident).isNull().alias("o_null"), F.col(ident).alias("o_id")]


def marked(docs: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, digest`` (SHA-256 of the text without blanks)."""
    spark = prepared(docs.sparkSession)
    prints = staged(docs.select(F.col(doc_id).alias("id"), F.unhex(F.sha2(normalised(doc_text), 256)).alias("digest"),
                                F.char_length(text_or_empty(doc_text)).cast("long").alias("chars"),
                                F.monotonically_increasing_id().alias("row")), "exact-prints")
    rows = prints.count()
    again = repeat_filter(prints.select(F.xxhash64("digest")), rows)
    asked = prints.withColumn("maybe", may_repeat(prints, F.xxhash64("digest"), again))
    alone = asked.where(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    maybe = staged(asked.where("maybe").drop("maybe"), "exact-maybe")
    groups = staged(maybe.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"),
                                                F.min(F.struct(*_order("chars", "id"), "row")).alias("best"))
                    .where("group_size > 1")
                    .select("digest", "group_size", F.col("best.o_id").alias("keep_id"), F.col("best.row").alias("keep_row")),
                    "exact-groups")
    hot = F.broadcast(groups.where(F.col("group_size") > rows / HOT_SHARE))
    cold = groups.where(F.col("group_size") <= rows / HOT_SHARE)
    met = maybe.join(hot, "digest").unionByName(
        maybe.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest", "left"))
    lonely = F.col("group_size").isNull()
    return alone.unionByName(met.select(
        "id", F.when(lonely, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (lonely | (F.col("keep_row") == F.col("row"))).alias("kept"), "digest"))


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts.

    Rows that surely have no equal never shuffle; of the others each task
    keeps the best row of a group before the groups meet.
    """
    spark = prepared(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"),
                       F.unhex(F.sha2(normalised(doc_text), 256)).alias("digest"),
                       F.char_length(text_or_empty(doc_text)).alias("chars"), F.col(doc_id).alias("id"))
    prints = staged(rows.select(F.xxhash64("digest").alias("h")), "exact-hashes")
    again = repeat_filter(prints, prints.count())
    asked = rows.withColumn("maybe", may_repeat(rows, F.xxhash64("digest"), again))
    best = (asked.where("maybe").groupBy("digest")
            .agg(F.min_by("record", F.struct(*_order("chars", "id"))).alias("record")).select("record"))
    return asked.where(~F.col("maybe")).select("record").unionAll(best).select("record.*")
