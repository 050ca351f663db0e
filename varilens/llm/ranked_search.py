"""Ranked lexical search: best-first document intervals bounded by range maxima of posting lists.

Every query is ranked against all documents by the exact integer score of
``weight`` and ``impacts`` (a BM25 form).

1. One pass cuts texts into terms and writes a forward index: per document
   its length and the query terms it holds with their counts.  Collection
   figures (documents, lengths, document frequencies) are sums over it.
2. Tasks gather blocks of at most ``BLOCK_POSTINGS`` postings.  In a block
   documents are numbered by length; each term has a posting list of impacts
   and a sparse table of range maxima over it.
3. A query's search of a block starts with the interval of all its documents.
   An interval's bound is the sum of its terms' maximal impacts in it, two
   table lookups a term.  The best interval is split at the document with the
   highest single impact: that document is scored exactly, the parts left and
   right get bounds of their own and wait in the queue.  The search ends when
   no bound reaches the score of the worst kept result; results are kept from
   block to block.  Intervals are taken from the queue in small batches so
   that numpy works on many at once.
4. Each task sends at most ``limit`` rows a query; these meet in two steps,
   first by (query, part), then by query.

Queries come to the tasks in blocks of bounded text, one search for each
block; documents never shuffle.

Defined results: NULL, empty or termless texts are no documents and, as
queries, have no results; every row of the query table is a query of its own,
also with an id or a text that repeats; equal scores rank by ascending
document id, a NULL id last, and rows alike in both in any order; repeated
documents count and rank each; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import prepared, slices, staged

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")   # on UTF-8: ASCII letters and digits, and all of non-ASCII
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
LIMIT = 10
QUERY_BYTES = 4 << 20       # query text broadcast at once
BLOCK_POSTINGS = 1 << 20
SLICE_BYTES = 8 << 20
CHUNK = 1 << 20             # bytes of a text that are cut into terms at once
MAX_BATCH = 64
PARTS = 32


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The text's terms in order, ASCII capitals lower-cased, in lists from bounded stretches of it."""
    data = (text or "").encode().lower()
    start = 0
    while start < len(data):
        gap = GAP.search(data, start + CHUNK)
        end = gap.start() if gap else len(data)
        yield TERM.findall(data, start, end)
        start = end


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def impacts(weights: np.ndarray, counts: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A term's share of a document's score, in whole numbers; 64-bit while 90 * length * documents stays below 2^63."""
    norm = 10 + (90 * lengths * documents) // total
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * norm))


class Block:
    """Posting lists with sparse tables over the documents of one block.

    ``lengths`` of its documents, and postings as (document, term, count).
    """

    def __init__(self, ids: list, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray,
                 weights: np.ndarray, documents: int, total: int):
        by_length = np.argsort(lengths, kind="stable")
        self.ids, self.n = [ids[i] for i in by_length], len(ids)
        place = np.empty(self.n, np.int64)
        place[by_length] = np.arange(self.n)
        self.keys = term.astype(np.int64) * self.n + place[doc]
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.doc = self.keys % self.n
        self.impact = impacts(weights[term[order]], count[order], lengths[doc[order]], documents, total)
        longest = int(np.bincount(term).max()) if len(term) else 0
        self.table = [np.arange(len(self.keys), dtype=np.int32)]
        while 2 << (len(self.table) - 1) <= longest:
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            left, right = last[:-half], last[half:]
            best = last.copy()  # the tail has no whole range and is never asked for
            best[:len(left)] = np.where(self.impact[left] >= self.impact[right], left, right)
            self.table.append(best)
        self.table = np.stack(self.table)
        self.level = np.zeros(longest + 1, np.int64)
        self.level[2:] = np.log2(np.arange(2, longest + 1)).astype(np.int64)

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the range maxima, document of the greatest of them) for posting ranges, one row an interval."""
        size = high - low
        level = self.level[size]
        safe = np.where(size > 0, low, 0)
        left = self.table[level, safe]
        right = self.table[level, np.where(size > 0, high - (1 << level), 0)]
        best = np.where(self.impact[left] >= self.impact[right], left, right)
        most = np.where(size > 0, self.impact[best], -1)
        row = np.arange(len(low))
        return np.maximum(most, 0).sum(axis=1), self.doc[best[row, most.argmax(axis=1)]]

    def search(self, query: np.ndarray, best: list[tuple], limit: int) -> int:
        """Put the block's documents into ``best`` (sorted (-score, id is NULL, id)); returns how many were scored."""
        first = query * self.n
        low, high = (np.searchsorted(self.keys, x)[None] for x in (first, first + self.n))
        held = (high > low)[0]
        first, low, high = first[held], low[:, held], high[:, held]
        if not len(first):
            return 0
        scored, serial, batch = 0, 0, 1
        queue: list[tuple] = []

        def enqueue(low: np.ndarray, high: np.ndarray) -> None:
            nonlocal serial
            least = -best[-1][0] if len(best) == limit else 1
            bound, split = self.bounds(low, high)
            for i in np.flatnonzero(bound >= max(least, 1)):
                heapq.heappush(queue, (-int(bound[i]), serial, int(split[i]), low[i], high[i]))
                serial += 1

        enqueue(low, high)
        while queue:
            least = -best[-1][0] if len(best) == limit else 1
            taken = []
            while queue and len(taken) < batch and -queue[0][0] >= least:
                taken.append(heapq.heappop(queue))
            if not taken:
                break
            split = np.array([t[2] for t in taken])
            low, high = (np.stack([t[k] for t in taken]) for k in (3, 4))
            at = np.searchsorted(self.keys, first + split[:, None])
            there = at < high
            there[there] = self.keys[at[there]] == (first + split[:, None])[there]
            score = np.where(there, self.impact[np.where(there, at, 0)], 0).sum(axis=1)
            scored += len(taken)
            for i in np.flatnonzero(score >= max(least, 1)):
                ident = self.ids[split[i]]
                insort(best, (-int(score[i]), ident is None, ident))
                del best[limit:]
            enqueue(np.concatenate([low, at + there]), np.concatenate([at, high]))
            batch = min(MAX_BATCH, 2 * batch)
        return scored


def _query_blocks(queries: DataFrame, id_col: str, text_col: str, max_bytes: int) -> Iterator[list[tuple]]:
    """(id, distinct terms) of the queries in blocks of bounded text; the driver holds one block."""
    block, size = [], 0
    for ident, text in queries.select(id_col, F.col(text_col).cast("string")).toLocalIterator():
        own = sorted({t for part in terms(text) for t in part})
        held = sum(map(len, own))
        if block and size + held > max_bytes:
            yield block
            block, size = [], 0
        if own:
            block.append((ident, own))
            size += held
    if block:
        yield block


def forward_index(texts: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``id, length, terms, counts`` of each row of ``id, text`` that has a term; terms are numbers in ``vocabulary``."""
    ident = texts.schema[0].dataType.simpleString()
    number = texts.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                kept, lengths, ends, found, counts = [], [], [0], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    held: Counter = Counter()
                    for some in terms(text):
                        held.update(some)
                    if held:
                        own = [(known[t], n) for t, n in held.items() if t in known]
                        kept.append(row)
                        lengths.append(held.total())
                        found += [t for t, _ in own]
                        counts += [n for _, n in own]
                        ends.append(len(found))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))],
                    names=["id", "length", "terms", "counts"])

    return texts.mapInArrow(run, f"id {ident}, length bigint, terms array<int>, counts array<bigint>")


def _searched(index: DataFrame, queries: list[tuple], weights: np.ndarray, documents: int, total: int, limit: int,
              item_kind: str, block_postings: int) -> DataFrame:
    ident = index.schema["id"].dataType.simpleString()
    content = index.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = content.value
        best: list[list[tuple]] = [[] for _ in queries]

        def block(parts: list[pa.RecordBatch]) -> None:
            ids = [x for p in parts for x in p.column(0).to_pylist()]
            flat = lambda k: np.concatenate([p.column(k).flatten().to_numpy() for p in parts])
            held = np.concatenate([p.column(2).value_lengths().to_numpy() for p in parts])
            lengths = np.concatenate([p.column(1).to_numpy() for p in parts])
            own = Block(ids, lengths, np.repeat(np.arange(len(ids)), held), flat(2), flat(3), weights, documents, total)
            for (_, query), kept in zip(queries, best, strict=True):
                own.search(query, kept, limit)

        parts, size = [], 0
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + block_postings - size, "right")) - 1)
                stop = min(stop, batch.num_rows)
                parts.append(batch.slice(start, stop - start))
                size += int(ends[stop] - ends[start])
                start = stop
                if size >= block_postings or start < batch.num_rows:
                    block(parts)
                    parts, size = [], 0
        if parts:
            block(parts)
        rows = [(k, queries[k][0], d, -s) for k, kept in enumerate(best) for s, _, d in kept]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)],
                                             names=["query", "item_id", "doc_id", "score"]).cast(out)

    schema = StructType.fromDDL(f"query bigint, item_id {item_kind}, doc_id {ident}, score bigint")
    out = to_arrow_schema(schema)
    return index.where(F.size("terms") > 0).mapInArrow(run, schema)


def ranked(docs: DataFrame, queries: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text",
           item_id: str = "item_id", item_text: str = "text", limit: int = LIMIT, query_bytes: int = QUERY_BYTES,
           block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``limit`` best documents of every query, best first."""
    spark = prepared(docs.sparkSession)
    kinds = docs.schema[doc_id].dataType.simpleString(), queries.schema[item_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).cast("string").alias("text"))
    found = []
    for block in _query_blocks(queries, item_id, item_text, query_bytes):
        vocabulary = sorted({t for _, own in block for t in own})
        index = staged(forward_index(texts, vocabulary), "search-index")
        documents, total = index.agg(F.count(F.lit(1)), F.sum("length")).first()
        if not documents:
            break
        held = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most the vocabulary
        weights = np.array([weight(documents, held.get(t, 0)) for t in range(len(vocabulary))], np.int64)
        number = {t: i for i, t in enumerate(vocabulary)}
        asked = [(ident, np.array([number[t] for t in own], np.int64)) for ident, own in block]
        rows = _searched(index, asked, weights, documents, total, limit, kinds[1], block_postings)
        for by in (["query", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))], ["query"]):
            best = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
            rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
        found.append(rows.select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score bigint")
    return reduce(DataFrame.unionAll, found)
