"""Periodic runs of words, found by constant-time longest common extensions on suffix trees.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are
equal) that is at least ``max(MIN_WORDS, 2 q)`` long and that no neighbouring
word extends with the same period.

1. A run makes some ``GRAM`` words recur nearby.  One sort of word-gram hashes
   per slice of documents finds stretches whose grams recur inside the same
   stretch, repeated until none falls away.  Every run lies in one stretch; a
   document without a stretch has no run, and the rest of its words need no
   tree.  (A chance equality of hashes only makes a stretch that holds no run.)
2. For each stretch Ukkonen's algorithm builds the suffix trees of the words
   and of the reversed words.  A depth-first tour gives the leaf order and the
   depth of the lowest common ancestor of neighbouring leaves; with a sparse
   table over these depths any two leaves have theirs in constant time (the
   Euler tour, kept only where it turns back up from a leaf).  Two leaves'
   depth is the longest common extension of their positions, to the right in
   the first tree and to the left in the second.
3. The longest Lyndon word that starts at a position ends before the next
   smaller suffix, for the reversed order of words before the next greater
   one.  Every run holds such a word of its period's length, so these two
   candidates a position are extended in both directions; those that reach two
   periods are the runs.

Documents are worked on alone inside map tasks: nothing shuffles, a hot source
or a group of copies is like any other rows.  Memory follows the longest
document.

Defined results: words are what stands between blanks (space, tab, line feed,
vertical tab, form feed, carriage return); NULL, empty and blank texts have no
words and no run; repeated rows each get their result; an empty table gives an
empty one; columns other than id and text are ignored, ids of any type and
NULL pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import BASE, mix
from .common import prepared, slices

MIN_WORDS = 12
GRAM = MIN_WORDS // 2       # words that a run of any period repeats at least
SLICE_BYTES = 4 << 20


class SuffixTree:
    """Ukkonen's suffix tree of a list of numbers from 1 up; 0 is put at its end.

    ``order``: suffix starts in lexicographic order; ``shared[k]``: depth of the
    lowest common ancestor of leaves ``k`` and ``k + 1``.
    """

    def __init__(self, numbers: list[int]):
        self.text = [*numbers, 0]
        self._build()
        self._tour()

    def _build(self) -> None:
        text = self.text
        n, width = len(text), max(text) + 1
        start, end, link, child = [0], [0], [0], {}
        node = edge = length = pending = 0
        for i, symbol in enumerate(text):
            above = 0  # inner node of this step that still lacks its suffix link
            pending += 1
            while pending:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if above:
                        link[above] = node
                        above = 0
                else:
                    first = start[below]
                    span = end[below] - first
                    if length >= span:
                        node, edge, length = below, edge + span, length - span
                        continue
                    if text[first + length] == symbol:
                        length += 1
                        if above:
                            link[above] = node
                        break
                    inner = len(start)
                    start += first, i
                    end += first + length, n
                    link += 0, 0
                    child[key] = inner
                    child[inner * width + symbol] = inner + 1
                    start[below] = first + length
                    child[inner * width + text[first + length]] = below
                    if above:
                        link[above] = inner
                    above = inner
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self._edges = start, end, child, width

    def _tour(self) -> None:
        start, end, child, width = self._edges
        del self._edges
        n, nodes = len(self.text), len(start)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        by_key = np.argsort(-keys)  # children of a node together, the greatest first, for a stack
        heads = -(keys[by_key] // width)
        kids = np.fromiter(child.values(), np.int64, len(child))[by_key].tolist()
        ids = -np.arange(nodes)
        first = np.searchsorted(heads, ids, "left").tolist()
        last = np.searchsorted(heads, ids, "right").tolist()
        depth = [0] * nodes
        parent = [0] * nodes
        order, shared, low = [], [], -1
        stack = kids[first[0]:last[0]]
        while stack:
            v = stack.pop()
            up = depth[parent[v]]
            if low < 0:
                low = up
            a, b = first[v], last[v]
            if a == b:
                order.append(start[v] - up)
                shared.append(low)
                low = -1
            else:
                depth[v] = up + end[v] - start[v]
                own = kids[a:b]
                for w in own:
                    parent[w] = v
                stack += own
        self.order = np.array(order)
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        self.shared = [np.array(shared[1:], np.int32)]
        while 2 << (len(self.shared) - 1) <= n - 1:
            half, row = 1 << (len(self.shared) - 1), self.shared[-1]
            self.shared.append(np.minimum(row[:-half], row[half:]))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at ``i`` and at ``j`` (different places)."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        out = np.zeros(len(low), np.int64)
        level = np.log2(high - low).astype(np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.shared[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one to the right with a smaller value; the end where there is none."""
    n = len(rank)
    found, stack = [n] * n, []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            found[stack.pop()] = i
        stack.append(i)
    return found


def runs_of(numbers: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """All runs of a sequence of numbers as rows (start, end, period), by start, then period."""
    numbers = np.unique(numbers, return_inverse=True)[1] + 1
    n = len(numbers)
    if n < min_words:
        return np.zeros((0, 3), np.int64)
    forth, back = SuffixTree(numbers.tolist()), SuffixTree(numbers[::-1].tolist())
    rank = forth.rank[:n]
    place = np.arange(n)
    start = np.concatenate([place, place])
    end = np.array(_next_smaller(rank.tolist()) + _next_smaller((-rank).tolist()))
    period = end - start
    near = 2 * period <= n
    start, end, period = start[near], end[near], period[near]
    left = back.extension(n - start, n - end)
    right = forth.extension(start, end)
    first, last = start - left, end + right
    long = last - first >= np.maximum(min_words, 2 * period)
    found = np.unique(np.stack([first, last, period], axis=1)[long], axis=0)
    least = np.ones(len(found), bool)  # of one stretch only the smallest period counts
    least[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[least]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def stretches(words: np.ndarray, owner: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Ranges of ``words`` (numbers, documents one after the other as ``owner`` says) outside which there is no run."""
    gram = min_words // 2
    n = len(words) - gram + 1
    if n <= 0:
        return []
    prints = np.zeros(n, np.uint64)
    scrambled = mix(words.astype(np.uint64) + np.uint64(1))
    for k in range(gram):
        prints = prints * BASE + scrambled[k:k + n]
    label = owner.astype(np.uint64)
    at = np.flatnonzero(owner[:n] == owner[gram - 1:])
    pieces = 0
    while len(at):
        own = mix(prints[at] ^ mix(label[at]))
        order = np.argsort(own)
        same = own[order[1:]] == own[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        left = np.sort(at[again])
        if not len(left):
            break
        # Grams that touch or overlap in one document make one stretch.
        new = np.r_[True, (np.diff(left) > gram) | (owner[left[1:]] != owner[left[:-1]])]
        first = np.flatnonzero(new)
        size = left[np.r_[first[1:], len(left)] - 1] + gram - left[first]
        number = np.cumsum(new) - 1
        wide = size[number] >= min_words
        left, number = left[wide], number[wide]
        edge = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])[:len(left)]
        if len(left) == len(at) and len(edge) == pieces:
            return list(zip(at[edge].tolist(), (at[np.r_[edge[1:], len(at)] - 1] + gram).tolist(), strict=True))
        at, pieces = left, len(edge)
        label[at] = number.astype(np.uint64)
    return []


def _slice_runs(texts: list[bytes], min_words: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """(text without the repeats of runs, runs) of every text."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = [t.split() for t in texts]  # bytes split at exactly the six blanks
    flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
    ends = np.cumsum([0, *map(len, words)])
    owner = np.repeat(np.arange(len(words)), np.diff(ends))
    found: dict[int, list[np.ndarray]] = {}
    for a, b in stretches(flat, owner, min_words):
        own = runs_of(flat[a:b], min_words)
        if len(own):
            k = int(owner[a])
            found.setdefault(k, []).append(own + np.array([a - ends[k], a - ends[k], 0]))
    for k, own in enumerate(words):
        if k not in found:
            yield b" ".join(own), np.zeros((0, 3), np.int64)
            continue
        runs = np.concatenate(found[k])
        depth = np.zeros(len(own) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
        yield b" ".join([own[i] for i in kept.tolist()]), runs


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: ``id, runs, collapsed``.

    ``runs`` are structs of ``start`` (word number), ``length`` and ``period``,
    by start, then period.  ``collapsed`` holds the words that no run repeats,
    that is all but those behind some run's first period, joined by blanks.
    """
    prepared(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).cast("string").alias("text"))
    schema = (f"id {texts.schema['id'].dataType.simpleString()}, "
              "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                data = [(t or "").encode() for t in part.column(1).to_pylist()]
                kept, runs = zip(*_slice_runs(data, min_words), strict=True) if data else ((), ())
                flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])],
                                                  names=["start", "length", "period"])
                ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, rows),
                                                  pa.array([k.decode() for k in kept], pa.string())],
                                                 names=["id", "runs", "collapsed"])

    return texts.mapInArrow(run, schema)
