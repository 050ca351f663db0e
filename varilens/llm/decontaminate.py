"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` normalised characters may occur in a document with up to
``k = floor(rate * m)`` edits.  It is split into ``k + 1`` pieces: at least
one of them then occurs unchanged.  An Aho-Corasick automaton of all pieces
finds these hits; every hit is verified with Myers' bit-parallel edit
distance.  Verification climbs a binary tree over the pieces: a node over
``c`` pieces may hold ``c - 1`` edits (if both children broke their budgets,
the parent would break its own), so a chance hit is refuted by a few
characters beside it and no true match is lost.

Hits whose climbs would cost more than one pass of the whole item over all
stretches of text that they point at (a repetitive document, or an item whose
pieces are alike) are verified by that one pass instead; it starts when the
climbs have read as much text as it would.  So a document costs an item at
most two passes, and a text of any kind is linear in its length.

The items come to the tasks in blocks of bounded size, one map-only pass over
the documents for each block; documents are never shuffled or collected.

Defined results: texts are lower-cased and every run of non-word characters
is one blank; NULL, empty or wordless documents and items match nothing;
items too short for an edit match only whole and at word bounds; items with
equal texts are reported each; a match is the one of least distance, then
with the leftmost end; repeated documents each get their rows; empty
tables give no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, slices

GAP = re.compile(r"\W+")
RATE = 0.08                # edits per character of an item
BLOCK_BYTES = 4 << 20      # item text broadcast at once
SLICE_BYTES = 8 << 20
CLIMB = 32                 # characters that a climb reads at least


def normalised(text: str | None) -> str:
    return GAP.sub(" ", (text or "").lower()).strip()


class Node:
    """Characters ``[start, end)`` of an item that may hold ``budget`` edits."""

    def __init__(self, item: Item, first: int, last: int):
        self.item, self.budget = item, last - first - 1
        self.start, self.end = item.cuts[first], item.cuts[last]
        self.parent: Node | None = None
        if self.budget:
            mid = (first + last) // 2
            for half in (Node(item, first, mid), Node(item, mid, last)):
                half.parent = self
        else:
            item.leaves.append(self)
        self._masks: tuple[dict, dict] | None = None

    def masks(self) -> tuple[dict, dict]:
        """Positions of each character as bits, forward and reversed."""
        if self._masks is None:
            forward, back = {}, {}
            own = self.item.text[self.start:self.end]
            for k, c in enumerate(own):
                forward[c] = forward.get(c, 0) | 1 << k
                back[c] = back.get(c, 0) | 1 << len(own) - 1 - k
            self._masks = forward, back
        return self._masks


class Item:
    def __init__(self, ident, text: str, rate: float):
        self.ident, self.text = ident, text
        self.budget = min(int(rate * len(text)), len(text) - 1)
        n = self.budget + 1
        self.cuts = [len(text) * p // n for p in range(n + 1)]
        self.leaves: list[Node] = []
        self.root = Node(self, 0, n)


def myers(masks: dict, m: int, text: str, free_start: bool = True) -> list[int]:
    """Edit distance of a pattern of ``m`` characters to the part of ``text`` that ends at each place.

    The part starts anywhere (``free_start``) or at the start of ``text``.
    """
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score, found = full, 0, m, []
    for c in text:
        eq = masks.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(zero | plus)), zero & plus
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        found.append(score)
        up = (up << 1 | (not free_start)) & full
        down = (down << 1) & full
        plus, minus = down | (full & ~(zero | up)), up & zero
    return found


def best_in(node: Node, text: str, low: int, high: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the node's best occurrence inside ``text[low:high]``, the leftmost end; None beyond its budget."""
    k, m = node.budget, node.end - node.start
    scores = myers(node.masks()[0], m, text[low:high])
    if not scores or (best := min(scores)) > k:
        return None
    end = low + scores.index(best) + 1
    begin = max(0, end - m - k)
    back = myers(node.masks()[1], m, text[begin:end][::-1], free_start=False)
    return best, end - 1 - back.index(best) if best in back else end, end


def best_place(node: Node, text: str, at: int) -> tuple[int, int, int] | None:
    """The node's best occurrence with its start near ``at``."""
    return best_in(node, text, max(0, at - node.budget), at + node.end - node.start + node.budget)


class Candidates:
    """Where one item may be in one text: hits to climb from, and the stretches of text that hold all their matches."""

    def __init__(self):
        self.hits: set[tuple[Node, int]] | None = set()
        self.stretches: list[list[int]] = []
        self.length = 0

    def add(self, leaf: Node, at: int, first: int, last: int) -> None:
        """A piece at ``at`` puts the item's start between ``first`` and ``last``, give or take its budget."""
        item = leaf.item
        low, high = max(0, first - item.budget), last + len(item.text) + item.budget
        if self.stretches and low <= self.stretches[-1][1]:
            end = self.stretches[-1]
            self.length += max(0, end[0] - low) + max(0, high - end[1])
            end[0], end[1] = min(low, end[0]), max(high, end[1])
        else:
            self.stretches.append([low, high])
            self.length += high - low
        if self.hits is not None:
            if first == last:
                self.hits.add((leaf, first))
            if first < last or len(self.hits) * CLIMB > max(self.length, 64 * CLIMB):
                self.hits = None  # so dense that one pass over the stretches is cheaper

    def best(self, item: Item, text: str) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best match: the least distance, then the leftmost end."""
        found, work, failed = [], 0, set()
        for leaf, origin in sorted(self.hits or (), key=lambda h: (h[1], h[0].start)):
            node, hit = leaf.parent, None
            while node is not None and (node, origin) not in failed:
                work += node.end - node.start + 2 * node.budget
                hit = best_place(node, text, max(0, origin + node.start))
                if hit is None:
                    failed.add((node, origin))
                    break
                node = node.parent
            if node is None:
                found.append(hit)
                failed.add((item.root, origin))  # settled: other pieces at this origin need no climb
            if work > self.length:
                break
        else:
            if self.hits is not None:
                return min(found, key=lambda h: (h[0], h[2]), default=None)
        stretches: list[list[int]] = []
        for low, high in sorted(self.stretches):
            if stretches and low <= stretches[-1][1]:
                stretches[-1][1] = max(high, stretches[-1][1])
            else:
                stretches.append([low, high])
        return min(filter(None, (best_in(item.root, text, low, high) for low, high in stretches)),
                   key=lambda h: (h[0], h[2]), default=None)


class Matcher:
    def __init__(self, items: list[tuple], rate: float = RATE):
        pieces: dict[str, dict[Item, list[Node]]] = {}
        for ident, text in items:
            if text:
                for leaf in (item := Item(ident, text, rate)).leaves:
                    pieces.setdefault(text[leaf.start:leaf.end], {}).setdefault(item, []).append(leaf)
        self.machine = ahocorasick.Automaton()
        for piece, held in pieces.items():
            self.machine.add_word(piece, (len(piece), [(item, leaves[0], leaves[0].start, leaves[-1].start)
                                                       for item, leaves in held.items()]))
        if pieces:
            self.machine.make_automaton()
        self.empty = not pieces

    def matches(self, text: str) -> dict[Item, tuple[int, int, int]]:
        """Best match of every item found: (distance, start, end); of equal distances the leftmost end."""
        found: dict[Item, tuple[int, int, int]] = {}
        maybe: dict[Item, Candidates] = {}
        if self.empty or not text:
            return found
        for last, (size, held) in self.machine.iter(text):
            at = last + 1 - size
            for item, leaf, first, final in held:
                if item.budget == 0:
                    if item not in found and (not at or text[at - 1] == " ") and (last + 1 == len(text) or text[last + 1] == " "):
                        found[item] = 0, at, last + 1
                    continue
                if (own := maybe.get(item)) is None:
                    own = maybe[item] = Candidates()
                own.add(leaf, at, at - final, at - first)
        for item, own in maybe.items():
            if (hit := own.best(item, text)) is not None:
                found[item] = hit
        return found


def _blocks(bench: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Normalised items in blocks of bounded text; the driver holds one block and one partition of items."""
    block, size = [], 0
    for ident, text in bench.select(id_col, F.col(text_col).cast("string")).toLocalIterator():
        text = normalised(text)
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        if text:
            block.append((ident, text))
            size += len(text)
    if block:
        yield block


def benchmark_matches(docs: DataFrame, bench: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", rate: float = RATE,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that it holds: ``doc_id, item_id, distance, match_start, match_end``.

    The span is in characters of the normalised text.  Every document is
    matched whole against every item.
    """
    spark = prepared(docs.sparkSession)
    doc_kind, item_kind = docs.schema[doc_id].dataType, bench.schema[item_id].dataType
    schema = (f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, "
              "distance int, match_start long, match_end long")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).cast("string").alias("text"))

    def scan(content):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(content.value, rate)
            for batch in batches:
                for part in slices(batch, 1, SLICE_BYTES):
                    rows = [(row, item.ident, d, a, e) for row, text in enumerate(part.column(1).to_pylist())
                            for item, (d, a, e) in matcher.matches(normalised(text)).items()]
                    if rows:
                        row, ident, d, a, e = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(row)), pa.array(ident), pa.array(d, pa.int32()),
                             pa.array(a, pa.int64()), pa.array(e, pa.int64())],
                            names=["doc_id", "item_id", "distance", "match_start", "match_end"])
        return texts.mapInArrow(run, schema)

    passes = [scan(spark.sparkContext.broadcast(b)) for b in _blocks(bench, item_id, item_text, block_bytes)]
    if not passes:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, passes)


def decontaminated(docs: DataFrame, bench: DataFrame, *, doc_text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows whose text holds an item; rows and columns pass through unchanged, without a shuffle."""
    spark = prepared(docs.sparkSession)
    at = docs.columns.index(doc_text)

    def clean(content):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(content.value, rate)
            for batch in batches:
                for part in slices(batch, at, SLICE_BYTES):
                    keep = [not matcher.matches(normalised(text)) for text in part.column(at).to_pylist()]
                    yield part.filter(pa.array(keep, pa.bool_()))
        return run

    for block in _blocks(bench, item_id, item_text, block_bytes):
        docs = docs.mapInArrow(clean(spark.sparkContext.broadcast(block)), docs.schema)
    return docs
