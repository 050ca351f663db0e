"""Removal of long repeated byte strings with run-length indexes over repetitive text.

A byte goes if some ``LENGTH`` bytes that cover it also start earlier: in a
document with a smaller id, or in the same document further left.

1. Every window of ``LENGTH`` bytes belongs to its minimizer, the k-gram with
   the least hash in it, so equal windows have equal minimizers at equal
   places.  The windows of one minimizer occurrence form one context of at
   most ``LENGTH + W - 1`` bytes.  A map pass turns texts into (minimizer,
   context) hashes and settles repeats inside its own task at once.
2. Contexts meet by minimizer.  A context seen before is a repeat as a whole;
   this settles the inside of copies without looking at bytes again.
3. Where one minimizer has several contexts, these are the edges of repeats:
   highly repetitive text.  Their bytes are fetched, laid out in document
   order and indexed: suffix array, run-length Burrows-Wheeler transform,
   suffix samples at the run ends.  Matching statistics are streamed through
   the text from the samples, and windows whose match of ``LENGTH`` or more
   has an earlier occurrence are marked.
4. Marks meet their texts, which are cut.

A minimizer with more than ``hot`` contexts (a line that very many documents
share in different surroundings) would fill one task; its windows are spread
by their own hashes instead, which is as exact.  ``hot`` does not grow with
the corpus: the counting pass is repeated with a finer local threshold where
what it may have missed would matter, and the hot minimizers are a Bloom filter
of fixed size (spreading a minimizer that it takes for hot is exact too).

Defined results: NULL and empty texts have no bytes; documents with one id
are ordered by a checksum of their text and told apart by 64 bits of
checksum and hash; repeated rows (same id, same text) are one document whose
result each row gets; a NULL id comes first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import RangeHash, column_bytes, mix
from .common import prepared, slices, staged, text_or_empty
from .url_filter import bloom_blocks, bloom_hits

LENGTH = 100
GRAM = 24
W = LENGTH - GRAM + 1        # k-grams in a window
SLICE_BYTES = 1 << 20        # bytes hashed at once
FLUSH = 1 << 20              # contexts that a map task settles at once
BLOCK_BYTES = 1 << 20        # text of one index
HOT = 20_000                 # contexts of one minimizer that one task takes
HOT_LOCAL = 16               # occurrences within a flush from which a minimizer is reported as frequent
BLOOM_BLOCKS = 1 << 17
HOT_WORDS, HOT_PROBES = 1 << 20, 4   # 64-bit words of the filter of hot minimizers, bits of each
CONTEXT, MARK, WINDOW = 0, 1, 2   # kinds of row
FLOW = "kind int, pk long, ctx long, id long, tie long, start long, size int, lead int"
FLOW_SCHEMA = pa.schema([("kind", pa.int32()), ("pk", pa.int64()), ("ctx", pa.int64()), ("id", pa.int64()),
                         ("tie", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("lead", pa.int32())])


# ------------------------------------------------- 1: minimizers, contexts ----

def contexts(data: np.ndarray, ends: np.ndarray):
    """(minimizer, context hash, first byte, bytes, place of the minimizer, hasher) of all contexts; none crosses ``ends``."""
    n = len(data) - LENGTH + 1
    hashes = RangeHash(data)
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, hashes
    at = np.arange(len(data) - GRAM + 1)
    gram = hashes.of(at, at + GRAM)
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # ties: leftmost
    width = 1
    while 2 * width <= W:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < W:
        least = np.minimum(least[:width - W], least[W - width:])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.arange(n) + LENGTH <= np.repeat(ends[1:], np.diff(ends))[:n]
    first = np.flatnonzero(inside)
    if not len(first):
        return contexts(data[:0], ends)
    p = place[first]
    cut = np.flatnonzero((p[1:] != p[:-1]) | (first[1:] != first[:-1] + 1))
    a, b = first[np.append(0, cut + 1)], first[np.append(cut, len(first) - 1)]
    p = place[a]
    ctx = mix(hashes.of(a, b + LENGTH) + (p - a).astype(np.uint64))
    return gram[p], ctx, a, b - a + LENGTH, p - a, hashes


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, ends, ids, ties, offset) of slices of an ``id, tie, text`` batch; a long text comes in overlapping pieces."""
    for part in slices(batch, 2, SLICE_BYTES):
        data, ends = column_bytes(part.column(2))
        ids, ties = part.column(0).to_numpy(), part.column(1).to_numpy()
        if len(data) <= 2 * SLICE_BYTES:
            yield data, ends, ids, ties, 0
        else:  # one text; contexts cut at the pieces' bounds are settled by their bytes
            for k in range(0, len(data), SLICE_BYTES):
                piece = data[k:k + SLICE_BYTES + LENGTH - 1]
                yield piece, np.array([0, len(piece)]), ids, ties, k


def _settled(rows: list[np.ndarray], ordered: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(first contexts, marks of later ones) of (pk, ctx, id, tie, start, size, lead, kind) columns.

    ``ordered``: the rows come sorted by the first five columns.  Otherwise
    one quick sort brings equal contexts together and only these are put in
    document order.
    """
    if not ordered and len(rows[0]):
        order = np.argsort(mix(rows[0].view(np.uint64) + mix(rows[1].view(np.uint64))))
        pk, ctx = rows[0][order], rows[1][order]
        same = np.append(False, (pk[1:] == pk[:-1]) & (ctx[1:] == ctx[:-1]))
        several = np.flatnonzero(same | np.append(same[1:], False))
        run = np.cumsum(~same)[several]
        ids, tie, start = (rows[k][order[several]] for k in (2, 3, 4))
        order[several] = order[several][np.lexsort((start, tie, ids, run))]
        rows = [x[order] for x in rows]
    pk, ctx, ids, tie, start, size, lead, kind = rows
    same = np.append(False, (pk[1:] == pk[:-1]) & (ctx[1:] == ctx[:-1])) if len(pk) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(pk))))
    later = same & ((ids != ids[head]) | (tie != tie[head]) | (start != start[head]))
    return [x[~same] for x in rows], merged(ids[later], tie[later], start[later], size[later])


def merged(ids, tie, start, size) -> list[np.ndarray]:
    """Overlapping or touching spans of a document become one: (id, tie, start, size)."""
    order = np.lexsort((start, tie, ids))
    ids, tie, start, end = ids[order], tie[order], start[order], (start + size)[order]
    if not len(ids):
        return [ids, tie, start, end]
    new = np.append(True, (ids[1:] != ids[:-1]) | (tie[1:] != tie[:-1]))
    doc = np.cumsum(new)
    # The furthest end so far within the document: documents are kept apart by a large step.
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + doc * step) - doc * step
    new[1:] |= start[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return [ids[heads], tie[heads], start[heads], np.maximum.reduceat(end, heads) - start[heads]]


def _flow(kind, pk, ctx, ids, tie, start, size, lead) -> pa.RecordBatch:
    columns = [np.broadcast_to(np.asarray(kind), ids.shape).astype(np.int32), pk, ctx, ids, tie, start,
               size.astype(np.int32), lead.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FLOW_SCHEMA.types, strict=True)], schema=FLOW_SCHEMA)


def _marks(ids, tie, start, size) -> pa.RecordBatch:
    zero = np.zeros(len(ids), np.int64)
    return _flow(MARK, mix(ids.astype(np.uint64)).view(np.int64), zero, ids, tie, start, size, zero)


def _probes(pk: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word, mask) of each bit of the minimizers in the filter of hot ones."""
    found = []
    for k in range(HOT_PROBES):
        h = mix(pk.view(np.uint64) + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))
        found.append(((h >> np.uint64(6)).astype(np.int64) & (HOT_WORDS - 1), np.uint64(1) << (h & np.uint64(63))))
    return found


def _hot_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for word, mask in _probes(batch.column(0).to_numpy()):
            yield pa.RecordBatch.from_pydict({"word": pa.array(word), "mask": pa.array(mask.view(np.int64))})


def _windows(rows: list[np.ndarray], hashes: RangeHash, hot: np.ndarray) -> list[np.ndarray]:
    """Contexts of hot minimizers are replaced by their windows, each under its own hash."""
    pk, _, ids, tie, start, size, _, _ = rows
    is_hot = np.ones(len(pk), bool)
    for word, mask in _probes(pk):
        is_hot &= hot[word] & mask != 0
    n = size[is_hot] - LENGTH + 1
    index = np.repeat(np.flatnonzero(is_hot), n)
    first = start[index] + np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
    own = hashes.of(first, first + LENGTH)
    extra = [mix(own + np.uint64(1)).view(np.int64), own.view(np.int64), ids[index], tie[index], first,
             np.full(len(index), LENGTH), np.zeros(len(index), np.int64), np.full(len(index), WINDOW)]
    return [np.concatenate((x[~is_hot], y)) for x, y in zip(rows, extra, strict=True)]


def _emit(words: np.ndarray, masks: np.ndarray):
    """Map pass: contexts and marks of each task; the filter of hot minimizers comes as its words that have a bit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        hot = np.zeros(HOT_WORDS if len(words) else 0, np.uint64)
        hot[words] = masks

        def settled():
            first, marks = _settled([np.concatenate(c) for c in zip(*held, strict=True)])
            pk, ctx, ids, tie, start, size, lead, kind = first
            for k in range(0, len(pk), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield _flow(kind[part], pk[part], ctx[part], ids[part], tie[part], start[part], size[part], lead[part])
            if len(marks[0]):
                yield _marks(*marks)

        for batch in batches:
            for data, ends, ids, ties, offset in _pieces(batch):
                gram, ctx, a, size, lead, hashes = contexts(data, ends)
                if not len(a):
                    continue
                row = np.searchsorted(ends, a, side="right") - 1
                rows = [gram.view(np.int64), ctx.view(np.int64), ids[row], ties[row], a, size, lead, np.full(len(a), CONTEXT)]
                if len(hot):
                    rows = _windows(rows, hashes, hot)
                # From here on places count from the start of the text.
                rows[4] = rows[4] - ends[np.searchsorted(ends, rows[4], side="right") - 1] + offset
                held.append(rows)
                n += len(rows[0])
                if n >= FLUSH:
                    yield from settled()
                    held, n = [], 0
        if held:
            yield from settled()
    return run


def _frequent(local: int):
    """Minimizers that occur ``local`` times within a flush of a task, with their counts; and the number of flushes (minimizer NULL)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, flushes = [], 0, 0

        def counted():
            gram, ctx = (np.concatenate(x) for x in zip(*held, strict=True))
            # Copies of a context don't make a minimizer hot: they settle in their task.
            order = np.argsort(ctx)
            gram = gram[order[np.append(True, ctx[order[1:]] != ctx[order[:-1]])]]
            gram.sort()
            heads = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            count = np.diff(np.append(heads, len(gram)))
            often = count >= local
            return pa.RecordBatch.from_pydict({"pk": pa.array(gram[heads[often]].view(np.int64)), "n": pa.array(count[often])})

        for batch in batches:
            for data, ends, _, _, _ in _pieces(batch):
                gram, ctx, *_ = contexts(data, ends)
                if not len(gram):
                    continue
                held.append((gram, ctx))
                n += len(gram)
                if n >= FLUSH:
                    yield counted()
                    held, n, flushes = [], 0, flushes + 1
        if held:
            yield counted()
            flushes += 1
        yield pa.RecordBatch.from_pydict({"pk": pa.array([None], pa.int64()), "n": pa.array([flushes], pa.int64())})
    return run


def _hot_filter(rows: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, mask) of a filter of all minimizers of over ``hot`` contexts; at most ``HOT_WORDS`` of them."""
    local = HOT_LOCAL
    while True:
        counts = staged(rows.mapInArrow(_frequent(local), "pk long, n long").groupBy("pk").agg(F.sum("n").alias("n")), "frequent")
        flushes = counts.where("pk is null").agg(F.sum("n")).first()[0] or 0
        bound = hot - (local - 1) * flushes  # a flush leaves out local - 1 contexts of a minimizer at most
        if local == 1 or bound >= hot // 4:
            break
        local = max(1, hot // (2 * flushes))
    found = counts.where(f"pk is not null and n >= {bound}").select("pk").mapInArrow(_hot_bits, "word long, mask long")
    found = found.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    return found.column("word").to_numpy(), found.column("mask").to_numpy().view(np.uint64)


# ------------------------------------------- 2: contexts meet by minimizer ----

def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy() for c in batch.columns]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (pk, ctx, id, tie, start): marks of repeated contexts; first contexts of minimizers with several.

    A run of one minimizer may span batches; its open end is carried on.
    """
    carry: list[np.ndarray] | None = None

    def resolved(rows):
        kind, pk, ctx, ids, tie, start, size, lead = rows
        mark = kind == MARK
        if mark.any():
            yield _marks(ids[mark], tie[mark], start[mark], size[mark])
            kind, pk, ctx, ids, tie, start, size, lead = (x[~mark] for x in rows)
        if not len(pk):
            return
        first, marks = _settled([pk, ctx, ids, tie, start, size, lead, kind], ordered=True)
        if len(marks[0]):
            yield _marks(*marks)
        pk, ctx, ids, tie, start, size, lead, kind = first
        run = np.append(True, pk[1:] != pk[:-1])
        several = np.diff(np.append(np.flatnonzero(run), len(pk)))[np.cumsum(run) - 1] > 1
        ask = several & (kind == CONTEXT)
        if ask.any():
            yield _flow(CONTEXT, pk[ask], ctx[ask], ids[ask], tie[ask], start[ask], size[ask], lead[ask])

    for batch in batches:
        rows = _columns(batch)
        if carry is not None:
            rows = [np.concatenate(x) for x in zip(carry, rows, strict=True)]
        if not len(rows[0]):
            continue
        open_at = int(np.searchsorted(rows[1], rows[1][-1]))
        carry = [x[open_at:] for x in rows]
        yield from resolved([x[:open_at] for x in rows])
    if carry is not None:
        yield from resolved(carry)


# ---------------------------------------------------- 3: run-length index ----

class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a text with suffix samples at the ends of its runs.

    ``text`` holds positive symbols and 0 as separator.  Kept: for each run
    its symbol, its first row, and the suffixes of its first and last row.
    """

    def __init__(self, text: np.ndarray):
        self.text = text
        suffix = suffix_array(text)
        before = text[suffix - 1]
        before[suffix == 0] = -1  # a run of its own, so that the first position is sampled
        new = np.append(True, before[1:] != before[:-1])
        self.first_row = np.flatnonzero(new)
        self.symbol = before[self.first_row]
        self.last_row = np.append(self.first_row[1:], len(text)) - 1
        self.first_suffix, self.last_suffix = suffix[self.first_row], suffix[self.last_row]
        self._rows = suffix

    def __len__(self) -> int:
        return len(self.symbol)

    def count(self, pattern: np.ndarray) -> int:
        """Occurrences of a pattern, by backward search over the runs."""
        smaller = np.concatenate(([0], np.cumsum(np.bincount(self.text, minlength=258))))
        sizes = self.last_row - self.first_row + 1

        def rank(c: int, row: int) -> int:
            runs = np.searchsorted(self.first_row, row)
            own = self.symbol[:runs] == c
            total = int(sizes[:runs][own].sum())
            return total - max(0, int(self.last_row[runs - 1]) + 1 - row) * bool(runs and own[-1])

        low, high = 0, len(self.text)
        for c in pattern[::-1]:
            low, high = smaller[c] + rank(c, low), smaller[c] + rank(c, high)
            if low >= high:
                return 0
        return int(high - low)

    def match_lengths(self, starts: np.ndarray, most: int) -> np.ndarray:
        """Length of each suffix's match with the suffix one row above it, streamed from the run-end samples.

        Above a run's first suffix stands the one sampled at the end of the
        run before.  Inside a run both are preceded by one symbol, so from a
        text position to the next the suffix above moves along and the match
        shrinks by one.  Matches are compared symbol by symbol (up to
        ``most``) at the samples and at ``starts`` (the contexts), so that no
        capped value is carried far.
        """
        order = np.argsort(self.first_suffix)
        sample, above = self.first_suffix[order], np.append(-1, self.last_suffix[:-1])[order]
        at = np.union1d(sample, starts)
        near = np.searchsorted(sample, at, side="right") - 1
        other = np.where(above[near] < 0, -1, above[near] + at - sample[near])
        step = 16
        offsets = np.arange(step)
        padded = np.append(self.text, np.full(most + step, -1))
        length = np.zeros(len(at), np.int64)
        live = np.flatnonzero(other >= 0)
        while len(live):
            a = padded[(at[live] + length[live])[:, None] + offsets]
            b = padded[(other[live] + length[live])[:, None] + offsets]
            same = (a == b) & (a >= 0)
            run = np.where(same.all(axis=1), step, same.argmin(axis=1))
            length[live] += run
            live = live[(run == step) & (length[live] < most)]
        span = np.diff(np.append(at, len(self.text)))
        return np.repeat(length, span) - (np.arange(len(self.text)) - np.repeat(at, span))

    def earliest(self, starts: np.ndarray, length: int, most: int) -> np.ndarray:
        """For each position the least position whose next ``length`` symbols are the same."""
        match = self.match_lengths(starts, most)
        heads = np.flatnonzero(np.append(True, match[self._rows[1:]] < length))
        least = np.minimum.reduceat(self._rows, heads)
        found = np.empty(len(self.text), np.int64)
        found[self._rows] = np.repeat(least, np.diff(np.append(heads, len(self._rows))))
        return found


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling: the first seven symbols, then ranks of twice the length, until all differ.

    A rank is the first row of its group; only suffixes that share a group are sorted again.
    """
    n = len(text)
    key = np.zeros(n, np.int64)
    padded = np.concatenate((text.astype(np.int64) + 1, np.zeros(6, np.int64)))
    for k in range(7):
        key = key * 259 + padded[k:k + n]
    order = np.argsort(key)
    ranked = key[order]
    rows, width = np.arange(n), 7      # rows whose suffixes are not settled
    rank = np.empty(n + 1, np.int64)   # behind the end: less than all
    rank[n] = -1
    while True:
        new = np.append(True, ranked[1:] != ranked[:-1])
        first = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        rank[order[rows]] = first
        shared = ~(new & np.append(new[1:], True))
        rows = rows[shared]
        if not len(rows):
            return order
        suffix = order[rows]
        key = rank[suffix] * (n + 1) + rank[np.minimum(suffix + width, n)] + 1
        again = np.argsort(key)
        ranked, order[rows] = key[again], suffix[again]
        width *= 2


def repeated_spans(rows: list[tuple]) -> list[np.ndarray]:
    """Marks (id, tie, start, size) of windows that occur earlier; ``rows`` are (id, tie, start, bytes) contexts."""
    rows.sort(key=lambda r: r[:3])
    rows = [r for k, r in enumerate(rows) if not k or r[:3] != rows[k - 1][:3]]
    size = np.array([len(r[3]) for r in rows])
    starts = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int((size + 1).sum()), np.int64)
    body = np.ones(len(text), bool)
    body[starts + size] = False
    text[body] = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).astype(np.int64) + 1
    earliest = RunLengthIndex(text).earliest(starts, LENGTH, 2 * int(size.max()))
    n = np.maximum(size - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(rows)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[owner] + offset
    hit = earliest[at] < at
    owner, offset = owner[hit], offset[hit]
    ids, tie, start = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    return merged(ids[owner], tie[owner], start[owner] + offset, np.full(len(owner), LENGTH))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over ``pk, id, tie, start, body`` sorted by pk: blocks of whole minimizers, each indexed and streamed."""
    held, size, last = [], 0, None

    def done():
        marks = repeated_spans(held)
        return _marks(*marks)

    for batch in batches:
        for pk, ids, tie, start, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= BLOCK_BYTES and pk != last:
                yield done()
                held, size = [], 0
            held.append((ids, tie, start, body))
            size, last = size + len(body) + 1, pk
    if held:
        yield done()


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the asked contexts out of their texts: ``id, tie, text, asked`` to ``pk, id, tie, start, body``."""
    names = ["pk", "id", "tie", "start", "body"]
    types = [pa.int64()] * 4 + [pa.binary()]
    for batch in batches:
        for part in slices(batch, 2, SLICE_BYTES):
            out = [[] for _ in names]
            for ids, tie, text, asked in zip(*(c.to_pylist() for c in part.columns), strict=True):
                raw = text.encode()
                for a in asked:
                    for column, value in zip(out, (a["pk"], ids, tie, a["start"], raw[a["start"]:a["start"] + a["size"]]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)


# ------------------------------------------------------- 4: texts are cut ----

def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(what is left, maximal removed runs) of a text less the (start, size) spans."""
    kept, done, runs = [], 0, 0
    for start, size in sorted(spans):
        if start > done or not runs:
            kept.append(text[done:start])
            runs += 1
        done = max(done, start + size)
    return b"".join([*kept, text[done:]]), runs


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2, SLICE_BYTES):
            out = []
            for ids, tie, text, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                raw = text.encode()
                left, runs = cut(raw, [(s["start"], s["size"]) for s in spans])
                out.append((ids, tie, len(raw), len(raw) - len(left), runs, left))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=True)],
                names=["id", "tie", "n_bytes", "n_removed", "n_spans", "kept"])


def _document(rows: DataFrame) -> Column:
    return F.xxhash64("id", "tie")


def _tie(text: Column) -> Column:
    """64 bits that tell the texts of one id apart: the CRC-32, which orders them, above 32 bits of another hash."""
    high = F.shiftleft(F.crc32(text) - F.lit(1 << 31), 32)
    return high.bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit((1 << 32) - 1)))


def repeat_marks(rows: DataFrame, *, hot: int = HOT) -> DataFrame:
    """``id, tie, start, size``: spans to remove of ``id, tie, text`` rows (sorted out, may overlap)."""
    flow = rows.mapInArrow(_emit(*_hot_filter(rows, hot)), FLOW).repartition("pk").sortWithinPartitions("pk", "ctx", "id", "tie", "start")
    met = staged(flow.mapInArrow(_meet, FLOW), "met")

    asked = (met.where(F.col("kind") == CONTEXT).groupBy("id", "tie")
             .agg(F.collect_list(F.struct("pk", "start", "size")).alias("asked")).withColumn("document", _document(met)))
    texts = rows.withColumn("document", _document(rows))
    few = bloom_hits(texts, "document", bloom_blocks(asked, "document", BLOOM_BLOCKS), BLOOM_BLOCKS)
    few = few.groupBy("id", "tie").agg(F.first("text").alias("text"))  # repeated rows are one document
    bodies = (few.join(asked.drop("document"), ["id", "tie"]).select("id", "tie", "text", "asked")
              .mapInArrow(_bodies, "pk long, id long, tie long, start long, body binary"))
    edges = bodies.repartition("pk").sortWithinPartitions("pk").mapInArrow(_indexed, FLOW)
    edges = staged(edges.select("id", "tie", "start", "size"), "edges")
    return met.where(F.col("kind") == MARK).select("id", "tie", "start", "size").unionAll(edges)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept`` per row; ``kept`` is what is left of the text's bytes."""
    prepared(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
                       _tie(text).alias("tie"), text.alias("text"))
    marks = (repeat_marks(rows, hot=hot).groupBy("id", "tie")
             .agg(F.collect_list(F.struct("start", "size")).alias("spans")))
    marks = staged(marks.withColumn("document", _document(marks)), "marks")
    rows = rows.withColumn("document", _document(rows))
    # Texts that the filter of marked documents rules out stay where they are.
    blocks = staged(bloom_blocks(marks, "document", BLOOM_BLOCKS), "marked")
    filtered = bloom_hits(rows, "document", blocks, BLOOM_BLOCKS)
    touched = filtered.join(marks.drop("document"), ["id", "tie"], "left").select(
        "id", "tie", "text", F.coalesce("spans", F.array().cast("array<struct<start:long,size:int>>")).alias("spans"))
    done = touched.mapInArrow(_cut, "id long, tie long, n_bytes long, n_removed long, n_spans long, kept binary")
    clean = bloom_hits(rows, "document", blocks, BLOOM_BLOCKS, hits=False).select("id", "tie", F.octet_length("text").cast("long").alias("n_bytes"),
                                            F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
                                            F.col("text").cast("binary").alias("kept"))
    return done.unionAll(clean).select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("id"),
                                       "n_bytes", "n_removed", "n_spans", "kept")
