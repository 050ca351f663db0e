"""Scores of the text pairs of a group, for rows that Spark has sorted by group.

The operators deal the texts of a case into blocks of bounded size and meet
every two blocks in one group (``operators.overlap.block_pairs``); the helpers
here take the Arrow batches of such rows and hold one group, or a few small
ones, at a time.  Rows of side 0 are a block that meets itself; where two
blocks meet, side 1 comes before side 2 and only the pairs across are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .. import schema as S
from .lcs import lcs_lengths

CHUNK_TOKENS, CHUNK_PAIRS = 200_000, 1_000_000      # what is scored together, unless one group is larger
SLICE = 2_000_000                                   # pairs of gram entries expanded at a time


def whole_groups(batches, key: str = "g"):
    """``(table, starts)``: some whole groups and where each begins, out of batches sorted by ``key``."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        cuts = pc.indices_nonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))).to_numpy() + 1
        if held and held[-1].column(key)[-1].as_py() != keys[0].as_py():
            cuts = np.concatenate([[0], cuts])
        if len(cuts):
            last = int(cuts[-1])
            if held or last:
                yield _chunks(held + [batch.slice(0, last)], key)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield _chunks(held, key)


def _chunks(parts: list, key: str):
    table = pa.Table.from_batches([b for b in parts if b.num_rows]).combine_chunks()
    keys = table.column(key).chunk(0)
    cuts = pc.indices_nonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))).to_numpy() + 1
    return table, np.concatenate([[0], cuts]).astype(np.int64)


def _lists(column) -> tuple:
    """Flat values and lengths of a list column without NULL rows."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten(), pc.list_value_length(a).to_numpy(zero_copy_only=False).astype(np.int64)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[0], first[0] + 1, ... (size[0] of them), then those from first[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _cuts(starts: np.ndarray, rows: int, side: np.ndarray, tokens: np.ndarray):
    """Neighbouring groups that are scored together: ``(first group, behind the last)``."""
    ends = np.append(starts[1:], rows)
    second = np.add.reduceat((side == 2).astype(np.int64), starts)
    pairs = np.where(side[starts] > 0, (ends - starts - second) * second, (ends - starts) ** 2)
    words = np.add.reduceat(tokens, starts)
    begin, t, p = 0, 0, 0
    for k in range(len(starts)):
        if k > begin and (t + words[k] > CHUNK_TOKENS or p + pairs[k] > CHUNK_PAIRS):
            yield begin, k
            begin, t, p = k, 0, 0
        t, p = t + words[k], p + pairs[k]
    yield begin, len(starts)


def bleu_sums(table: pa.Table, starts: np.ndarray):
    """Batches ``case_id, cross``: per group the summed BLEU over its response pairs of different texts.

    A row is a text with its tokens, its ``m`` copies and their indexes
    ``at``, the least ``tid``.  The earlier response is the reference, so a
    pair of texts counts in each direction as often as its copies stand in
    that order.
    """
    side = table.column("side").to_numpy().astype(np.int64)
    sizes = pc.list_value_length(table.column("tokens").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in _cuts(starts, table.num_rows, side, sizes):
        lo, hi = int(starts[a]), int(starts[b]) if b < len(starts) else table.num_rows
        part = table.slice(lo, hi - lo)
        cross = _bleu_chunk(part, starts[a:b] - lo, side[lo:hi])
        firsts = part.column("case_id").combine_chunks().take(pa.array(starts[a:b] - lo))
        yield pa.RecordBatch.from_arrays([firsts, pa.array(cross)], names=["case_id", "cross"])


def _bleu_chunk(part: pa.Table, starts: np.ndarray, side: np.ndarray) -> np.ndarray:
    n, groups = part.num_rows, len(starts)
    group = np.repeat(np.arange(groups), np.diff(np.append(starts, n)))
    words, length = _lists(part.column("tokens"))
    across, second = side[starts] > 0, (side == 2).astype(np.int64)
    width = np.add.reduceat(second, starts)
    own = np.bincount(group, minlength=groups) - width                # rows before side 2
    width = np.where(across, width, own)
    offset = np.concatenate([[0], np.cumsum(own * width)])
    local = np.arange(n) - starts[group] - second * own[group]

    word = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    unit = np.repeat(np.arange(n), length)
    behind = np.repeat(np.cumsum(length), length) - np.arange(len(word))      # tokens from here to the end of the text
    vocabulary = np.int64(word.max() + 1 if len(word) else 1)
    matches, gram, at = [], group[unit], np.arange(len(word))
    for size in range(1, S.BLEU_MAX_N + 1):
        keep = behind[at] >= size
        gram, at = gram[keep], at[keep]
        gram = np.unique(gram * vocabulary + word[at + size - 1], return_inverse=True)[1].astype(np.int64)
        matches.append(_clipped_matches(gram, unit[at], n, second, group, across, offset, width, local))

    pair = np.flatnonzero(matches[0])
    g = np.searchsorted(offset, pair, side="right") - 1
    rest = pair - offset[g]
    i = starts[g] + rest // width[g]
    j = starts[g] + rest % width[g] + np.where(across[g], own[g], 0)
    tid, m = part.column("tid").to_numpy(), part.column("m").to_numpy()
    swap = tid[i] > tid[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    every = m[i] * m[j]
    forth = every.astype(np.float64)
    told = np.flatnonzero((every > 1) & (length[i] != length[j]))
    if len(told):
        index, _ = _lists(part.column("at"))
        index = index.to_numpy()
        begin = np.concatenate([[0], np.cumsum(m)])
        x = np.where(m[i[told]] > 1, i[told], j[told])
        y = np.where(m[i[told]] > 1, j[told], i[told])
        order = np.argsort(x, kind="stable")
        for own_pairs in np.split(order, np.flatnonzero(np.diff(x[order])) + 1):
            t, others = x[own_pairs[0]], y[own_pairs]
            marks = np.sort(index[begin[t]:begin[t + 1]])
            seen = np.searchsorted(marks, index[_ranges(begin[others], m[others])], side="left")
            before = np.add.reduceat(seen, np.cumsum(m[others]) - m[others])
            where = told[own_pairs]
            forth[where] = np.where(i[where] == t, before, every[where] - before)
    forth[tid[i] == tid[j]] = 0.0
    every = np.where(tid[i] == tid[j], 0, every)
    counts = [x[pair] for x in matches]
    score = _bleu(length[i], length[j], counts) * forth
    back = np.flatnonzero(every - forth > 0)
    score[back] += _bleu(length[j[back]], length[i[back]], [c[back] for c in counts]) * (every - forth)[back]
    return np.bincount(g, weights=score, minlength=groups).astype(np.float64)     # no pairs: numpy counts in integers


def _clipped_matches(gram, unit, n, second, group, across, offset, width, local) -> np.ndarray:
    """Per pair of texts the summed smaller counts of their common grams."""
    out = np.zeros(offset[-1])
    if not len(gram):
        return out
    entry, count = np.unique(gram * n + unit, return_counts=True)     # by gram, then by text
    run, u = entry // n, entry % n
    first = np.concatenate([[True], run[1:] != run[:-1]])
    start = np.flatnonzero(first)
    r = np.cumsum(first) - 1
    end = np.append(start[1:], len(run))[r]
    ours = (start + np.add.reduceat(1 - second[u], start))[r]         # where the gram's side-2 texts begin
    here = np.arange(len(run))
    partner = np.where(~across[group[u]], here + 1, np.where(second[u] > 0, end, ours))
    size = end - partner
    row, total = offset[group[u]] + local[u] * width[group[u]], np.cumsum(size)
    lo = 0
    while lo < len(run):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + SLICE, side="right")))
        left, right = np.repeat(here[lo:hi], size[lo:hi]), _ranges(partner[lo:hi], size[lo:hi])
        if len(left):
            out += np.bincount(row[left] + local[u[right]], weights=np.minimum(count[left], count[right]), minlength=len(out))
        lo = hi
    return out


def _bleu(ref_len: np.ndarray, cand_len: np.ndarray, counts: list) -> np.ndarray:
    """Sentence BLEU (smoothing method 1) of pairs with a common token, as ``operators.overlap._bleu_expr``."""
    logs = np.zeros(len(ref_len))
    for n, m in enumerate(counts, start=1):
        logs += np.log(np.where(m > 0, m, S.BLEU_EPSILON) / np.maximum(1, cand_len - n + 1))
    with np.errstate(over="ignore"):
        short = np.exp(1 - ref_len / np.maximum(cand_len, 1))
    return np.where(cand_len > ref_len, 1.0, short) * np.exp(logs / S.BLEU_MAX_N)


def lcs_pairs(table: pa.Table, starts: np.ndarray, rows: int = 20_000):
    """Batches ``case_id, i, j, weight, ni, nj, lcs``: the group's text pairs with a common subsequence (i < j by ``tid``)."""
    side, tid, m = (table.column(c).to_numpy() for c in ("side", "tid", "m"))
    cases, found = table.column("case_id").combine_chunks(), []
    for lo, hi in zip(starts, np.append(starts[1:], table.num_rows)):
        words, length = _lists(table.column("tokens").slice(int(lo), int(hi - lo)))
        word = words.dictionary_encode().indices.to_numpy()
        texts = np.split(word, np.cumsum(length)[:-1])
        ours = int((side[lo:hi] < 2).sum())
        for b in range(ours if side[lo] else 1, hi - lo):
            others = [a for a in range(ours if side[lo] else b) if tid[lo + a] != tid[lo + b]]
            for a, n in zip(others, lcs_lengths(texts[b], [texts[a] for a in others])):
                if n:
                    x, y = (a, b) if tid[lo + a] < tid[lo + b] else (b, a)
                    found.append((lo + a, tid[lo + x], tid[lo + y], m[lo + a] * m[lo + b], length[x], length[y], n))
            if len(found) >= rows:
                yield _lcs_batch(cases, found)
                found = []
    if found:
        yield _lcs_batch(cases, found)


def _lcs_batch(cases, found: list) -> pa.RecordBatch:
    at, *columns = zip(*found)
    return pa.RecordBatch.from_arrays([cases.take(pa.array(at, pa.int64())), *[pa.array(np.array(c, dtype=np.int64)) for c in columns]],
                                      names=["case_id", "i", "j", "weight", "ni", "nj", "lcs"])
