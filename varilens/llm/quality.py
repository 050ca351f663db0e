"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Tokens (runs of one kind of character, told apart by case) are hashed to
``SLOTS`` slots.  Each slot has a sparse random index vector; its context
vector adds up the index vectors of its neighbours in all documents
(random indexing), and the word vector is the sum of both, scaled.  A
document is the mean and the spread of its word vectors, with the shares of
vectors that come again a few tokens later.  A two-layer numpy
network is fitted to the labelled sample, and a temperature, fitted on a part
of the sample kept from the weights, turns its output into probabilities.

Only the fit is bounded: at most ``max_rows`` labelled rows, chosen by a hash
of their id.  Word statistics cover every whole text: tasks sum them, ranges
of slots are merged by tasks of their own, and the driver sees one matrix of
fixed size and one feature row per sampled document.  The sums are whole
numbers, so they hang on no order.  Scoring is map-only over every whole text.

Defined results: NULL and empty texts have the zero vector and get the
network's score for it; without labels of both classes every score is 0.5;
of several labels of one id the larger counts; unlabelled and repeated rows
are scored like any other; labels, lang, source and ids are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import RangeHash, column_bytes
from .common import prepared, slices, staged

SLOTS, DIM, NONZERO, NEAR = 1 << 14, 48, 6, 2
MAX_ROWS = 6000
SLICE_BYTES = 1 << 20
RANGE = 64                 # slots of one range of word statistics
HIDDEN, STEPS, RATE, DECAY = 24, 600, 0.01, 1e-3
THRESHOLD = 0.3
LAGS = 4
FEATURES = 2 * DIM + 2 + LAGS


def _kinds() -> np.ndarray:
    """Kind of each byte: 0 blank, 1 lower-case or non-ASCII, 2 upper-case, 3 digit, 4 other."""
    kind = np.full(256, 4, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[ord("a"):ord("z") + 1] = 1
    kind[128:] = 1
    kind[ord("A"):ord("Z") + 1] = 2
    kind[ord("0"):ord("9") + 1] = 3
    return kind


KIND = _kinds()


def index_vectors(seed: int = 7) -> np.ndarray:
    """Sparse ternary index vectors, one per slot."""
    rng = np.random.default_rng(seed)
    found = np.zeros((SLOTS, DIM), np.float32)
    at = rng.permuted(np.tile(np.arange(DIM), (SLOTS, 1)), axis=1)[:, :NONZERO]
    np.put_along_axis(found, at, rng.choice(np.float32([-1, 1]), (SLOTS, NONZERO)), axis=1)
    return found


def tokens(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each token, document of each token) of a string column."""
    data, ends = column_bytes(part)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KIND[data]
    cut = np.append(True, kind[1:] != kind[:-1])
    cut[ends[:-1][ends[:-1] < len(data)]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data))
    real = kind[start] != 0
    start, end = start[real], end[real]
    slot = (RangeHash(data).of(start, end) >> np.uint64(64 - 14)).astype(np.int64)
    return slot, np.searchsorted(ends, start, side="right") - 1


def context_sums(slot: np.ndarray, doc: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sum of the index vectors of each slot's neighbours (whole numbers; exact for up to 2^24 pairs)."""
    found = np.zeros((SLOTS, DIM), np.float32)
    pairs = []
    for k in range(1, NEAR + 1):
        same = doc[k:] == doc[:-k]
        a, b = slot[:-k][same], slot[k:][same]
        pairs += [a * SLOTS + b, b * SLOTS + a]
    if not pairs or not sum(map(len, pairs)):
        return found
    pair, n = np.unique(np.concatenate(pairs), return_counts=True)
    for k in range(0, len(pair), 1 << 17):
        a, b = np.divmod(pair[k:k + (1 << 17)], SLOTS)
        heads = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        found[a[heads]] += np.add.reduceat(index[b] * n[k:k + (1 << 17), None].astype(np.float32), heads, axis=0)
    return found


def word_vectors(context: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Index and context directions in equal parts; a word without contexts keeps its index vector."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return (unit(index) + unit(context)).astype(np.float32)


def pooled(part: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features per document: mean and root mean square of its word vectors, length of the mean, log of the count,
    and the shares of words whose vector comes again 1 to ``LAGS`` tokens later."""
    n = len(part)
    total, square = np.zeros((n, DIM)), np.zeros((n, DIM))
    slot, doc = tokens(part)
    for k in range(0, len(slot), 1 << 16):
        s, d = slot[k:k + (1 << 16)], doc[k:k + (1 << 16)]
        rows = vectors[s]
        heads = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        total[d[heads]] += np.add.reduceat(rows, heads, axis=0)
        square[d[heads]] += np.add.reduceat(rows * rows, heads, axis=0)
    count = np.bincount(doc, minlength=n)[:, None]
    mean = total / np.maximum(count, 1)
    again = [np.bincount(doc[k:][(slot[k:] == slot[:-k]) & (doc[k:] == doc[:-k])], minlength=n)[:, None] / np.maximum(count, 1)
             for k in range(1, LAGS + 1)]
    return np.hstack([mean, *again, np.sqrt(square / np.maximum(count, 1)), np.linalg.norm(mean, axis=1, keepdims=True), np.log1p(count)])


class Network:
    """Two layers over standardised features; ``score`` is the calibrated probability of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        self.flat = len(y) < 10 or y.min() == y.max()
        if self.flat:
            return
        rng = np.random.default_rng(seed)
        kept = rng.random(len(y)) < 0.2  # for the temperature
        if len({*y[kept]}) < 2 or len({*y[~kept]}) < 2:
            kept = np.zeros(len(y), bool)
        self.mid, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._scaled(x)
        self.w = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self._fit(z[~kept], y[~kept])
        self.temperature = 1.0
        held = kept if kept.any() else np.ones(len(y), bool)
        grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
        logit = self._logit(z[held])
        self.temperature = float(min(grid, key=lambda t: np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logit / t).mean()))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mid) / self.dev, -8, 8)

    def _logit(self, z: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return np.tanh(z @ w1 + b1) @ w2 + b2[0]

    def _fit(self, z: np.ndarray, y: np.ndarray) -> None:
        """Full-batch Adam on the log loss with weight decay."""
        m = [np.zeros_like(p) for p in self.w]
        v = [np.zeros_like(p) for p in self.w]
        for step in range(1, STEPS + 1):
            w1, b1, w2, b2 = self.w
            hidden = np.tanh(z @ w1 + b1)
            off = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2[0], -30, 30))) - y) / len(y)
            back = np.outer(off, w2) * (1 - hidden ** 2)
            slopes = [z.T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ off + DECAY * w2, np.array([off.sum()])]
            for k, g in enumerate(slopes):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), 0.5)
        logit = np.clip(self._logit(self._scaled(x)) / self.temperature, -50, 50)
        return 1 / (1 + np.exp(-logit))


def held_out(id_col: str):
    """True for the rows that no label is learned from: crc32 of the id as text is a multiple of 5 (NULL id: true)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def corpus_contexts(texts: DataFrame) -> np.ndarray:
    """Context sums over all texts of a one-column table: one fixed-size matrix (6 MB), merged by ranges of slots."""
    ranges = SLOTS // RANGE
    schema = "part int, sums binary"

    def rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()),
                                           "sums": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = index_vectors(), np.zeros((SLOTS, DIM), np.int64)
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                total += context_sums(*tokens(part.column(0)), own).astype(np.int64)
        parts = total.reshape(ranges, RANGE, DIM)
        yield rows({k: parts[k] for k in np.flatnonzero(parts.any(axis=(1, 2))).tolist()})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(k, np.zeros((RANGE, DIM), np.int64)).__iadd__(np.frombuffer(data, np.int64).reshape(RANGE, DIM))
        yield rows(total)

    found = np.zeros((ranges, RANGE, DIM), np.int64)
    parts = texts.mapInArrow(sums, schema).repartitionById(ranges, "part").mapInArrow(merged, schema)
    for k, data in parts.collect():
        found[k] = np.frombuffer(data, np.int64).reshape(RANGE, DIM)
    return found.reshape(SLOTS, DIM)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, Network]:
    """(word vectors, network) from at most ``max_rows`` labelled rows outside the held-out fold."""
    prepared(docs.sparkSession)
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
             .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = staged(texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")),
                    "quality-sample").coalesce(8)
    index = index_vectors()
    context = corpus_contexts(texts.select("text")).astype(np.float32)
    vectors = word_vectors(context, index)
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                x = pooled(part.column(1), held.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))],
                                                 names=["id", "label", "x"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.select("id", "text", "label").mapInArrow(features, f"id {kind}, label int, x array<double>").collect()
    rows.sort(key=lambda r: str(r[0]))
    x = np.array([r[2] for r in rows]) if rows else np.zeros((0, FEATURES))
    return vectors, Network(x, np.array([r[1] for r in rows], dtype=float))


def scored(docs: DataFrame, model: tuple[np.ndarray, Network], *, text_col: str = "text",
           score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in a new last column ``score_col``; map-only."""
    spark = prepared(docs.sparkSession)
    if score_col in docs.columns:
        raise ValueError(f"the input has a column {score_col}; name another with score_col")
    at, held = docs.columns.index(text_col), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = held.value
        for batch in batches:
            for part in slices(batch, at, SLICE_BYTES):
                score = network.score(pooled(part.column(at), vectors))
                yield part.append_column(score_col, pa.array(score, pa.float64()))

    return docs.mapInArrow(run, docs.select("*", F.lit(0.5).alias(score_col)).schema)


def accepted(docs: DataFrame, model: tuple[np.ndarray, Network], *, text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; rows and columns pass through unchanged, map-only."""
    spark = prepared(docs.sparkSession)
    at, held = docs.columns.index(text_col), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = held.value
        for batch in batches:
            for part in slices(batch, at, SLICE_BYTES):
                yield part.filter(pa.array(network.score(pooled(part.column(at), vectors)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
