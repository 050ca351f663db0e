"""Near-duplicate classes by BagMinHash signatures and exact multiset overlap.

A text is the multiset of its shingles of five words (split at ASCII white
space).  BagMinHash draws, for each shingle, Poisson points over time on its
weight axis: the axis is cut into dyadic intervals (0,1], (1,2], (2,4], ...,
each with its own seeded process, and every point has a discrete place inside
its interval, so that a weight sees exactly the points at or below it.  A
signature component is the time of its first point; two texts agree in a
component with the probability of their weighted Jaccard similarity.
Processes are followed only while they can still beat a component.

Bands of the signature put texts into buckets; similarity is then computed
exactly from the texts.  Equal texts are one node from the start.  In a
bucket every member is compared with one hub, drawn by a hash that differs
from bucket to bucket (a star, not all pairs), so a text is compared with as
many hubs as it has shared buckets.  Members that the verified stars leave in
different components may still be linked: blocks of a bucket meet, members of
its largest component only members of the others, and arrays of sketches rule
out what can't match.  1 - similarity is a metric, so the distances of a pair
to the hub may differ by the threshold distance at most; and the smaller
counts of two shingle histograms bound the overlap from above.  Both are
exact, so no link between components is lost, and few pairs leave the blocks.

A bucket with many members outside its largest component (texts on a common
template that are not alike enough) would need blocks in the square of their
number.  Its members meet by their rare shingles instead: with shingles in
one order, the rarest first, two texts of the wanted similarity share one of
the first few of each (prefix filter, exact in any order).  Template shingles
come last, so texts that share only them never meet, and the work grows with
the texts.

Defined results: NULL texts are empty; texts without a word are one class;
texts of fewer than five words are one shingle of all their words; the class
key is the least text key of the class, unique whatever the ids are; the class
id is the least document id of the class (NULL if all are NULL), which
unrelated classes share if ids are NULL or repeated; repeated rows get a row
each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import RangeHash, column_bytes, mix
from .common import prepared, slices, staged, text_or_empty
from .components import components
from .url_filter import bloom_blocks, bloom_hits

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5          # a pair at 0.8 shares no band with a probability of 3e-6
SIZE = BANDS * ROWS
SLICE_BYTES = 2 << 20
CHUNK = 1 << 19              # processes followed at once
BLOOM_BLOCKS = 1 << 16
SALTS = 16
BINS, FULL = 256, 65535      # counts of a shingle histogram, the mark of a full one
BLOCK = 512                  # members on each side of a block
WIDE = BLOCK                 # members outside the largest component from which rare shingles decide
LEVELS = (32, 1024, 32768)   # texts with a shingle from which it counts as more common
FILTER_WORDS = 1 << 17       # 64-bit words of the filter of common shingles (1 MB a level)
_WEIGHTS = np.random.default_rng(99).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of a string column, sorted by row and shingle."""
    data, ends = column_bytes(column)
    blank = np.zeros(len(data) + 2, bool)
    blank[0] = blank[-1] = True
    blank[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    inner = np.unique(ends[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    inner = inner[~blank[inner] & ~blank[inner + 1]]  # a document ends inside a run of letters
    edge = np.sort(np.concatenate((edge, inner, inner)))
    start, end = edge[::2], edge[1::2]
    words = RangeHash(data).of(start, end)
    n_rows = len(column)
    first = np.searchsorted(start, ends[:-1])
    n_words = np.searchsorted(start, ends[1:]) - first
    n_shingles = np.where(n_words > 0, np.maximum(n_words - WORDS + 1, 1), 0)
    row = np.repeat(np.arange(n_rows), n_shingles)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + first[row]
    limit = (first + n_words)[row]
    total = np.zeros(len(row), np.uint64)
    for k in range(WORDS):
        real = at + k < limit
        total += np.where(real, words[np.minimum(at + k, max(0, len(words) - 1))] * _WEIGHTS[k], np.uint64(0)) if len(words) else 0
    value = mix(total)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    heads = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))) if len(row) else np.zeros(0, int)
    return row[heads], value[heads], np.diff(np.append(heads, len(row)))


def _processes(row, value, count):
    """One process per dyadic interval that a weight reaches: (row, seed, first place, length, weight)."""
    top = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0)  # intervals above the first
    index = np.repeat(np.arange(len(row)), top + 1)
    level = np.arange(len(index)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    length = np.left_shift(1, np.maximum(level - 1, 0))
    low = np.where(level > 0, length, 0)
    seed = mix(value[index] + level.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return row[index], seed, low, length, count[index]


def signatures(row: np.ndarray, value: np.ndarray, count: np.ndarray, n_rows: int) -> np.ndarray:
    """BagMinHash signature of each row: the first times of ``SIZE`` components (inf for empty rows)."""
    first = np.full(n_rows * SIZE, np.inf)
    row, seed, low, length, weight = _processes(row, value, count)
    for cut in range(0, len(row), CHUNK):
        part = slice(cut, cut + CHUNK)
        r, s, lo, ln, w = row[part], seed[part], low[part], length[part], weight[part]
        time = np.zeros(len(r))
        while len(r):
            s = mix(s + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(((s >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / ln
            more = mix(s ^ np.uint64(0xA0761D6478BD642F))
            place = lo + 1 + ((more >> np.uint64(32)) & (ln - 1).astype(np.uint64)).astype(np.int64)
            component = ((more & np.uint64(0xFFFFFFFF)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
            seen = place <= w
            np.minimum.at(first, r[seen] * SIZE + component[seen], time[seen])
            live = time < first.reshape(n_rows, SIZE).max(axis=1)[r]
            r, s, lo, ln, w, time = r[live], s[live], lo[live], ln[live], w[live], time[live]
    return first.reshape(n_rows, SIZE)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    total = np.zeros((len(signature), BANDS), np.uint64)
    for k in range(ROWS):
        total = mix(total + bits[:, :, k])
    return mix(total + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)).view(np.int64)


def overlaps(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets, pair by pair (1 for two texts without words)."""
    ra, va, ca = shingles(a)
    rb, vb, cb = shingles(b)
    row, value, count = (np.concatenate(x) for x in ((ra, rb), (va, vb), (ca, cb)))
    order = np.lexsort((value, row))
    row, value, count = row[order], value[order], count[order]
    same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
    both = np.bincount(row[1:][same], np.minimum(count[1:], count[:-1])[same], len(a))
    total = np.bincount(row, count, len(a))
    return np.where(total > 0, both / np.maximum(total - both, 1), 1.0)


def histograms(row: np.ndarray, value: np.ndarray, count: np.ndarray, n_rows: int) -> np.ndarray:
    """Shingle counts by hash bin; a bin too full for 16 bits is marked by the largest number."""
    at = row * BINS + (value >> np.uint64(64 - 8)).astype(np.int64)
    return np.minimum(np.bincount(at, count, n_rows * BINS), FULL).astype(np.uint16).reshape(n_rows, BINS)


def _signed(docs: DataFrame) -> DataFrame:
    """``id, key, size, bands, bins`` of ``id, key, text`` rows; map-only."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                n = part.num_rows
                row, value, count = shingles(part.column(2))
                bands = band_hashes(signatures(row, value, count, n))
                size = np.bincount(row, count, n).astype(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), pa.array(bands.ravel()))
                bins = pa.array([x.tobytes() for x in histograms(row, value, count, n)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), lists, bins],
                                                 names=["id", "key", "size", "bands", "bins"])
    return docs.mapInArrow(run, f"id {kind}, key binary, size long, bands array<long>, bins binary")


def _texts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, text`` of the nodes in ``keys``, once each; a Bloom filter keeps other texts out of the shuffle."""
    few = bloom_hits(rows.select("key", "text"), "key", bloom_blocks(keys, "key", BLOOM_BLOCKS), BLOOM_BLOCKS)
    return staged(few.groupBy("key").agg(F.first("text").alias("text")).join(keys, "key", "left_semi"), "texts")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, similarity`` of each pair of nodes, from their whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in slices(batch, 2, SLICE_BYTES):
                for part in slices(half, 3, SLICE_BYTES):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(overlaps(part.column(2), part.column(3)))],
                        names=["a", "b", "similarity"])

    left, right = (texts.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(run, "a binary, b binary, similarity double")


def possible(a: dict, b: dict, band: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks of one bucket that may be linked, each in the first band that both share."""
    near = (a["component"][:, None] != b["component"][None, :])
    near &= np.abs(a["distance"][:, None] - b["distance"][None, :]) <= 1 - similarity + 1e-9
    small, large = (f(a["size"][:, None], b["size"][None, :]) for f in (np.minimum, np.maximum))
    near &= small >= similarity * large - 1e-9
    i, j = np.nonzero(near)
    found = []
    for k in range(0, len(i), 1 << 15):
        x, y = i[k:k + (1 << 15)], j[k:k + (1 << 15)]
        first = (a["prints"][x] == b["prints"][y]).argmax(axis=1) == band
        x, y = x[first], y[first]
        full = (a["bins"][x] == FULL).any(axis=1) | (b["bins"][y] == FULL).any(axis=1)
        most = np.minimum(a["bins"][x], b["bins"][y]).sum(axis=1, dtype=np.int64)
        fits = full | (most >= similarity * (a["size"][x] + b["size"][y] - most) - 1e-9)
        found.append((x[fits], y[fits]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (i, j)


def _blocks(similarity: float):
    """Over rows sorted by block: pairs of each block; a block that spans batches is carried on."""
    def pairs(rows: pa.Table) -> Iterator[tuple[list, list]]:
        columns = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        block = columns["block"].to_numpy()
        part = columns["part"].to_numpy()
        band = columns["band"].to_numpy()
        _, component = np.unique(np.array(columns["component"].to_pylist(), dtype=object), return_inverse=True)
        fields = {"component": component, "distance": columns["distance"].to_numpy(), "size": columns["size"].to_numpy(),
                  "prints": columns["prints"].flatten().to_numpy().reshape(-1, BANDS),
                  "bins": np.frombuffer(b"".join(columns["bins"].to_pylist()), np.uint16).reshape(-1, BINS)}
        keys = np.array(columns["key"].to_pylist(), dtype=object)
        heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for start, end in zip(heads, np.append(heads[1:], len(block)), strict=True):
            sides = [start + np.flatnonzero(part[start:end] == k) for k in (0, 1)]
            alone = columns["alone"][int(start)].as_py()
            right = sides[0] if alone else sides[1]
            a, b = ({c: v[at] for c, v in fields.items()} for at in (sides[0], right))
            i, j = possible(a, b, int(band[start]), similarity)
            if alone:
                i, j = i[i < j], j[i < j]
            yield keys[sides[0][i]].tolist(), keys[right[j]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for a, b in pairs(rows) if rows.num_rows else ():
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if carry is None else [*carry.to_batches(), batch])
            block = rows.column("block").to_numpy()
            open_at = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0
            yield from out(rows.slice(0, open_at))
            carry = rows.slice(open_at)
        if carry is not None:
            yield from out(carry)
    return run


def occurrences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of a string column: every occurrence of a shingle is a token of its own, so multisets become sets."""
    row, value, count = shingles(column)
    index = np.repeat(np.arange(len(row)), count)
    nth = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)
    return row[index], mix(value[index] + nth.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


def _probes(token: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, mask) of the bits of tokens in a filter."""
    for k in (1, 2):
        h = mix(token + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        yield (h >> np.uint64(6)).astype(np.int64) & (FILTER_WORDS - 1), np.uint64(1) << (h & np.uint64(63))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(occurrences(part.column(1))[1].view(np.int64))], names=["token"])


def _common_filters(texts: DataFrame) -> list[np.ndarray]:
    """One filter of fixed size per level with the tokens that so many of the texts hold."""
    counts = staged(texts.mapInArrow(_tokens, "token long").groupBy("token").agg(F.count("*").alias("n"))
                    .where(F.col("n") >= LEVELS[0]), "common")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, mask in _probes(batch.column(0).to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    found = []
    for level in LEVELS:
        words = np.zeros(FILTER_WORDS, np.uint64)
        rows = (counts.where(F.col("n") >= level).select("token").mapInArrow(bits, "word long, mask long")
                .groupBy("word").agg(F.bit_or("mask").alias("mask")))
        for word, mask in rows.toLocalIterator():
            words[word] = np.uint64(mask & (1 << 64) - 1)
        found.append(words)
    return found


def _prefixes(filters: list[np.ndarray], similarity: float):
    """``key, text`` to ``token, key, size, indexed``: the rarest tokens of each text that a partner must share.

    A partner that is no larger shares one of the first ``size - s * size + 1``
    tokens, and finds it among its own first ``size - 2s/(1+s) * size + 1``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                row, token = occurrences(part.column(1))
                size = np.bincount(row, minlength=part.num_rows)
                level = np.zeros(len(token), np.int64)
                for words in filters:
                    level += np.logical_and.reduce([words[word] & mask != 0 for word, mask in _probes(token)])
                order = np.lexsort((token, level, row))
                row, token = row[order], token[order]
                place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                first = [size - np.ceil(share * size - 1e-9).astype(np.int64) + 1 for share in (similarity, 2 * similarity / (1 + similarity))]
                kept = place < first[0][row]
                row, place = row[kept], place[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[kept].view(np.int64)), part.column(0).take(pa.array(row)), pa.array(size[row]),
                     pa.array(place < first[1][row])], names=["token", "key", "size", "indexed"])
    return run


def _rare_pairs(wide: DataFrame, texts: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of the nodes ``wide`` (``key, component``) in different components that share a band and a rare shingle."""
    chosen = staged(texts.join(wide.select("key"), "key", "left_semi").select("key", "text"), "wide")
    prefixes = chosen.mapInArrow(_prefixes(_common_filters(chosen), similarity), "token long, key binary, size long, indexed boolean")
    rows = staged(prefixes.join(wide, "key"), "prefixes")
    mixed = rows.groupBy("token").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("token")
    rows = staged(rows.join(mixed, "token", "left_semi"), "prefixes")
    small = rows.where("indexed").select("token", *(F.col(c).alias(f"{c}_s") for c in ("key", "size", "component")))
    pairs = (rows.join(small, "token")
             .where((F.col("component") != F.col("component_s")) & (F.col("size_s") >= similarity * F.col("size") - 1e-9)
                    & ((F.col("size_s") < F.col("size")) | ((F.col("size_s") == F.col("size")) & (F.col("key_s") < F.col("key")))))
             .select(F.least("key", "key_s").alias("a"), F.greatest("key", "key_s").alias("b")).distinct())
    bands = {c: nodes.select(F.col("key").alias(c), F.col("bands").alias(f"bands_{c}")) for c in "ab"}
    return (pairs.join(bands["a"], "a").join(bands["b"], "b").where(F.arrays_overlap("bands_a", "bands_b")).select("a", "b"))


def _further_pairs(members: DataFrame, nodes: DataFrame, stars: DataFrame, labels: DataFrame, texts: DataFrame,
                   similarity: float) -> DataFrame:
    """Pairs inside buckets that the stars left in different components and the sketches do not rule out."""
    distance = stars.select(F.col("a").alias("key"), F.col("b").alias("hub"), (1 - F.col("similarity")).alias("distance"))
    rows = (members.where("key <> hub").join(distance, ["key", "hub"], "left")
            .join(labels.select(F.col("node").alias("key"), "component"), "key", "left")
            .select("bucket", "band", "key", "distance", F.coalesce("component", "key").alias("component")))
    rows = staged(rows, "members")
    parts = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    several = staged(parts.groupBy("bucket")
                     .agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"))
                     .where("parts > 1"), "several")
    is_wide = F.col("n") - F.col("most.n") > WIDE
    wide = rows.join(several.where(is_wide).select("bucket"), "bucket", "left_semi").select("key", "component").distinct()
    mixed = (several.where(~is_wide).select(
                 "bucket", F.col("most.component").alias("largest"),
                 F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("n_left"), F.ceil(F.col("most.n") / BLOCK).alias("n_right"),
                 F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    rows = (rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(mixed, ["bucket", "salt"])
            .withColumn("right", F.col("component") == F.col("largest"))
            .withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "key"), F.when(F.col("right"), F.col("n_right")).otherwise(F.col("n_left")))))

    def block(i, j, alone: bool, part) -> F.Column:
        return F.struct(i.alias("i"), j.alias("j"), F.lit(alone).alias("alone"), part.cast("int").alias("part"))

    chunk, zero = F.col("chunk"), F.lit(0).cast("long")
    lefts, rights = F.sequence(zero, F.col("n_left") - 1), F.sequence(zero, F.col("n_right") - 1)
    # Members outside the largest component meet each other (alone: one chunk with itself) and all chunks of the largest.
    own = F.transform(lefts, lambda k: F.struct(F.least(k, chunk).alias("i"), F.greatest(k, chunk).alias("j"),
                                                (k == chunk).alias("alone"), (k < chunk).cast("int").alias("part")))
    other = F.transform(rights, lambda k: block(chunk, k + F.col("n_left"), False, F.lit(0)))
    back = F.transform(lefts, lambda k: block(k, chunk + F.col("n_left"), False, F.lit(1)))
    placed = (rows.withColumn("at", F.explode(F.when(F.col("right"), back).otherwise(F.concat(own, other))))
              .select(F.xxhash64("bucket", "at.i", "at.j").alias("block"), "bucket", "at.i", "at.j", "at.alone", "at.part",
                      "band", "key", "distance", "component")
              .join(nodes.select("key", "size", F.col("bands").alias("prints"), "bins"), "key"))
    found = (placed.repartition("block").sortWithinPartitions("block", "bucket", "i", "j")
            .select("block", "alone", "part", "band", "key", "distance", "component", "size", "prints", "bins")
            .mapInArrow(_blocks(similarity), "a binary, b binary")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if several.where(is_wide).isEmpty():
        return found
    return found.unionAll(_rare_pairs(staged(wide, "wide-keys"), texts, nodes, similarity)).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    similarity: float = SIMILARITY) -> DataFrame:
    """``id, key, class_key, class_id`` per row: key is the MD5 of the text, the others are the least of its class."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    signed = staged(_signed(rows), "signed")
    nodes = staged(signed.groupBy("key").agg(F.min("id").alias("least"), F.first("size").alias("size"),
                                             F.first("bands").alias("bands"), F.first("bins").alias("bins")), "nodes")
    buckets = nodes.select("key", F.posexplode("bands").alias("band", "bucket"))
    hubs = (buckets.groupBy("bucket")
            .agg(F.min(F.struct(F.xxhash64("bucket", "key").alias("draw"), "key")).alias("hub"), F.count("*").alias("n"))
            .where("n > 1").select("bucket", F.col("hub.key").alias("hub"),
                                   F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    members = staged(buckets.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
                     .join(hubs, ["bucket", "salt"]).select("bucket", "band", "key", "hub"), "members")

    pairs = members.where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    keys = members.select("key").distinct()
    texts = _texts(rows, keys)
    stars = staged(_verified(pairs, texts), "stars")
    alike = F.col("similarity") >= similarity - 1e-12
    links = stars.where(alike).select("a", "b")
    labels = components(links)
    further = staged(_further_pairs(members, nodes, stars, labels, texts, similarity), "pairs")
    if not further.isEmpty():
        more = staged(_verified(further, texts), "further")
        known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = components(known.unionAll(more.where(alike).select("a", "b")))

    # Only nodes with a link can share a class; the others are their own.
    linked = staged(nodes.select("key", "least").join(labels.withColumnRenamed("node", "key"), "key"), "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("class_id"))
    joint = linked.join(least, "component").select("key", "component", "class_id")
    classes = staged(nodes.select("key", "least").join(joint, "key", "left")
                     .select("key", F.coalesce("component", "key").alias("class_key"),
                             F.coalesce("class_id", "least").alias("class_id")), "classes")
    return signed.select("id", "key").join(classes, "key").select("id", "key", "class_key", "class_id")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: the one with the least id (of equal ids that with the least key)."""
    found = staged(near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "found")
    kept = (found.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("class_key", "id", "key")
            .agg(F.count("*").alias("n")))
    # The rows left of a class all have its least id, under which it may have several texts.
    kept = kept.groupBy("class_key").agg(F.min(F.struct("key", "id", "n")).alias("kept")).select("kept.id", "kept.key", "kept.n")
    kept = staged(kept, "kept")
    key = F.unhex(F.md5(text_or_empty(text_col).cast("binary")))
    tagged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), key.alias("key"))

    def matching(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select(F.col("id").alias("kept_id"), F.col("key").alias("kept_key"))
        return tagged.join(wanted, tagged["id"].eqNullSafe(wanted["kept_id"]) & (tagged["key"] == wanted["kept_key"]), "left_semi")

    single = matching(kept.where("n = 1"))
    repeated = matching(kept.where("n > 1")).dropDuplicates(["id", "key"])
    return single.unionAll(repeated).select("row.*")
