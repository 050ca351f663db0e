"""Approximate nearest neighbours on shifted space-filling curves.

Every vector is scaled to length 1, rotated and projected ``ORDERINGS`` times
(a seeded rotation and shift each), and its grid cell becomes a Hilbert key.
Spark range-partitions the rows by (ordering, key) and numbers them; the
neighbours of a query are the rows at most ``window`` places away in any
ordering.  Blocks of the orderings meet the queries whose windows reach them,
each block returns its best rows by exact cosine, and these lists merge.

The window is measured, not guessed: a bounded sample of the queries is
searched by brute force (the sample against all rows, map-only), and the
window is the smallest that would have found the share ``target`` of its true
neighbours.  Data without structure get a wide window, clustered data a
narrow one.  Grid scale and rotations are the only things fitted on a sample.

Rows with equal vectors become one row with its smallest ids (as many as a
query can need), so a hot vector fills neither a block nor a window; this
drops no answer.

Defined results: vectors that are NULL, empty, zero, hold NULL or non-finite
components take no part, nor do rows with a NULL id; vectors of different
lengths have no cosine, so each length is searched on its own; rows that
share the query's id are not its candidates; a query with fewer candidates
gets all of them; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, staged

ORDERINGS, AXES, BITS = 12, 8, 7
FIT_ROWS = 4096          # vectors that the grid is scaled on
PROBES = 200             # queries that the window is measured on
TARGET = 0.97
BLOCK = 2048             # rows of an ordering that one group holds
GROUP_QUERIES = 4096     # queries that one group holds, in the mean
SALTS = 16


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each grid cell (rows of non-negative integers under ``2**bits``) on the Hilbert curve.

    The transpose form of the curve: undo the excess rotations from the top
    bit down, Gray-encode, interleave the bits.
    """
    x = cells.astype(np.uint64)
    n = x.shape[1]
    zero, one = np.uint64(0), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for i in range(n):
            high = (x[:, i] >> np.uint64(b)) & one == one
            swap = np.where(high, zero, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            if i:
                x[:, i] ^= swap
            else:
                x[:, 0] ^= np.where(high, zero, swap)
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, n - 1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), zero)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | x[:, i] >> np.uint64(b) & one
    return key.astype(np.int64)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` and its row of ``b``, the same whatever rows stand beside it."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def _trim(keep: int, dim: int):
    """Per batch, drop rows beyond the ``keep`` smallest ids of their vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = matrix(batch.column(1), dim) + 0.0  # no negative zero
            _, group = np.unique(v.view(f"V{8 * dim}").ravel(), return_inverse=True)
            order = np.lexsort((batch.column(0).to_numpy(), group))
            g = group[order]
            place = np.arange(len(g))
            first = np.maximum.accumulate(np.where(np.append(True, g[1:] != g[:-1]), place, 0))
            yield batch.take(pa.array(np.sort(order[place - first < keep])))
    return run


def _representatives(rows: DataFrame, dim: int, keep: int) -> DataFrame:
    """``key, ids, vec``: one row per distinct vector with its ``keep`` smallest ids; ``key`` is the smallest."""
    trimmed = rows.mapInArrow(_trim(keep, dim), rows.schema)
    few = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    part = F.spark_partition_id()
    return (trimmed.select(F.array("id").alias("ids"), "vec", (part / 64).cast("int").alias("some"))
            .groupBy("vec", "some").agg(few.alias("ids")).groupBy("vec").agg(few.alias("ids"))
            .select(F.col("ids")[0].alias("key"), "ids", "vec"))


class Grid:
    """Rotations, centre and scale of the orderings."""

    def __init__(self, sample: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.axes = min(AXES, dim)
        self.turns = [np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :self.axes] for _ in range(ORDERINGS)]
        self.shifts = rng.random((ORDERINGS, self.axes))
        flat = [units(sample) @ t for t in self.turns]
        self.mid = [p.mean(axis=0) for p in flat]
        self.wide = [3 * p.std(axis=0) + 1e-9 for p in flat]

    def keys(self, unit: np.ndarray, ordering: int) -> np.ndarray:
        """The grid spans twice the data and the shift moves them inside it."""
        p = (unit @ self.turns[ordering] - self.mid[ordering]) / self.wide[ordering]
        cell = (np.clip((p + 1) / 4, 0, 0.5) + self.shifts[ordering] / 2) * ((1 << BITS) - 1)
        return hilbert_keys(cell.astype(np.int64), BITS)


def _ordered(reps: DataFrame, grid, dim: int, parts: int) -> DataFrame:
    """``key, ordering, rank``: all vectors in all orderings, numbered from 0 in each; the vectors stay behind."""
    spark = reps.sparkSession
    held = spark.sparkContext.broadcast(grid)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = units(matrix(batch.column(1), dim))
                for o in range(ORDERINGS):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(np.full(len(u), o, np.int32)), pa.array(held.value.keys(u, o))],
                        names=["key", "ordering", "curve"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.append_column("row", pa.array(np.arange(seen, seen + batch.num_rows)))
            seen += batch.num_rows

    shape = "key long, ordering int, curve long"
    placed = (reps.select("key", "vec").mapInArrow(place, shape).repartitionByRange(parts, "ordering", "curve", "key")
              .sortWithinPartitions("ordering", "curve", "key").withColumn("part", F.spark_partition_id()))
    rows = staged(placed.mapInArrow(number, f"{shape}, part int, row long"), "orderings")
    # Places before each part of an ordering: as many rows as partitions, not as data.
    parts_of = rows.groupBy("ordering", "part").agg(F.count("*").alias("n"), F.min("row").alias("head"))
    before = F.sum("n").over(Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts_of.select("ordering", "part", (F.coalesce(before, F.lit(0)) - F.col("head")).alias("start"))
    return (rows.join(F.broadcast(starts), ["ordering", "part"])  # one row per partition and ordering
            .select("key", "ordering", (F.col("row") + F.col("start")).alias("rank")))


def _best(ids: list[list[int]], cand: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int):
    """(query, id, score) of at least the ``k + 1`` best ids per query, its own among them, ties to the smaller id."""
    keep = min(k + 1, len(cand))
    rough = units(queries) @ units(cand).T
    cut = -np.partition(-rough, keep - 1, axis=1)[:, keep - 1:keep] - 1e-9  # all that may tie with the last
    q, c = np.nonzero(rough >= cut)
    score = cosines(queries[q], cand[c])
    out = []
    order = np.lexsort(([ids[j][0] for j in c], -score, q))
    last, reps, own = -1, 0, []
    for j in order:
        if q[j] != last:
            out += own
            last, reps, own = q[j], 0, []
        if reps <= k:
            own += [(int(qids[last]), i, float(score[j])) for i in ids[c[j]]]
            reps += 1
    return out + own


def nearest(rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
            seed: int = 5, target: float = TARGET) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest rows found for each row where ``is_query`` holds."""
    spark = prepared(rows.sparkSession)
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    vec = F.col(vec_col)
    if rows.schema[vec_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        vec = vec.cast("array<double>")
    base = (rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), is_query.alias("asks"))
            .where(F.col("id").isNotNull() & _usable(F.col("vec"))))
    lengths = [r["dim"] for r in base.select(F.size("vec").alias("dim")).distinct().collect()]
    found = [_nearest(base.where(F.size("vec") == dim), dim, id_col, k, seed, target) for dim in sorted(lengths)]
    return reduce(DataFrame.unionAll, found) if found else empty


def _nearest(base: DataFrame, dim: int, id_col: str, k: int, seed: int, target: float) -> DataFrame:
    """The search among ``id, vec, asks`` rows of one vector length."""
    spark = base.sparkSession
    queries = base.where("asks").select("id", "vec")
    reps = staged(_representatives(base.select("id", "vec"), dim, k + 1), "vectors")
    n = reps.count()

    fit = reps.orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS).select("vec").collect()  # bounded sample
    grid = Grid(np.array([r[0] for r in fit]), seed)
    parts = max(ORDERINGS, math.ceil(n * ORDERINGS * 32 / (64 << 20)), spark.sparkContext.defaultParallelism)
    ordered = _ordered(reps, grid, dim, parts)
    window = _window(reps, ordered, queries, dim, k, n, target)

    chunks = max(1, math.ceil(2 * window / 50 / GROUP_QUERIES))
    # Queries with equal vectors ask once, under the key of their vector.
    asks = staged(queries.select(F.col("id").alias("query_id"), "vec")
                  .join(reps.select("vec", F.col("key").alias("qkey")), "vec").select("query_id", "qkey"), "asks")
    places = staged(asks.select(F.col("qkey").alias("key")).distinct().join(reps, "key").join(ordered, "key")
                    .select(F.col("key").alias("qkey"), F.col("vec").alias("qvec"), "ordering", "rank"), "places")
    asked = places.select(
        "qkey", "qvec", "ordering", F.pmod(F.xxhash64("qkey"), F.lit(chunks)).cast("int").alias("chunk"),
        F.explode(F.sequence(F.expr(f"greatest(0L, rank - {window}L) div {BLOCK}"),
                             F.expr(f"least({n - 1}L, rank + {window}L) div {BLOCK}"))).alias("block"))
    blocks = ordered.join(reps, "key").select("ids", "vec", "ordering", F.expr(f"rank div {BLOCK}").alias("block"),
                            F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("qkey", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        cand = matrix(right.column("vec").combine_chunks(), dim)
        found = _best(right.column("ids").to_pylist(), cand, left.column("qkey").to_numpy(),
                      matrix(left.column("qvec").combine_chunks(), dim), k)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)]
                                    if found else schema.empty_table().columns, schema=schema)

    on = ["ordering", "block", "chunk"]
    found = (asked.groupBy(*on).cogroup(blocks.groupBy(*on)).applyInArrow(search, "qkey long, id long, score double")
             .groupBy("qkey", "id").agg(F.max("score").alias("score")))
    order = [F.desc("score"), F.col("id")]
    top = (found.withColumn("rank", F.row_number().over(Window.partitionBy("qkey").orderBy(*order)))
           .where(F.col("rank") <= k + 1).drop("rank"))
    salted = top.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lists = asks.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")).join(salted, ["qkey", "salt"])
    # A query id on several rows asks with each of its vectors.
    best = F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy(*order))
    return (lists.where(F.col("id") != F.col("query_id")).withColumn("rank", best).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))


def brute_force(reps: DataFrame, probes: list[tuple[int, list[float]]], dim: int, k: int) -> DataFrame:
    """``query_id, id, score`` of a bounded set of queries against all rows; map-only up to the merge."""
    held = reps.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids = np.array([p[0] for p in held.value])
        asked = np.array([p[1] for p in held.value])
        for batch in batches:
            if batch.num_rows:
                found = _best(batch.column(0).to_pylist(), matrix(batch.column(1), dim), qids, asked, k)
                found = [f for f in found if f[0] != f[1]]
                if found:
                    q, i, s = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()),
                                                      pa.array(s, pa.float64())], names=["query_id", "id", "score"])

    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return (reps.select("ids", "vec").mapInArrow(run, "query_id long, id long, score double")
            .withColumn("rank", best).where(F.col("rank") <= k).drop("rank"))


def _window(reps: DataFrame, ordered: DataFrame, queries: DataFrame, dim: int, k: int, n: int, target: float) -> int:
    """Places to either side that find the share ``target`` of the probes' true neighbours."""
    probes = [(r[0], r[1]) for r in queries.orderBy(F.xxhash64("id"), "id").limit(PROBES).collect()]
    if not probes:
        return BLOCK
    pairs = [(r[0], r[1]) for r in brute_force(reps, probes, dim, k).collect()]  # at most PROBES * k
    wanted = {i for p in pairs for i in p}
    ids = reps.sparkSession.createDataFrame([(i,) for i in sorted(wanted)], "id long")
    keys = reps.select("key", F.explode("ids").alias("id")).join(F.broadcast(ids), "id")
    rows = ordered.join(F.broadcast(keys), "key").collect()  # at most ORDERINGS * PROBES * (k + 1), as bounded as keys
    at: dict[int, np.ndarray] = {}
    for r in rows:
        at.setdefault(r["id"], np.zeros(ORDERINGS))[r["ordering"]] = r["rank"]
    far = sorted(int(np.abs(at[a] - at[b]).min()) for a, b in pairs if a in at and b in at)
    if not far:
        return BLOCK
    return min(n, max(k + 1, far[min(len(far) - 1, math.ceil(target * len(far)) - 1)]))
