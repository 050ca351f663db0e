"""Nearest neighbours against brute force; the Hilbert curve's properties."""
import math

import numpy as np
from pyspark.sql import functions as F

from varilens.llm import neighbours as N


def brute(rows, k=5):
    ok = [(i, v) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    found = {}
    for q, a in ok:
        if q % 7 == 0:
            best = {}
            for i, b in ok:
                if i != q:
                    s = float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
                    best[i] = max(s, best.get(i, -2))
            found[q] = sorted(((-round(s, 12), i) for i, s in best.items()))[:k]
    return found


def search(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, key string")
    found = {}
    for r in N.nearest(df, F.col("vec_id") % 7 == 0, **options).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
        assert r["rank"] == len(found[r.query_id])
    return found


def test_hilbert_keys_step_to_neighbouring_cells():
    for axes, bits in ((2, 4), (3, 3), (5, 2), (1, 5)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = N.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(120)]
    rows += [(1000 + k, rows[3][1]) for k in range(60)] + [(2001, [x * 2 for x in rows[3][1]]), (2002, [-x for x in rows[3][1]])]
    rows += [(7, None), (14, []), (3001, [0.0] * 8), (3003, [1.0] * 7 + [float("nan")]), (3004, [1.0] * 7 + [None]), (3005, [1.0] * 7),
             (3006, [float("inf")] + [1.0] * 7), (None, rows[4][1]), (21, rows[21][1]), (3010, [-0.0] * 7 + [1e-200]), (3011, [0.0] * 7 + [1e200])]
    exp = brute([r for r in rows if r[0] not in (3010, 3011)])  # their squares leave the doubles' range
    found = search(spark, rows)
    mine = {q: [x for x in v if x[1] not in (3010, 3011)] for q, v in found.items()}
    assert mine.keys() >= exp.keys()
    good = sum(len({i for _, i in mine[q]} & {i for _, i in exp[q]}) for q in exp)
    assert good >= 0.9 * sum(map(len, exp.values()))
    hot = [q for q in exp if 1000 <= q < 1060]
    assert hot and all([i for _, i in mine[q]][:5] == [i for _, i in exp[q]][:5] for q in hot)


def test_fewer_candidates_than_asked_and_empty_table(spark):
    rows = [(7, [1.0] * 8), (8, [1.0] * 4 + [0.5] * 4), (9, [0.1] + [1.0] * 7)]
    assert search(spark, rows) == brute(rows)
    assert search(spark, rows[:1]) == {} and search(spark, []) == {}
    assert search(spark, rows[1:]) == {}


def test_recall_on_the_test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = {(r.query_id, r.vec_id) for r in N.nearest(rows, F.col("vec_id") % 50 == 0).collect()}
    data = rows.select("vec_id", "embedding").collect()
    ids, unit = np.array([r[0] for r in data]), N.units(np.array([r[1] for r in data], dtype=float))
    total = hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        s[q] = -2
        top = np.argsort(-s)[:5]
        hits += sum((int(ids[q]), int(i)) in found for i in ids[top])
        total += 5
    assert hits >= 0.9 * total


def test_each_length_is_searched_on_its_own(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(40)] + [(100 + k, rng.normal(size=3).tolist()) for k in range(30)]
    found = search(spark, rows)
    assert set(found) == {i for i, _ in rows if i % 7 == 0}
    assert all(len(v) == 5 and all((i >= 100) == (q >= 100) for _, i in v) for q, v in found.items())
    for q in (105, 112):
        a = np.array(dict(rows)[q])
        best = sorted((-round(float(a @ b / np.sqrt((a @ a) * (np.dot(b, b)))), 12), i) for i, b in rows if i >= 100 and i != q)[:5]
        assert found[q] == best
