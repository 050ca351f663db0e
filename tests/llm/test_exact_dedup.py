"""Groups against a dictionary; the filter against counts; odd inputs; which rows shuffle."""
import hashlib
import random

import numpy as np

from varilens.llm import exact_dedup as E
from varilens.llm.queries import ORACLE, QUERIES

from .conftest_llm import SF

SHAPE = "doc_id int, text string, digest int"


def expected(rows):
    groups = {}
    for ident, text, *_ in rows:
        groups.setdefault((text or "").translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))), []).append((ident, text or ""))
    out = []
    for norm, own in groups.items():
        order = sorted(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out += [(i, order[0][0], len(own), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, (i, _) in enumerate(order)]
    return sorted(out, key=str)


def some_rows(seed, n):
    rnd = random.Random(seed)
    words = ["a", "b c", "é", "a ", " a", " ", "", None, "😀 b", "x\ty", "xy", "x\x0by\r", "A"]
    rows = [(i, rnd.choice(words) if rnd.random() < .5 else f"text {rnd.randrange(n)}" + " " * rnd.randrange(3), i) for i in range(n)]
    return rows + [(None, "a", 1), (None, "alone", 1), (5, rows[5][1], 1), (7, "t" * 1_000_000, 2), (8, "t " * 1_000_000, 3)]


def test_groups_equal_a_dictionary(spark):
    rows = some_rows(1, 3000)
    got = E.marked(spark.createDataFrame(rows, SHAPE).repartition(7))
    assert sorted((tuple(r[:4]) + (r["digest"].hex(),) for r in got.collect()), key=str) == expected(rows)


def test_one_row_of_each_group_stays_whole(spark):
    rows = some_rows(2, 2000)
    docs = spark.createDataFrame(rows, SHAPE).repartition(5)
    got = E.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(((r[0], hashlib.sha256("".join((r[1] or "").translate(dict.fromkeys(map(ord, E.BLANKS)))).encode()).hexdigest())
                   for r in got.collect()), key=str) == sorted(((r[0], r[4]) for r in expected(rows) if r[3]), key=str)
    assert {tuple(r) for r in got.collect()} <= set(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SHAPE)
    assert E.marked(docs).count() == 0 and E.deduplicated(docs).count() == 0


def test_filter_passes_every_repeat_and_few_others(spark):
    n = 60_000
    hashes = spark.range(n, numPartitions=9).selectExpr("xxhash64(id) as h").unionAll(
        spark.range(500).selectExpr("xxhash64(id * 100) as h"))
    again = E.repeat_filter(hashes.repartition(6), n)
    asked = np.array([r[0] for r in spark.range(n).selectExpr("xxhash64(id) as h").collect()])
    passed = E.TwoStepBits.get(again, E.positions(asked, len(again) * 8)).all(axis=1)
    assert passed[np.arange(500) * 100].all()
    assert passed.sum() < 500 + n // 100
    assert E.filter_bits(10 ** 12) == E.MAX_BITS


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = some_rows(3, 1500)
    monkeypatch.setattr(E, "MIN_BITS", 1 << 15)
    monkeypatch.setattr(E, "MAX_BITS", 1 << 15)
    monkeypatch.setattr(E, "BITS_PER_ROW", 1)
    got = E.marked(spark.createDataFrame(rows, SHAPE).repartition(3))
    assert sorted((tuple(r[:4]) + (r["digest"].hex(),) for r in got.collect()), key=str) == expected(rows)


def test_packing():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 50, 255, 256, 2000, 4096):
        bits = np.zeros(E.RANGE_BITS >> 3, np.uint8)
        bits[rnd.choice(len(bits), n, replace=False)] = rnd.integers(1, 256, n)
        assert (E._unpacked(E._packed(bits)) == bits).all()


def test_query_equals_its_sql(spark):
    import duckdb
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = duckdb.sql(ORACLE["op11_exact_dedup"]).fetchall()
    got = [tuple(r) for r in QUERIES["op11_exact_dedup"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
