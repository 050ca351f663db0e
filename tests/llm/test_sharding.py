"""Shards: the law, gapless slots, and the same rows as the input."""
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from varilens.llm.sharding import write_shards

SCHEMA = "doc_id long, text string, shard string, record int, ticket string"


def rows_of(spark, rows, **options):
    return write_shards(spark.createDataFrame(rows, SCHEMA), **options).collect()


def check(rows, found, n_shards):
    assert Counter(tuple(r.record) for r in found) == Counter(rows)
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(slots.get(s, [])) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_law_with_hot_copies_nulls_long_texts_and_clashing_names(spark):
    rows = [(1, "same", "s", 1, None)] * 40 + [(k, f"text {k}", None, None, "t") for k in range(55)]
    rows += [(None, None, None, None, None)] * 3 + [(7, "", "x", 0, ""), (8, "ü" * 300_000, "x", 0, "")]
    found = rows_of(spark, rows, n_shards=24, bucket_bytes=2000)
    check(rows, found, 24)


def test_fewer_rows_than_shards_and_empty_table(spark):
    rows = [(k, str(k), None, None, None) for k in range(5)]
    check(rows, rows_of(spark, rows, n_shards=24), 24)
    assert rows_of(spark, []) == []


def test_order_is_mixed_and_follows_the_seed(spark):
    rows = [(k, str(k), None, None, None) for k in range(400)]
    def order(seed):
        found = sorted(rows_of(spark, rows, n_shards=4, seed=seed), key=lambda r: (r.shard, r.slot))
        return [r.record.doc_id for r in found]
    one, again, other = order(1), order(1), order(2)
    assert one == again and one != other
    assert sum(abs(a - b) == 1 for a, b in zip(one, one[1:])) < 20  # neighbours rarely stay together


def test_a_task_writes_one_bucket(spark, tmp_path):
    rows = [(k, str(k), None, None, None) for k in range(4000)]
    found = write_shards(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/shards", n_shards=4, min_buckets=16)
    task = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("task")
    counts = [r["count"] for r in found.groupBy(task).count().collect()]
    assert len(counts) == 16 and max(counts) < 2 * 4000 / 16
    check(rows, found.collect(), 4)


SMALL_HEAP = """
from pyspark.sql import functions as F
from varilens.llm.sharding import write_shards
from varilens.session import local_session
docs = local_session(2).range(120_000).select("id", F.concat(F.col("id"), F.repeat(F.lit("x"), 2000)).alias("text"))
found = write_shards(docs, n_shards=3, min_buckets=2).groupBy("shard").agg(
    F.count("*"), F.count_distinct("slot"), F.max("slot"), F.sum("record.id"))
rows = found.orderBy("shard").collect()
assert [tuple(r[:4]) for r in rows] == [(s, 40_000, 40_000, 39_999) for s in range(3)], rows
assert sum(r[4] for r in rows) == 120_000 * 119_999 // 2
"""


def test_buckets_larger_than_the_memory_of_their_tasks():
    """240 MB in four buckets of 64 MB at most, two at a time in a heap of 512 MB."""
    ran = subprocess.run([sys.executable, "-c", SMALL_HEAP], cwd=Path(__file__).parents[2], timeout=300,
                         env=os.environ | {"VARILENS_DRIVER_MEMORY": "512m"}, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr[-2000:]
