"""Two-pass external shuffle into equally long shards (DataFrame functions only).

Pass 1 deals every record into one of ``n_buckets`` memory-sized buckets by a
seeded hash of its ticket (its place in the input) and writes this table, so
later steps reread files instead of repeating the deal.  Pass 2 orders the
tickets of each bucket, permutes them by Fisher-Yates (``shuffle`` with a
seed), brings each bucket's records to a task of its own, puts them in the
order of the permuted tickets and writes them.  Buckets laid end to end form
one random order of all records; shard ``s`` is the ``s``-th of ``n_shards``
equal slices of it, so shard counts differ by one at most and a bucket writes
to one or two shards.

Only tickets are gathered into arrays.  Records pass through sorts, which
spill when a bucket is larger than its task's share of memory.

The ticket, not a key, is hashed: copies of a text or of a key spread like
any other rows.  The input should be a table scan or another source whose
partitions a retried task sees again in the same order; a shuffle comes out
the same again only for the same rows, seed and split of the input.

Defined results: NULL and empty texts are records of size 8; repeated rows
are kept, each in its own slot; an empty table gives no shard; the input's
columns travel inside one struct ``record``, so no name can clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import staged

GROUP = 4096  # buckets per group of the two-level prefix sum
TICKET_BYTES = 64  # what a ticket takes in the arrays of a task
SMALL_BYTES = 10 << 20  # up to this size one generator permutes all buckets, as when Spark broadcast such a table


def _offsets(scattered: DataFrame) -> DataFrame:
    """(bucket, offset): records in the buckets before; a two-level running sum, so no task sees all buckets' rows."""
    counts = (scattered.groupBy("bucket").agg(F.count("*").alias("n"))
              .withColumn("grp", F.floor(F.col("bucket") / GROUP)))
    inner = Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = (counts.groupBy("grp").agg(F.sum("n").alias("n"))
              .select("grp", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("start")))
    return (counts.withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(groups, "grp")
            .select("bucket", (F.col("start") + F.col("inside")).alias("offset")))


def write_shards(docs: DataFrame, path: str | None = None, *, n_shards: int = 24, seed: int = 20240229,
                 size_col: str = "text", bucket_bytes: int = 64 << 20, min_buckets: int = 64) -> DataFrame:
    """Shuffle ``docs`` into ``n_shards`` written shards; returns the reread files: ``record, shard, slot``.

    ``bucket_bytes`` is what one task holds in memory (of records, or of
    tickets at ``TICKET_BYTES`` each where records are shorter); there are at
    least ``min_buckets`` buckets.  ``path`` defaults to a folder in the shared
    checkpoint folder.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    size = F.coalesce(F.octet_length(F.col(size_col)).cast("long"), F.lit(0)) + 8
    total, records = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    n_buckets = max(min_buckets, math.ceil(max(total, records * TICKET_BYTES) / bucket_bytes))

    scattered = staged(
        docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("record"))
        .withColumn("ticket", F.monotonically_increasing_id())
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("ticket")), F.lit(n_buckets).cast("long"))),
        "scatter")
    n = scattered.count()
    task = F.col("bucket").cast("int").alias("task")  # hashing the bucket again would give some tasks several

    buckets = (scattered.select("bucket", "ticket").repartition(n_buckets, "bucket").groupBy("bucket")
               .agg(F.sort_array(F.collect_list("ticket")).alias("tickets")))
    if total <= SMALL_BYTES:
        buckets = buckets.coalesce(1)
    shuffled = (buckets.sortWithinPartitions("bucket")  # the generator of a partition meets its buckets in this order
                .withColumn("tickets", F.shuffle("tickets", seed)))  # before a join, which could deal the buckets anew
    places = (shuffled.join(_offsets(scattered), "bucket")
              .select(task, "offset", F.posexplode("tickets").alias("pos", "ticket"))
              .select("task", "ticket", (F.col("offset") + F.col("pos")).alias("place")))
    placed = (scattered.select("record", "ticket", task).repartitionById(n_buckets, "task")
              .join(places.repartitionById(n_buckets, "task"), ["task", "ticket"])
              .withColumn("shard", F.expr(f"cast(place * {n_shards} div {max(n, 1)} as int)"))
              .withColumn("slot", F.col("place") - F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}"))
              .select("record", "shard", "slot"))
    (placed.sortWithinPartitions("shard", "slot").write.option("compression", "zstd")
     .partitionBy("shard").parquet(path))
    return spark.read.schema(placed.schema).parquet(path)
