"""Connected components by alternating large and small stars, as DataFrame joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SALTS = 8
ROUNDS = 60


def _with_least(pairs: DataFrame) -> DataFrame:
    """``u, v, m``: every pair with the least of ``u`` and all its ``v``.

    The least values are found by a partial aggregate; the join back is
    salted, so that the pairs of one large hub spread over tasks.
    """
    least = (pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"]).drop("salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge; the component is its least node.

    ``edges`` is read twice and should be a written table; repeated edges are harmless.
    Each round replaces edges by edges to the least neighbour; it ends when
    every node points at the least node of its component.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    for _ in range(ROUNDS):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(_with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "links")
        least = _with_least(large)
        links = staged(least.select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        # Done when every node has one parent and no parent has a parent: all links point at roots.
        ends = links.select("u", F.lit(1).alias("parents"), F.lit(0).alias("children")).unionAll(
            links.select("v", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("u").agg(F.sum("parents").alias("p"), F.max("children").alias("c")).where("p > 1 or p = 1 and c = 1")
        if open_.isEmpty():
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
