"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lagline.staging import release, staged, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: bigint); root is the component's least node.

    Each round keeps at most one edge per node and component tie, so nothing grows; a node
    with many neighbours is only ever aggregated to its least one and joined back. Self
    loops and repeated edges are harmless. No edges give no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    spark, start = edges.sparkSession, len(written())
    now = staged(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        old = written(start)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(spark, old)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Count and two sums without carries of the distinct edges; they tell whether the edges have changed."""
    hashes = F.xxhash64("a", "b"), F.xxhash64("b", "a", F.lit(1))
    return tuple(edges.agg(F.count(F.lit(1)), *(F.coalesce(F.bit_xor(h), F.lit(0)) for h in hashes)).first())
