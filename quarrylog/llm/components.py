"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Every step is a minimum per node (combined before the shuffle) joined back to the edges, so a hub's edges are
never gathered in one task; adaptive execution splits a skewed join. Each round is a written table, and the
rounds needed grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrylog.llm.common import drop_written, written

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(a, b) with a > b, no repeats."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        new = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        new = linked.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return new.where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in a link, the component named by its smallest node. Links may repeat and
    come in either direction; loops and links with NULL count for nothing. No links: no rows."""
    pair = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = written(pair.distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or now == seen:
            break
        seen = now
        after = written(_star(_star(edges, True), False), "edges")
        drop_written(edges)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # settled: every node points to its component's smallest node
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
