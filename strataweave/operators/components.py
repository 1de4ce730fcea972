"""Connected components by alternating large-star and small-star steps.

Each step is a map-side combined minimum per node and an equi-join, so a node with very many
neighbours is never collected. Every round is written to the shared folder, which keeps the
plan small and lets a lost executor be replaced by a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.session import materialize


def _least(pairs: DataFrame, keep_smaller: bool) -> DataFrame:
    """(node, next) pairs to (next, least) edges: large-star, or small-star with keep_smaller."""
    least = pairs.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.col("n")).alias("m"))
    linked = pairs.join(least, pairs.u == least.n)
    if keep_smaller:
        moved = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("n", "m"))
    else:
        moved = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct().select(F.col("a").alias("u"), F.col("b").alias("v"))


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of `edges` (u, v BIGINT); component: the least node reachable.

    Nulls and loops link nothing. No edges, no rows.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(now.filter("u is not null and v is not null and u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        large = _least(both, keep_smaller=False)
        now = materialize(_least(large, keep_smaller=True), "star")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)
