"""Drift between two states of a graph: churn, coverage, confidence, structure, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.graph import type_of_id
from strataweave.operators.quality import capped


def node_key(entities: DataFrame) -> DataFrame:
    """Entities with `key`: the id, else the title."""
    return entities.withColumn("key", F.coalesce(F.nullif("id", F.lit("")), F.nullif("title", F.lit("")))).filter("key is not null")


# Each function takes `by`, columns of both states that name a pair of states; results are per pair. Without them there is one pair.


def _state(entities: DataFrame, connections: DataFrame, by: tuple[str, ...]) -> DataFrame:
    links = connections.groupBy(*by, F.col("source_id").alias("key")).agg(F.array_sort(F.collect_set(F.struct("target_id", "confidence"))).alias("links"))
    rows = node_key(entities).groupBy(*by, "bucket", "key").agg(F.max_by("title", "ord").alias("title"), F.max_by("description", "ord").alias("description"))
    return rows.join(links, [*by, "key"], "left").select(*by, "bucket", "key", F.struct("title", "description", "links").alias("own"))


def node_churn(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """Per bucket: added, removed, modified, totals, share of changes; states are (entities, connections)."""
    a, b = (_state(*state, by).withColumnRenamed("own", name) for state, name in ((before, "a"), (after, "b")))
    old, new = F.col("a").isNotNull(), F.col("b").isNotNull()
    out = a.join(b, [*by, "bucket", "key"], "full_outer").groupBy(*by, "bucket").agg(
        F.count_if(new & ~old).alias("added"), F.count_if(old & ~new).alias("removed"), F.count_if(old & new & ~F.col("a").eqNullSafe(F.col("b"))).alias("modified"),
        F.count_if(old).alias("before"), F.count_if(new).alias("after"),
    )
    return out.withColumn("rate", F.round((F.col("added") + F.col("removed") + F.col("modified")) / F.greatest(F.col("before"), F.lit(1)), 6))


def _kind() -> Column:
    return F.concat(type_of_id(F.col("source_id")), F.lit("-"), type_of_id(F.col("target_id"))).alias("kind")


def edge_churn(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per kind: edges added, removed, kept. An edge with another confidence is another edge."""
    a, b = (df.select(*by, _kind(), "source_id", "target_id", "confidence").distinct() for df in (before, after))
    part = lambda df, name: df.select(*by, "kind", F.lit(name).alias("what"))
    rows = part(b.subtract(a), "added").union(part(a.subtract(b), "removed")).union(part(a.intersect(b), "kept"))
    n = lambda w: F.count_if(F.col("what") == w).alias(w)
    out = rows.groupBy(*by, "kind").agg(n("added"), n("removed"), n("kept"))
    return out.withColumn("rate", F.round((F.col("added") + F.col("removed")) / F.greatest(F.col("removed") + F.col("kept"), F.lit(1)), 6))


def coverage_delta(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    def side(state: tuple[DataFrame, DataFrame], name: str) -> DataFrame:
        linked = state[1].select(*by, F.col("source_id").alias("id")).distinct().withColumn("linked", F.lit(1))
        return state[0].join(linked, [*by, "id"], "left").groupBy(*by, "bucket").agg(F.avg(F.coalesce("linked", F.lit(0))).alias(name))

    both = side(before, "before").join(side(after, "after"), [*by, "bucket"], "full_outer").fillna(0.0, ["before", "after"])
    r = lambda c: F.round(c, 6).alias(c)
    return both.select(*by, "bucket", r("before"), r("after"), F.round(F.col("after") - F.col("before"), 6).alias("delta"))


def confidence_drift(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean confidence per kind on both sides; a side without the kind counts as 0."""
    side = lambda df, s: df.groupBy(*by, _kind()).agg(F.avg("confidence").alias(f"mean_{s}"), F.count(F.lit(1)).alias(f"n_{s}"))
    both = side(before, "before").join(side(after, "after"), [*by, "kind"], "full_outer").fillna(0, ["mean_before", "mean_after", "n_before", "n_after"])
    return both.select(*by, "kind", F.round("mean_before", 6).alias("mean_before"), F.round("mean_after", 6).alias("mean_after"), "n_before", "n_after", F.round(F.col("mean_after") - F.col("mean_before"), 6).alias("delta"))


def _signature(entities: DataFrame, connections: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Bucketed counts as a set of words: nodes by tens, edges by fives."""
    mark = lambda what, step: F.concat_ws("_", F.lit(what), "name", (F.floor(F.col("n") / step) * step).cast("string")).alias("word")
    nodes = entities.groupBy(*by, F.col("bucket").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(*by, mark("nodes", 10))
    edges = connections.groupBy(*by, _kind().alias("name")).agg(F.count(F.lit(1)).alias("n")).select(*by, mark("edges", 5))
    return nodes.union(edges)


def structural_similarity(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    a, b = (_signature(*state, by).withColumn(name, F.lit(1)) for state, name in ((before, "a"), (after, "b")))
    counts = a.join(b, [*by, "word"], "full_outer")
    return counts.groupBy(*by).agg(F.round(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count(F.lit(1)), 6).alias("similarity"))


def overall_churn(node_rate: Column, edge_rate: Column) -> Column:
    return 0.7 * node_rate + 0.3 * edge_rate


def stability(nodes: DataFrame, edges: DataFrame, coverage: DataFrame, confidence: DataFrame, similarity: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row a pair: churn, stability score and grade, most volatile bucket. The similarity term goes below 0 as published."""
    n = nodes.groupBy(*by).agg(F.avg("rate").alias("node"), F.max_by("bucket", F.struct("rate", "bucket")).alias("volatile"))
    e = edges.groupBy(*by).agg(F.avg("rate").alias("edge"))
    c = coverage.groupBy(*by).agg(F.max(F.abs("delta")).alias("coverage"))
    d = confidence.groupBy(*by).agg(F.max(F.abs("delta")).alias("drift"))
    row = n
    for part in (e, c, d, similarity):
        row = row.join(part, list(by), "left") if by else row.join(F.broadcast(part))  # without `by` one row each
    score = 100 - capped(50 * F.col("node"), 40) - capped(40 * F.col("edge"), 30) - capped(30 * F.col("coverage"), 15) - capped(20 * F.col("drift"), 10) + F.least(F.lit(5.0), 25 * (F.col("similarity") - 0.8))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    grade = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    advice = F.array_compact(F.array(F.when(F.col("node") > 0.3, "nodes change much"), F.when(F.col("edge") > 0.3, "edges change much"), F.when(F.col("coverage") > 0.1, "coverage moves"), F.when(F.col("drift") > 0.1, "confidence drifts")))
    return row.select(*by, F.round(overall_churn(F.col("node"), F.col("edge")), 6).alias("churn"), F.round(score, 6).alias("score"), grade.alias("grade"), "volatile", F.concat_ws("; ", advice).alias("advice"))
