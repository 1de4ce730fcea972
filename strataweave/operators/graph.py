"""Graph construction and graph analytics over many runs at once.

entities: run_id, bucket, bucket_ord, id, ord, title, description
connections: run_id, bucket, source_id, conn_ord, target_id, confidence
nodes: run_id, node, type, name, pos (place of first insertion)
edges: run_id, u, v, confidence; u < v, one row per undirected pair
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.session import materialize

BUCKETS = ("action_fields", "projects", "measures", "indicators")
TYPES = ("action_field", "project", "measure", "indicator")


def type_of_bucket(bucket: Column) -> Column:
    out = F.lit("unknown")
    for b, t in zip(BUCKETS, TYPES, strict=True):
        out = F.when(bucket == b, t).otherwise(out)
    return out


def type_of_id(node: Column) -> Column:
    """Short type by id prefix: af, proj, msr, ind or unknown."""
    out = F.lit("unknown")
    for t in ("ind", "msr", "proj", "af"):
        out = F.when(node.startswith(f"{t}_"), t).otherwise(out)
    return out


def build_nodes(entities: DataFrame) -> DataFrame:
    """A repeated id keeps its first place and its last type and name."""
    at = F.struct("bucket_ord", "ord")
    named = entities.filter(F.coalesce("id", F.lit("")) != "").groupBy("run_id", F.col("id").alias("node"))
    return named.agg(
        F.max_by(type_of_bucket(F.col("bucket")), at).alias("type"), F.max_by("title", at).alias("name"), F.min(at).alias("pos")
    )


def build_edges(nodes: DataFrame, connections: DataFrame) -> DataFrame:
    """Undirected simple edges between nodes; of several confidences the largest counts."""
    keys = nodes.select("run_id", "node")
    kept = connections.join(keys.withColumnRenamed("node", "target_id"), ["run_id", "target_id"], "left_semi")
    kept = kept.join(keys.withColumnRenamed("node", "source_id"), ["run_id", "source_id"], "left_semi")
    u, v = F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v")
    return kept.groupBy("run_id", u, v).agg(F.max("confidence").alias("confidence"))


def hierarchical_nodes_edges(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a nested layout: run_id, action_fields array of structs.

    Nodes are named by title (`af:`, `proj:`, `msr:`, `ind:`), so equal titles are one node; blank names are skipped.
    """
    af = tree.select("run_id", F.posexplode_outer("action_fields").alias("a_ord", "a")).select(
        "run_id", "a_ord", F.concat(F.lit("af:"), F.trim("a.action_field")).alias("af"), F.col("a.projects").alias("projects")
    ).filter("af <> 'af:'")
    proj = af.select("run_id", "af", F.posexplode("projects").alias("p_ord", "p")).select(
        "run_id", "af", F.concat(F.lit("proj:"), F.trim("p.title")).alias("proj"), "p.measures", "p.indicators"
    ).filter("proj <> 'proj:'")
    leaf = lambda column, mark: proj.select("run_id", "proj", F.explode(column).alias("t")).select(
        "run_id", "proj", F.concat(F.lit(mark), F.trim("t")).alias("leaf")
    ).filter(F.col("leaf") != mark)
    msr, ind = leaf("measures", "msr:"), leaf("indicators", "ind:")
    typed = [(af, "af", "action_field"), (proj, "proj", "project"), (msr, "leaf", "measure"), (ind, "leaf", "indicator")]
    nodes = None
    for df, c, t in typed:
        part = df.select("run_id", F.col(c).alias("node"), F.lit(t).alias("type"), F.regexp_replace(c, "^[a-z]+:", "").alias("name"))
        nodes = part if nodes is None else nodes.union(part)
    pairs = proj.select("run_id", F.col("af").alias("a"), F.col("proj").alias("b")).union(msr.select("run_id", "proj", "leaf")).union(ind.select("run_id", "proj", "leaf"))
    edges = pairs.select("run_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    return nodes.distinct(), edges


def ends(edges: DataFrame) -> DataFrame:
    """Both directions: run_id, node, other."""
    return edges.select("run_id", F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select("run_id", "v", "u"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with degree; a loop counts twice, isolated nodes have 0."""
    count = ends(edges).groupBy("run_id", "node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(count, ["run_id", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))


def nodes_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("run_id", "type").agg(F.count(F.lit(1)).alias("n"))


def edges_by_relation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by type pair, in both directions unless the types are the same."""
    kinds = nodes.select("run_id", "node", "type")
    typed = edges.join(kinds.select("run_id", F.col("node").alias("u"), F.col("type").alias("a")), ["run_id", "u"])
    typed = typed.join(kinds.select("run_id", F.col("node").alias("v"), F.col("type").alias("b")), ["run_id", "v"])
    name = lambda x, y: F.concat(F.col(x), F.lit("_to_"), F.col(y))
    relations = F.when(F.col("a") == F.col("b"), F.array(name("a", "b"))).otherwise(F.array(name("a", "b"), name("b", "a")))
    return typed.select("run_id", F.explode(relations).alias("relation")).groupBy("run_id", "relation").agg(F.count(F.lit(1)).alias("n"))


def degree_by_type(degree: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return degree.groupBy("run_id", "type").agg(
        F.count(F.lit(1)).alias("n"),
        r(F.avg("degree")).alias("mean"),
        r(F.median("degree")).alias("median"),
        F.min("degree").alias("least"),
        F.max("degree").alias("most"),
        r(F.stddev_pop("degree")).alias("std"),
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, node, component: the smallest node reachable.

    String nodes are ranked once, so the label contraction runs on longs; isolated nodes stay alone. A leaf, a node with one neighbour,
    takes that neighbour's label, so the rounds of the contraction see no leaves (but where both ends of an edge are leaves).
    """
    from strataweave.operators.components import connected_components

    number = F.xxhash64("run_id", "node")
    ids = nodes.select("run_id", "node", number.alias("k"))
    pairs = edges.select(F.xxhash64("run_id", "u").alias("u"), F.xxhash64("run_id", "v").alias("v")).where("u <> v")
    near = pairs.union(pairs.select("v", "u")).groupBy(F.col("u").alias("leaf")).agg(F.min("v").alias("hub"), F.max("v").alias("most"))
    ends_ = materialize(near.where("hub = most").select("leaf", "hub"), "leaves")
    leaves = ends_.join(ends_.select(F.col("leaf").alias("hub")), "hub", "left_anti").select("leaf", "hub")
    inner = pairs.join(leaves.select(F.col("leaf").alias("u")), "u", "left_anti").join(leaves.select(F.col("leaf").alias("v")), "v", "left_anti")
    label = connected_components(inner.select("u", "v"))
    of = ids.join(leaves, ids.k == leaves.leaf, "left").select("run_id", "node", F.coalesce("hub", "k").alias("k"))
    named = of.join(label.withColumnRenamed("node", "at"), F.col("k") == F.col("at"), "left").select("run_id", "node", F.coalesce("component", "k").alias("c"))
    least = named.groupBy("run_id", "c").agg(F.min("node").alias("component"))
    return named.join(least, ["run_id", "c"]).select("run_id", "node", "component")


def summary(degree: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes, edges, components, isolated nodes, degree statistics, largest component."""
    size = labels.groupBy("run_id", "component").agg(F.count(F.lit(1)).alias("size"))
    parts = size.groupBy("run_id").agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"))
    count = edges.groupBy("run_id").agg(F.count(F.lit(1)).alias("edges"))
    base = degree.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("degree") == 0).alias("isolated"),
        F.round(F.avg("degree"), 6).alias("mean_degree"),
        F.round(F.median("degree"), 6).alias("median_degree"),
        F.max("degree").alias("max_degree"),
    )
    return base.join(count, "run_id", "left").join(parts, "run_id").fillna(0, ["edges"])


def action_field_coverage(nodes: DataFrame, edges: DataFrame, degree: DataFrame, ordered_edge: bool = False) -> DataFrame:
    """Share of action fields with a neighbour (with `ordered_edge`: one inserted not later than itself)."""
    if ordered_edge:
        at = nodes.select("run_id", F.col("node").alias("other"), F.col("pos").alias("other_pos"))
        linked = ends(edges).join(at, ["run_id", "other"]).join(nodes, ["run_id", "node"]).filter("other_pos <= pos")
        kept = linked.select("run_id", "node").distinct().withColumn("linked", F.lit(1))
        fields = nodes.filter("type = 'action_field'").join(kept, ["run_id", "node"], "left")
        return fields.groupBy("run_id").agg(F.round(F.avg(F.coalesce("linked", F.lit(0))), 6).alias("coverage"))
    fields = degree.filter("type = 'action_field'")
    return fields.groupBy("run_id").agg(F.round(F.avg((F.col("degree") > 0).cast("int")), 6).alias("coverage"))


def project_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of projects with both an action field and a measure as neighbours."""
    kinds = nodes.select("run_id", F.col("node").alias("other"), F.col("type").alias("kind"))
    near = ends(edges).join(kinds, ["run_id", "other"]).groupBy("run_id", "node").agg(
        F.bool_or(F.col("kind") == "action_field").alias("af"), F.bool_or(F.col("kind") == "measure").alias("msr")
    )
    projects = nodes.filter("type = 'project'").join(near, ["run_id", "node"], "left")
    return projects.groupBy("run_id").agg(F.round(F.avg(F.coalesce((F.col("af") & F.col("msr")).cast("int"), F.lit(0))), 6).alias("coverage"))


def measures_per_project(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, node, measures for each project, none included."""
    measures = nodes.filter("type = 'measure'").select("run_id", F.col("node").alias("other"))
    count = ends(edges).join(measures, ["run_id", "other"]).groupBy("run_id", "node").agg(F.count(F.lit(1)).alias("measures"))
    projects = nodes.filter("type = 'project'").select("run_id", "node")
    return projects.join(count, ["run_id", "node"], "left").fillna(0, ["measures"])


def detailed_coverage(degree: DataFrame) -> DataFrame:
    """Per type: total, connected, isolated, rate, mean degree; all four types, also absent ones."""
    grid = degree.select("run_id").distinct().withColumn("type", F.explode(F.array(*map(F.lit, TYPES))))
    found = degree.groupBy("run_id", "type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("degree") > 0).alias("connected"), F.avg("degree").alias("mean_degree")
    )
    out = grid.join(found, ["run_id", "type"], "left").fillna(0, ["total", "connected"]).fillna(0.0, ["mean_degree"])
    rate = F.when(F.col("total") > 0, F.col("connected") / F.col("total")).otherwise(0.0)
    return out.select("run_id", "type", "total", "connected", (F.col("total") - F.col("connected")).alias("isolated"),
                      F.round(rate, 6).alias("rate"), F.round("mean_degree", 6).alias("mean_degree"))


def two_cycles(edges: DataFrame, limit: int = 20) -> DataFrame:
    """Every undirected edge is a cycle of two in the bidirected graph: the first `limit` per run, in order."""
    first = Window.partitionBy("run_id").orderBy("u", "v")
    return edges.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit).select("run_id", "rank", "u", "v")


def cyclomatic(degree: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Independent cycles: edges - nodes + components."""
    return summary(degree, edges, labels).select("run_id", (F.col("edges") - F.col("nodes") + F.col("components")).alias("cycles"))


def distances(edges: DataFrame, starts: DataFrame, most: int = 10_000) -> DataFrame:
    """run_id, start, node, distance: level by level from each start, `starts` (run_id, start). A graph of more than `most` levels is an error."""
    step = materialize(ends(edges), "ends")
    seen = starts.select("run_id", "start", F.col("start").alias("node"), F.lit(0).alias("distance"))
    front = seen
    for level in range(1, most + 1):
        near = front.select("run_id", "start", "node").join(step, ["run_id", "node"]).select("run_id", "start", F.col("other").alias("node")).distinct()
        front = near.join(seen, ["run_id", "start", "node"], "left_anti").withColumn("distance", F.lit(level))
        front = materialize(front, "front")
        if not front.take(1):
            break
        seen = materialize(seen.union(front), "seen")
    else:
        raise RuntimeError(f"a graph of more than {most} levels")
    return seen


def path_lengths(distance: DataFrame) -> DataFrame:
    """Over ordered pairs of distinct nodes: mean, diameter, least distance, true radius, pairs."""
    far = distance.groupBy("run_id", "start").agg(F.max("distance").alias("ecc"))
    radius = far.groupBy("run_id").agg(F.min("ecc").alias("radius"))
    return distance.filter("distance > 0").groupBy("run_id").agg(
        F.round(F.avg("distance"), 6).alias("mean"), F.max("distance").alias("diameter"), F.min("distance").alias("min_path"), F.count(F.lit(1)).alias("pairs")
    ).join(radius, "run_id")


def degree_centrality(degree: DataFrame) -> DataFrame:
    total = Window.partitionBy("run_id")
    n = F.count(F.lit(1)).over(total)
    return degree.select("run_id", "node", "type", F.when(n > 1, F.col("degree") / (n - 1)).otherwise(1.0).alias("centrality"))


def centrality_summary(values: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return values.groupBy("run_id").agg(r(F.avg("centrality")).alias("mean"), r(F.max("centrality")).alias("most"), r(F.min("centrality")).alias("least"), r(F.stddev_pop("centrality")).alias("std"))


def closeness(distance: DataFrame, nodes: DataFrame) -> DataFrame:
    """Closeness with the correction for parts that are not reached."""
    size = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    reach = distance.groupBy("run_id", F.col("start").alias("node")).agg(F.sum("distance").alias("far"), F.count(F.lit(1)).alias("reached"))
    value = F.when((F.col("far") > 0) & (F.col("n") > 1), (F.col("reached") - 1) / F.col("far") * (F.col("reached") - 1) / (F.col("n") - 1)).otherwise(0.0)
    return reach.join(size, "run_id").select("run_id", "node", value.alias("centrality"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int | None = None, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """run_id, node, rank; nodes without edges spread evenly.

    After a fixed number of rounds, or without one when the ranks of every run move by less than `tolerance` a node in sum; `most` rounds without
    that are an error.
    """
    step = materialize(ends(edges), "ends")
    out = step.groupBy("run_id", "node").agg(F.count(F.lit(1)).alias("out"))
    size = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    base = materialize(nodes.select("run_id", "node").join(size, "run_id").join(out, ["run_id", "node"], "left"), "rank-nodes")
    rank = base.select("run_id", "node", "n", "out", (1.0 / F.col("n")).alias("rank"))
    for i in range(most if rounds is None else rounds):
        given = rank.filter("out is not null").select("run_id", "node", (F.col("rank") / F.col("out")).alias("part"))
        got = given.join(step, ["run_id", "node"]).groupBy("run_id", F.col("other").alias("node")).agg(F.sum("part").alias("got"))
        loose = rank.groupBy("run_id").agg(F.sum(F.when(F.col("out").isNull(), F.col("rank")).otherwise(0.0)).alias("loose"))
        new = rank.join(got, ["run_id", "node"], "left").join(loose, "run_id")
        value = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / F.col("n"))
        moved = new.select("run_id", "node", "n", "out", value.alias("rank"), F.abs(value - F.col("rank")).alias("moved"))
        if rounds is None:
            moved = materialize(moved, "rank")
            rank = moved.drop("moved")
            if not moved.groupBy("run_id").agg(F.sum("moved").alias("moved"), F.max("n").alias("n")).filter(F.col("moved") >= F.col("n") * tolerance).take(1):
                break
        else:
            rank = materialize(moved.drop("moved"), "rank") if i % 3 == 2 else moved.drop("moved")
    else:
        if rounds is None:
            raise RuntimeError(f"ranks did not settle in {most} rounds")
    return rank.select("run_id", "node", "rank")


def redundant_shortcuts(connections: DataFrame) -> DataFrame:
    """Connections without the action field - measure ones that a project between makes redundant."""
    kind = lambda c: type_of_id(F.col(c))
    typed = connections.withColumn("s_type", kind("source_id")).withColumn("t_type", kind("target_id"))
    af_p = typed.filter("s_type = 'af' and t_type = 'proj'").select("run_id", F.col("source_id").alias("af"), F.col("target_id").alias("p"))
    p_m = typed.filter("s_type = 'proj' and t_type = 'msr'").select("run_id", F.col("source_id").alias("p"), F.col("target_id").alias("m"))
    through = af_p.join(p_m, ["run_id", "p"]).select("run_id", "af", "m").distinct()
    forward = through.select("run_id", F.col("af").alias("source_id"), F.col("m").alias("target_id"))
    backward = through.select("run_id", F.col("m").alias("source_id"), F.col("af").alias("target_id"))
    return typed.join(forward.union(backward), ["run_id", "source_id", "target_id"], "left_anti").drop("s_type", "t_type")


