"""Shortest paths between all nodes of graphs of any size: distances from many sources at once, and betweenness.

Nodes with the same neighbours are twins: they have the same distances to all others, are 2 apart, and no shortest path between others tells them apart. So both
searches run on one node a class of twins, which stands for all of them, and what a twin owes to its own class is added by formula. Work is in proportion to the
classes and the edges between them; a graph without twins is searched as it is.

`reach` searches breadth-first from 64 * words sources a pass. A node's state is a set of bits, one a source: those that have reached it. A level is one join
with the edges and one bitwise or per node, so a pass costs as many rows as the graph has classes and edges, whatever the number of sources. Graphs are
undirected: what reaches a node from all sources is also what the node reaches, so its sums of distances, its
eccentricity and the number of nodes in reach come from bit counts, and no row for a pair of nodes is ever made. A class of m members has a bit for
each binary digit 1 of m, and a word holds bits of one digit, so a count of bits is a count of members when it is shifted by the digit.

`betweenness` is Brandes' method level by level: path counts forward from a batch of sources, dependencies backward, each level a join with the edges and a sum. The
levels of a batch are written to the shared folder. A batch has as many sources as fit `pairs` rows of state.

Graphs of several runs are searched side by side. Nodes are numbered by hash once, and classes by two hashes of their neighbours. edges: run_id, u, v (one row a pair);
loops and repeated edges change nothing. Nodes without edges reach themselves only and have no betweenness. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.operators.graph import ends
from strataweave.session import materialize

SALTS = 64


def _numbered(edges: DataFrame) -> DataFrame:
    """node, other: both directions of all edges as numbers, each once, without loops."""
    number = lambda c: F.xxhash64("run_id", c).alias(c)
    return materialize(ends(edges).where("node <> other").select(number("node"), number("other")).distinct(), "ends")


def _twins(step: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with the same neighbours as one class c.

    members: k, c. classes: c, k (its least member, which stands for it), m (members), n (neighbours of a member). links: node, other, m, n: the
    edges between nodes that stand for a class, m and n those of `node`.
    """
    mark = lambda seed: F.bit_xor(F.xxhash64("other", F.lit(seed)))
    near = step.groupBy(F.col("node").alias("k")).agg(mark(1).alias("x"), mark(2).alias("y"), F.count(F.lit(1)).alias("n"))
    members = materialize(near.select("k", F.xxhash64("x", "y", "n").alias("c"), "n"), "members")
    classes = materialize(members.groupBy("c").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("m"), F.max("n").alias("n")), "classes")
    heads = classes.select(F.col("k").alias("node"), "m", "n")
    links = step.join(classes.select(F.col("k").alias("other")), "other", "left_semi").join(heads, "node")
    return members.select("k", "c"), classes, materialize(links.select("node", "other", "m", "n"), "links")


def _places(slots: DataFrame) -> DataFrame:
    """slots (run_id, plane, k) with their place in their run and plane, from 0: counts by salt first, so that no task sorts a run."""
    salted = slots.withColumn("salt", F.pmod("k", F.lit(SALTS)))
    count = salted.groupBy("run_id", "plane", "salt").agg(F.count(F.lit(1)).alias("n"))
    first = count.select("run_id", "plane", "salt", (F.sum("n").over(Window.partitionBy("run_id", "plane").orderBy("salt")) - F.col("n")).alias("first"))
    inside = F.row_number().over(Window.partitionBy("run_id", "plane", "salt").orderBy("k")) - 1
    keys = ["run_id", "plane", "salt"]
    return materialize(salted.withColumn("inside", inside).join(F.broadcast(first) if count.count() <= 100_000 else first, keys).select("plane", "k", (F.col("first") + F.col("inside")).alias("place")), "places")


def reach(nodes: DataFrame, edges: DataFrame, words: int = 16) -> DataFrame:
    """run_id, node, reached (nodes in reach, itself included), far (sum of distances), ecc (largest distance) for every node."""
    known = materialize(nodes.select("run_id", "node", F.xxhash64("run_id", "node").alias("k")).distinct(), "known")
    end = lambda c: known.select(F.col("k").alias(c))
    members, classes, links = _twins(materialize(_numbered(edges).join(end("node"), "node", "left_semi").join(end("other"), "other", "left_semi"), "ends"))
    plane = F.explode(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda j: F.getbit("m", j) == 1)).alias("plane")
    slots = _places(classes.join(known, "k").select("run_id", plane, "k"))
    layout: list[int] = []  # the plane of each word
    begin: dict[int, int] = {}
    for row in slots.groupBy("plane").agg(F.max("place").alias("last")).orderBy("plane").collect():
        begin[row["plane"]] = len(layout)
        layout += [row["plane"]] * (row["last"] // 64 + 1)
    word = F.element_at(F.array(*(F.lit(begin.get(j, 0)).cast("long") for j in range(63))), F.col("plane") + 1) + F.floor(F.col("place") / 64)
    slots = slots.select("k", word.alias("word"), F.pmod("place", F.lit(64)).cast("int").alias("at"))
    heads = classes.select("k", "m")
    none = F.lit(0).cast("long")
    parts: list[DataFrame] = []
    for base in range(0, len(layout), words):
        planes = layout[base : base + words]
        bits = [f"b{i}" for i in range(len(planes))]
        either = [F.bit_or(b).alias(b) for b in bits]
        mine = [F.bit_or(F.when(F.col("word") == base + i, F.expr("shiftleft(1L, at)")).otherwise(none)).alias(b) for i, b in enumerate(bits)]
        own = slots.where((F.col("word") >= base) & (F.col("word") < base + len(planes))).groupBy("k").agg(*mine)
        seen = materialize(heads.select("k").join(own, "k", "left").fillna(0), "seen")
        front = seen.where(reduce(lambda x, y: x | y, (F.col(b) != 0 for b in bits)))
        level = 0
        while True:
            level += 1
            got = front.join(links, F.col("k") == F.col("node")).groupBy(F.col("other").alias("g")).agg(*either)
            new = [(F.coalesce(F.col(f"g_{b}"), none).bitwiseAND(F.bitwise_not(b))).alias(f"n_{b}") for b in bits]
            now = materialize(seen.join(got.select("g", *(F.col(b).alias(f"g_{b}") for b in bits)), F.col("k") == F.col("g"), "left").select("k", *bits, *new), "level")
            front = now.where(reduce(lambda x, y: x | y, (F.col(f"n_{b}") != 0 for b in bits))).select("k", *(F.col(f"n_{b}").alias(b) for b in bits))
            if not front.take(1):
                break
            n = reduce(lambda x, y: x + y, (F.shiftleft(F.bit_count(b).cast("long"), p) for b, p in zip(bits, planes, strict=True)))
            parts.append(front.select("k", n.alias("reached"), (n * level).alias("far"), F.lit(level).alias("ecc")))
            seen = now.select("k", *(F.col(b).bitwiseOR(F.col(f"n_{b}")).alias(b) for b in bits))
        if len(parts) > 64:  # keeps the plan small
            parts = [_sums(parts)]
    # A member reaches itself and, in two steps, its twins.
    own = heads.select("k", F.col("m").alias("reached"), (2 * (F.col("m") - 1)).alias("far"), F.when(F.col("m") > 1, 2).otherwise(0).alias("ecc"))
    found = classes.select("c", "k").join(_sums([own, *parts]), "k").drop("k")
    each = known.join(members, "k", "left").join(found, "c", "left")
    return each.select("run_id", "node", F.coalesce("reached", F.lit(1).cast("long")).alias("reached"), F.coalesce("far", none).alias("far"), F.coalesce("ecc", F.lit(0)).alias("ecc"))


def _sums(parts: list[DataFrame]) -> DataFrame:
    whole = reduce(DataFrame.unionByName, parts).groupBy("k").agg(F.sum("reached").alias("reached"), F.sum("far").alias("far"), F.max("ecc").alias("ecc"))
    return materialize(whole, "reach")


def path_lengths(reached: DataFrame) -> DataFrame:
    """Per run over ordered pairs of distinct nodes in reach: mean, diameter, least distance, radius, pairs; runs without pairs have no row."""
    pairs = F.sum(F.col("reached") - 1)
    out = reached.groupBy("run_id").agg(
        F.round(F.sum("far") / F.nullif(pairs, F.lit(0)), 6).alias("mean"), F.max("ecc").alias("diameter"), F.lit(1).alias("min_path"), pairs.alias("pairs"), F.min("ecc").alias("radius")
    )
    return out.where("pairs > 0")


def largest_component(labels: DataFrame) -> DataFrame:
    """run_id, node of each run's largest component, the one with the least label on ties; labels: run_id, node, component."""
    size = labels.groupBy("run_id", "component").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy("run_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "component")).alias("best")).select("run_id", F.col("best.component").alias("component"))
    return labels.join(best, ["run_id", "component"], "left_semi").select("run_id", "node")


def closeness(reached: DataFrame) -> DataFrame:
    """run_id, node, centrality with the correction for parts that are not reached."""
    size = reached.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    more = F.col("reached") - 1
    value = F.when((F.col("far") > 0) & (F.col("n") > 1), more / F.col("far") * more / (F.col("n") - 1)).otherwise(0.0)
    return reached.join(size, "run_id").select("run_id", "node", value.alias("centrality"))


def betweenness(edges: DataFrame, pairs: int = 50_000_000) -> DataFrame:
    """run_id, node, centrality: the share of shortest paths between other nodes that a node is on, scaled by (n - 1)(n - 2)."""
    nodes = materialize(ends(edges).select("run_id", "node").distinct().withColumn("k", F.xxhash64("run_id", "node")), "nodes")
    members, classes, links = _twins(_numbered(edges))
    sizes = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    # A source's state is a row for each class of its run, so a batch's rows are its sources times the classes.
    per = nodes.join(classes.select("k"), "k").groupBy("run_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = per.agg(F.sum(F.col("n") * F.col("n"))).head()[0] or 0
    batches = max(1, -(-int(total) // pairs))
    # From a twin to another, each neighbour is on one of n paths.
    m = F.col("m").cast("double")
    found: list[DataFrame] = [links.groupBy(F.col("other").alias("k")).agg(F.sum(m * (m - 1) / F.col("n")).alias("share"))]
    for batch in range(batches):
        start = classes.where(F.pmod("k", F.lit(batches)) == batch).select(F.col("k").alias("s"), "k", F.col("m").alias("times"), F.lit(1.0).alias("paths"))
        levels = [materialize(start, "level")]
        seen = levels[0].select("s", "k")
        while True:
            # Paths go on from every member of a class, but begin at one.
            paths = F.sum(F.col("paths") * (F.col("m") if len(levels) > 1 else F.lit(1))).alias("paths")
            near = levels[-1].join(links, F.col("k") == F.col("node")).groupBy("s", F.col("other").alias("k")).agg(F.max("times").alias("times"), paths)
            now = materialize(near.join(seen, ["s", "k"], "left_anti"), "level")
            if not now.take(1):
                break
            levels.append(now)
            seen = materialize(seen.unionByName(now.select("s", "k")), "seen")
        given: DataFrame | None = None  # (s, k, part): what the members of a class hand to each of their predecessors' paths
        for level in reversed(levels[1:]):
            share = F.col("paths") * F.coalesce("part", F.lit(0.0))
            own = (level if given is None else level.join(given, ["s", "k"], "left")).select("s", "k", "times", "paths", (F.lit(0.0) if given is None else share).alias("share"))
            own = materialize(own, "share")
            found.append(own.groupBy("k").agg(F.sum(F.col("share") * F.col("times")).alias("share")))
            handed = own.select("s", "k", ((1 + F.col("share")) / F.col("paths")).alias("part"))
            given = handed.join(links, F.col("k") == F.col("node")).groupBy("s", F.col("other").alias("k")).agg(F.sum(F.col("part") * F.col("m")).alias("part"))
        if len(found) > 32:
            found = [materialize(_added(found), "between")]
    value = members.join(classes.join(_added(found), "k").select("c", "share"), "c")
    scale = F.when(F.col("n") > 2, 1 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(1.0)
    share = F.coalesce("share", F.lit(0.0))
    return nodes.join(value, "k", "left").join(sizes, "run_id").select("run_id", "node", (share * scale).alias("centrality"))


def _added(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("k").agg(F.sum("share").alias("share"))
