"""Queries of the graph family, over the tables seen as a document graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.operators import graph, paths
from strataweave.plans import adapters
from strataweave.plans.adapters import GRAPH
from strataweave.plans.registry import query
from strataweave.session import materialize

RECURSIVE = f"""
WITH RECURSIVE {GRAPH},
"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, written once: most queries read them several times."""
    nodes = materialize(graph.build_nodes(adapters.entities(spark, sf_dir)), "nodes")
    return nodes, materialize(graph.build_edges(nodes, adapters.connections(spark, sf_dir)), "edges")


def _degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*_graph(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def nodes_by_type(spark, sf_dir):
    return graph.nodes_by_type(_graph(spark, sf_dir)[0]).drop("run_id")


@query(f"""WITH {GRAPH}, typed AS (SELECT a.type AS a, b.type AS b FROM pairs JOIN nodes a ON u = a.node JOIN nodes b ON v = b.node)
SELECT relation, count(*) AS n FROM (SELECT concat(a, '_to_', b) AS relation FROM typed UNION ALL SELECT concat(b, '_to_', a) FROM typed WHERE a <> b) GROUP BY relation""")
def edges_by_relation(spark, sf_dir):
    return graph.edges_by_relation(*_graph(spark, sf_dir)).drop("run_id")


@query(f"""WITH {GRAPH} SELECT type, count(*) AS n, round(avg(degree), 6) AS mean, round(CAST(median(degree) AS DOUBLE), 6) AS median,
min(degree) AS least, max(degree) AS most, round(stddev_pop(degree), 6) AS std FROM degrees GROUP BY type""")
def degree_by_type(spark, sf_dir):
    return graph.degree_by_type(_degree(spark, sf_dir)).drop("run_id")


# The graph is a forest of regions with shortcuts, so a component is found from its region.
LABELS = """reach AS (
  SELECT node, node AS component FROM nodes WHERE type = 'action_field'
  UNION SELECT other, component FROM reach JOIN ends USING (node)),
labels AS (SELECT node, coalesce(min(component), node) AS component FROM nodes LEFT JOIN reach USING (node) GROUP BY node)"""


@query(f"""{RECURSIVE} {LABELS}, sizes AS (SELECT component, count(*) AS size FROM labels GROUP BY component)
SELECT count(*) AS nodes, count(*) FILTER (degree = 0) AS isolated, round(avg(degree), 6) AS mean_degree,
  round(CAST(median(degree) AS DOUBLE), 6) AS median_degree, max(degree) AS max_degree, (SELECT count(*) FROM pairs) AS edges,
  (SELECT count(*) FROM sizes) AS components, (SELECT max(size) FROM sizes) AS largest FROM degrees""")
def graph_summary(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.summary(graph.degrees(nodes, edges), edges, graph.components(nodes, edges)).drop("run_id")


@query(f"""{RECURSIVE} {LABELS} SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM labels GROUP BY component) GROUP BY size""")
def components_summary(spark, sf_dir):
    labels = graph.components(*_graph(spark, sf_dir))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{RECURSIVE} {LABELS}, big AS (SELECT component FROM labels GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
SELECT type, count(*) AS n FROM labels JOIN nodes USING (node) WHERE component = (SELECT component FROM big) GROUP BY type""")
def largest_component(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    labels = graph.components(nodes, edges)
    big = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component").limit(1)
    kept = labels.join(F.broadcast(big), "component", "left_semi")
    return kept.join(nodes, ["run_id", "node"]).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


BFS = """walk AS (
  SELECT node AS start, node, 0 AS distance FROM nodes WHERE type = 'action_field'
  UNION SELECT start, other, distance + 1 FROM walk JOIN ends USING (node) WHERE distance < 8),
dist AS (SELECT start, node, min(distance) AS distance FROM walk GROUP BY start, node)"""


def _distances(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    starts = nodes.filter("type = 'action_field'").select("run_id", F.col("node").alias("start"))
    return nodes, graph.distances(edges, starts)


@query(f"{RECURSIVE} {BFS} SELECT start, CAST(distance AS INT) AS distance, count(*) AS n FROM dist GROUP BY start, distance")
def bfs_path_lengths(spark, sf_dir):
    return _distances(spark, sf_dir)[1].groupBy("start", "distance").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{RECURSIVE} {BFS} SELECT round(avg(distance), 6) AS mean, CAST(max(distance) AS INT) AS diameter, CAST(min(distance) AS INT) AS min_path,
count(*) AS pairs, (SELECT CAST(min(e) AS INT) FROM (SELECT max(distance) AS e FROM dist GROUP BY start)) AS radius FROM dist WHERE distance > 0""")
def path_summary(spark, sf_dir):
    return graph.path_lengths(_distances(spark, sf_dir)[1]).drop("run_id")


@query(f"""{RECURSIVE} {BFS} SELECT start AS node, round(CASE WHEN sum(distance) > 0 THEN (count(*) - 1) / sum(distance) * (count(*) - 1) / ((SELECT count(*) FROM nodes) - 1) ELSE 0 END, 6) AS centrality
FROM dist GROUP BY start""")
def closeness_action_fields(spark, sf_dir):
    nodes, distance = _distances(spark, sf_dir)
    return graph.closeness(distance, nodes).select("node", F.round("centrality", 6).alias("centrality"))


@query(f"""WITH {GRAPH} SELECT round(avg(c), 6) AS mean, round(max(c), 6) AS most, round(min(c), 6) AS least, round(stddev_pop(c), 6) AS std
FROM (SELECT degree / ((SELECT count(*) FROM nodes) - 1) AS c FROM degrees)""")
def degree_centrality(spark, sf_dir):
    return graph.centrality_summary(graph.degree_centrality(_degree(spark, sf_dir))).drop("run_id")


def _rank_sql(rounds: int = 5) -> str:
    steps = [f"WITH {GRAPH}, total AS (SELECT count(*) AS n FROM nodes), base AS (SELECT node, nullif(degree, 0) AS outs FROM degrees), r0 AS (SELECT node, outs, 1.0::DOUBLE / n AS rank FROM base, total)"]
    for i in range(rounds):
        steps.append(
            f"g{i} AS (SELECT e.other AS node, sum(rank / outs) AS got FROM r{i} JOIN ends e USING (node) GROUP BY e.other), "
            f"l{i} AS (SELECT coalesce(sum(rank) FILTER (outs IS NULL), 0) AS loose FROM r{i}), "
            f"r{i + 1} AS (SELECT node, outs, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + loose / n) AS rank FROM base LEFT JOIN g{i} USING (node), l{i}, total)"
        )
    return ", ".join(steps) + f" SELECT type, round(sum(rank), 6) AS rank, round(max(rank), 6) AS most FROM r{rounds} JOIN nodes USING (node) GROUP BY type"


@query(_rank_sql())
def pagerank_by_type(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    rank = graph.pagerank(nodes, edges, rounds=5).join(nodes, ["run_id", "node"])
    return rank.groupBy("type").agg(F.round(F.sum("rank"), 6).alias("rank"), F.round(F.max("rank"), 6).alias("most"))


@query("""WITH n AS (SELECT n_regionkey AS r, concat('proj_', n_nationkey) AS p, count(*) OVER (PARTITION BY n_regionkey) AS k FROM nation)
SELECT concat('r', r) AS run_id, concat('af_', r) AS node, CASE WHEN max(k) > 1 THEN 1.0 ELSE 0.0 END AS centrality FROM n GROUP BY r UNION ALL SELECT concat('r', r), p, 0.0 FROM n""")
def betweenness_small(spark, sf_dir):
    """Regions and nations form small graphs of their own: one run per region. All paths between nations lead over the region."""
    edges = adapters.sql(spark, sf_dir, """SELECT concat('r', n_regionkey) AS run_id, concat('af_', n_regionkey) AS u, concat('proj_', n_nationkey) AS v,
        CAST(0.9 AS DOUBLE) AS confidence FROM nation""")
    return paths.betweenness(edges).select("run_id", "node", F.round("centrality", 6).alias("centrality"))


#: Suppliers between two nations each, and nations in their regions: a graph with cycles in which all pairs of nodes are counted.
SUPPLY = """SELECT concat('af_', CAST(n_regionkey AS STRING)) AS u, concat('proj_', CAST(n_nationkey AS STRING)) AS v FROM nation
UNION SELECT concat('proj_', CAST(s_nationkey AS STRING)), concat('sup_', CAST(s_suppkey AS STRING)) FROM supplier
UNION SELECT concat('proj_', CAST(s_suppkey % 25 AS STRING)), concat('sup_', CAST(s_suppkey AS STRING)) FROM supplier"""
ALL_PAIRS = f"""WITH RECURSIVE e AS ({SUPPLY}), ends AS (SELECT u AS node, v AS other FROM e UNION SELECT v, u FROM e), nodes AS (SELECT DISTINCT node FROM ends),
walk AS (SELECT node AS start, node, 0 AS distance FROM nodes UNION SELECT start, other, distance + 1 FROM walk JOIN ends USING (node) WHERE distance < 12),
dist AS (SELECT start, node, min(distance) AS distance FROM walk GROUP BY start, node),
big AS (SELECT start AS node, min(node) AS component FROM dist GROUP BY start),
largest AS (SELECT node FROM big WHERE component = (SELECT component FROM big GROUP BY component ORDER BY count(*) DESC, component LIMIT 1))"""


def _supply(spark, sf_dir):
    edges = materialize(adapters.sql(spark, sf_dir, f"SELECT 'run' AS run_id, * FROM ({SUPPLY})"), "edges")
    return graph.ends(edges).select("run_id", "node").distinct(), edges


@query(f"""{ALL_PAIRS}, d AS (SELECT d.* FROM dist d JOIN largest l ON l.node = d.start) SELECT round(avg(distance), 6) AS mean, CAST(max(distance) AS INT) AS diameter, CAST(min(distance) AS INT) AS min_path,
count(*) AS pairs, (SELECT CAST(min(e) AS INT) FROM (SELECT max(distance) AS e FROM d GROUP BY start)) AS radius FROM d WHERE distance > 0""")
def path_summary_all(spark, sf_dir):
    """Distances between all nodes of the largest component."""
    nodes, edges = _supply(spark, sf_dir)
    kept = materialize(paths.largest_component(graph.components(nodes, edges)), "largest")
    near = edges.join(kept.withColumnRenamed("node", "u"), ["run_id", "u"], "left_semi")
    return paths.path_lengths(paths.reach(kept, near)).drop("run_id")


@query(f"""{ALL_PAIRS} SELECT start AS node, round(CASE WHEN sum(distance) > 0 THEN (count(*) - 1) / sum(distance) * (count(*) - 1) / ((SELECT count(*) FROM nodes) - 1) ELSE 0 END, 6) AS centrality FROM dist GROUP BY start""")
def closeness_all(spark, sf_dir):
    return paths.closeness(paths.reach(*_supply(spark, sf_dir))).select("node", F.round("centrality", 6).alias("centrality"))


@query(f"""{ALL_PAIRS}, trail AS (SELECT node AS start, node, 0 AS d, CAST([] AS VARCHAR[]) AS mids FROM nodes
  UNION ALL SELECT t.start, e.other, t.d + 1, CASE WHEN t.d = 0 THEN t.mids ELSE list_append(t.mids, t.node) END FROM trail t JOIN ends e ON e.node = t.node JOIN dist x ON x.start = t.start AND x.node = e.other AND x.distance = t.d + 1),
many AS (SELECT start, node, count(*) AS n FROM trail WHERE d > 0 GROUP BY start, node),
part AS (SELECT mid, sum(1.0::DOUBLE / n) AS share FROM (SELECT start, node, unnest(mids) AS mid FROM trail WHERE d > 1) JOIN many USING (start, node) GROUP BY mid)
SELECT node, round(coalesce(share, 0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2), 6) AS centrality FROM nodes LEFT JOIN part ON mid = node""")
def betweenness_all(spark, sf_dir):
    return paths.betweenness(_supply(spark, sf_dir)[1]).select("node", F.round("centrality", 6).alias("centrality"))


@query(f"WITH {GRAPH} SELECT round(avg(CASE WHEN degree > 0 THEN 1 ELSE 0 END), 6) AS coverage FROM degrees WHERE type = 'action_field'")
def af_coverage(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.action_field_coverage(nodes, edges, graph.degrees(nodes, edges)).drop("run_id")


@query(f"""WITH {GRAPH} SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM ends e JOIN nodes o ON o.node = e.other WHERE e.node = d.node
  AND (o.bucket_ord, o.ord) <= (d.bucket_ord, d.ord)) THEN 1 ELSE 0 END), 6) AS coverage FROM degrees d WHERE type = 'action_field'""")
def af_coverage_ordered(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.action_field_coverage(nodes, edges, graph.degrees(nodes, edges), ordered_edge=True).drop("run_id")


@query(f"""WITH {GRAPH}, near AS (SELECT e.node, bool_or(o.type = 'action_field') AS a, bool_or(o.type = 'measure') AS m FROM ends e JOIN nodes o ON o.node = e.other GROUP BY e.node)
SELECT round(avg(CASE WHEN a AND m THEN 1 ELSE 0 END), 6) AS coverage FROM nodes LEFT JOIN near USING (node) WHERE type = 'project'""")
def project_coverage(spark, sf_dir):
    return graph.project_coverage(*_graph(spark, sf_dir)).drop("run_id")


PER_PROJECT = "per AS (SELECT n.node, count(o.node) AS measures FROM nodes n LEFT JOIN ends e ON e.node = n.node LEFT JOIN nodes o ON o.node = e.other AND o.type = 'measure' WHERE n.type = 'project' GROUP BY n.node)"


@query(f"""WITH {GRAPH}, {PER_PROJECT} SELECT round(avg(measures), 6) AS mean, round(CAST(median(measures) AS DOUBLE), 6) AS median,
min(measures) AS least, max(measures) AS most, round(stddev_pop(measures), 6) AS std FROM per""")
def measures_per_project(spark, sf_dir):
    per = graph.measures_per_project(*_graph(spark, sf_dir))
    r = lambda c: F.round(c, 6)
    return per.agg(r(F.avg("measures")).alias("mean"), r(F.median("measures")).alias("median"), F.min("measures").alias("least"), F.max("measures").alias("most"), r(F.stddev_pop("measures")).alias("std"))


@query(f"WITH {GRAPH}, {PER_PROJECT} SELECT measures, count(*) AS projects FROM per GROUP BY measures")
def measures_distribution(spark, sf_dir):
    return graph.measures_per_project(*_graph(spark, sf_dir)).groupBy("measures").agg(F.count(F.lit(1)).alias("projects"))


@query(f"""WITH {GRAPH} SELECT type, count(*) AS total, count(*) FILTER (degree > 0) AS connected, count(*) FILTER (degree = 0) AS isolated,
round(count(*) FILTER (degree > 0) / count(*), 6) AS rate, round(avg(degree), 6) AS mean_degree FROM degrees GROUP BY type""")
def detailed_coverage(spark, sf_dir):
    return graph.detailed_coverage(_degree(spark, sf_dir)).drop("run_id")


@query(f"WITH {GRAPH} SELECT CAST(row_number() OVER (ORDER BY u, v) AS INT) AS rank, u, v FROM pairs QUALIFY rank <= 20")
def cycles_two(spark, sf_dir):
    return graph.two_cycles(_graph(spark, sf_dir)[1]).drop("run_id")


@query(f"{RECURSIVE} {LABELS} SELECT (SELECT count(*) FROM pairs) - (SELECT count(*) FROM nodes) + (SELECT count(DISTINCT component) FROM labels) AS cycles")
def cyclomatic(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.cyclomatic(graph.degrees(nodes, edges), edges, graph.components(nodes, edges)).drop("run_id")


@query(f"""WITH {GRAPH}, c AS (SELECT source_id, target_id, confidence FROM connections UNION ALL SELECT target_id, source_id, confidence FROM connections WHERE bucket = 'action_fields' AND target_id LIKE 'msr%'),
through AS (SELECT DISTINCT a.source_id AS af, b.target_id AS m FROM c a JOIN c b ON b.source_id = a.target_id
  WHERE a.source_id LIKE 'af\\_%' ESCAPE '\\' AND a.target_id LIKE 'proj\\_%' ESCAPE '\\' AND b.target_id LIKE 'msr\\_%' ESCAPE '\\')
SELECT source_id, target_id, confidence FROM c WHERE NOT EXISTS (SELECT 1 FROM through WHERE (af = source_id AND m = target_id) OR (m = source_id AND af = target_id))""")
def prune_shortcuts(spark, sf_dir):
    c = adapters.connections(spark, sf_dir)
    back = c.filter("bucket = 'action_fields' and target_id like 'msr%'").withColumns({"source_id": F.col("target_id"), "target_id": F.col("source_id")})
    return graph.redundant_shortcuts(c.unionByName(back)).select("source_id", "target_id", "confidence")


@query("""WITH af AS (SELECT r_regionkey, concat('af:', r_name) AS af FROM region), p AS (SELECT n_regionkey, concat('proj:', n_name) AS p, n_nationkey FROM nation),
m AS (SELECT DISTINCT c_nationkey, concat('msr:', c_mktsegment) AS m FROM customer),
e AS (SELECT af AS a, p AS b FROM af JOIN p ON n_regionkey = r_regionkey UNION SELECT p, m FROM p JOIN m ON c_nationkey = n_nationkey)
SELECT split_part(a, ':', 1) AS a_type, split_part(b, ':', 1) AS b_type, count(*) AS n FROM (SELECT least(a, b) AS a, greatest(a, b) AS b FROM e) GROUP BY 1, 2""")
def hierarchical_graph(spark, sf_dir):
    """The nested layout: regions with their nations as projects and market segments as measures."""
    tree = adapters.sql(spark, sf_dir, """
      WITH m AS (SELECT c_nationkey, collect_list(c_mktsegment) AS measures FROM customer GROUP BY c_nationkey),
      p AS (SELECT n_regionkey, collect_list(named_struct('title', n_name, 'measures', coalesce(measures, array()), 'indicators', CAST(array() AS ARRAY<STRING>))) AS projects
            FROM nation LEFT JOIN m ON c_nationkey = n_nationkey GROUP BY n_regionkey)
      SELECT 'run' AS run_id, collect_list(named_struct('action_field', r_name, 'projects', projects)) AS action_fields FROM region LEFT JOIN p ON n_regionkey = r_regionkey""")
    _, edges = graph.hierarchical_nodes_edges(tree)
    kind = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(1))
    return edges.groupBy(kind("u").alias("a_type"), kind("v").alias("b_type")).agg(F.count(F.lit(1)).alias("n"))
