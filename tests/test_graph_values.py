"""Graph measures held against values worked out by hand, and small helpers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataweave.functions import text as T
from strataweave.operators import content, graph, oplog, paths, quality
from strataweave.session import scratch_root
from strataweave.sources import pages, sinks


@pytest.fixture(scope="module")
def star(spark):
    """A project with an action field, a measure and an indicator."""
    nodes = spark.createDataFrame([("r", n, t, n) for n, t in (("af_1", "action_field"), ("proj_1", "project"), ("msr_1", "measure"), ("ind_1", "indicator"))], "run_id string, node string, type string, name string")
    edges = spark.createDataFrame([("r", "af_1", "proj_1", 0.9), ("r", "msr_1", "proj_1", 0.8), ("r", "ind_1", "proj_1", 0.7)], "run_id string, u string, v string, confidence double")
    return nodes, edges


def test_paths_and_centralities(spark, star):
    nodes, edges = star
    distance = graph.distances(edges, nodes.select("run_id", F.col("node").alias("start")))
    p = graph.path_lengths(distance).first()
    assert (p["mean"], p.diameter, p.min_path, p.pairs, p.radius) == (1.5, 2, 1, 12, 1)
    near = {r.node: round(r.centrality, 6) for r in graph.closeness(distance, nodes).collect()}
    assert near == {"proj_1": 1.0, "af_1": 0.6, "msr_1": 0.6, "ind_1": 0.6}
    d = graph.centrality_summary(graph.degree_centrality(graph.degrees(nodes, edges))).first()
    assert (d["mean"], d.most, d.least, d.std) == (0.5, 1.0, 0.333333, 0.288675)
    between = {r.node: r.centrality for r in paths.betweenness(edges).collect()}
    assert between == {"proj_1": 1.0, "af_1": 0.0, "msr_1": 0.0, "ind_1": 0.0}
    rank = {r.node: round(r["rank"], 4) for r in graph.pagerank(nodes, edges).collect()}
    assert rank == {"proj_1": 0.4797, "af_1": 0.1734, "msr_1": 0.1734, "ind_1": 0.1734}
    assert {r.relation: r.n for r in graph.edges_by_relation(nodes, edges).collect()}["action_field_to_project"] == 1


def test_betweenness_of_a_path(spark):
    edges = spark.createDataFrame([("r", a, b) for a, b in ("ab", "bc", "cd", "de")], "run_id string, u string, v string")
    got = {r.node: round(r.centrality, 6) for r in paths.betweenness(edges).collect()}
    assert got == {"a": 0.0, "b": 0.5, "c": 0.666667, "d": 0.5, "e": 0.0}


def test_paths_that_do_not_end_are_an_error(spark):
    edges = spark.createDataFrame([("r", f"n{i}", f"n{i + 1}") for i in range(6)], "run_id string, u string, v string")
    starts = spark.createDataFrame([("r", "n0")], "run_id string, start string")
    assert graph.distances(edges, starts).agg(F.max("distance")).first()[0] == 6
    with pytest.raises(RuntimeError):
        graph.distances(edges, starts, most=3)


def test_near_pairs_equal_all_pairs(spark):
    words = "rad bahn bus weg netz plan ziel haus stadt land".split()
    texts = sorted({" ".join(words[(i * k) % 10] for k in range(1, 2 + i % 9)) for i in range(60)})
    got = {(r.a, r.b): round(r.similarity, 6) for r in content.near_pairs(spark.createDataFrame([("r", t) for t in texts], "run_id string, norm string"), 0.6).collect()}
    want = {}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            x, y = set(a.split()), set(b.split())
            if len(x & y) / len(x | y) > 0.6:
                want[a, b] = round(len(x & y) / len(x | y), 6)
    assert got == want and want


def test_headers_and_footers_on_few_lines(spark):
    rows = [("s", i, text) for i, text in enumerate(["Stadt Muster Bericht 1\nx", "Stadt Muster Bericht 2\ny\nz\nw\nFusszeile der Seite", "Stadt Muster Bericht 3", ""])]
    found = content.headers_footers(spark.createDataFrame(rows, "source_id string, page_number int, text string"), floor=2).collect()
    # A page of one line has it as header and as footer.
    assert {(r.place, r.pattern, r.n) for r in found} == {("header", "Stadt Muster Bericht", 3), ("footer", "Stadt Muster Bericht", 2)}


def test_small_helpers(spark, tmp_path):
    one = spark.range(1)
    assert one.select(oplog.merge_other(F.lit("ab"), F.lit("abc")), oplog.merge_other(F.lit("ab"), F.lit("cd"))).first()[:] == ("abc", "ab")
    assert one.select(T.lines(F.lit("a\n\nb\n"))).first()[0] == ["a", "", "b"]
    stats = pages.page_stats(spark.createDataFrame([("s", 1, "x" * 7), ("s", 2, "x" * 14)], "source_id string, page_number int, text string")).first()
    assert (stats.pages, stats.least, stats.most, stats["mean"]) == (2, 2, 4, 3.0)
    for n in range(2):
        sinks.append_events(spark.createDataFrame([(n,)], "n int"), str(tmp_path / "log"))
    lines = [json.loads(x) for f in (tmp_path / "log").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["n"] for x in lines) == [0, 1] and all(x["at"].endswith("Z") for x in lines)
    sinks.write_json(spark.createDataFrame([(1,)], "n int"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().n == 1


def test_documents_by_a_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|" + b"long " * 20)
    got = pages.parse_documents(spark, str(tmp_path), lambda raw: list(enumerate(raw.decode().split("|"), 1)), recogniser=lambda raw, n: f"seen {n}")
    assert sorted((r.source_id, r.page_number, r.text[:6]) for r in got.collect()) == [("a", 1, "seen 1"), ("a", 2, "long l")]


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://x:1", "applicationId": "app"})

    with pytest.raises(RuntimeError):
        scratch_root(Cluster)
    assert spark.sparkContext.applicationId in scratch_root(spark)


def plain_paths(edges):
    """Distances from every node, and Brandes' betweenness, of one graph."""
    near = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    value, far = dict.fromkeys(near, 0.0), {}
    for start in near:
        count, level, order = {start: 1}, {start: 0}, [start]
        for x in order:
            for y in near[x]:
                if y not in level:
                    level[y], count[y] = level[x] + 1, 0
                    order.append(y)
                if level[y] == level[x] + 1:
                    count[y] += count[x]
        far[start] = len(level), sum(level.values()), max(level.values())
        share = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in near[y]:
                if level[x] == level[y] - 1:
                    share[x] += count[x] / count[y] * (1 + share[y])
            if y != start:
                value[y] += share[y]
    n = len(near)
    return far, {k: x / ((n - 1) * (n - 2) if n > 2 else 1) for k, x in value.items()}


@pytest.mark.parametrize(("seed", "words", "pairs"), [(1, 1, 900), (2, 2, 10**7)])
def test_paths_of_random_graphs(spark, seed, words, pairs):
    rng = random.Random(seed)
    graphs = {"r": [tuple(rng.sample([f"n{i}" for i in range(40)], 2)) for _ in range(70)] + [("n1", "n1"), ("x", "y")], "s": [(f"p{i}", f"p{i + 1}") for i in range(4)]}
    rows = [(run, *sorted(e)) for run, edges in graphs.items() for e in edges]
    edges = spark.createDataFrame(sorted(set(rows)), "run_id string, u string, v string")
    nodes = graph.ends(edges).select("run_id", "node").unionByName(spark.createDataFrame([("s", "alone")], "run_id string, node string")).distinct()
    reached = {(r.run_id, r.node): (r.reached, r.far, r.ecc) for r in paths.reach(nodes, edges, words=words).collect()}
    between = {(r.run_id, r.node): r.centrality for r in paths.betweenness(edges.where("u <> v"), pairs=pairs).collect()}
    assert reached.pop(("s", "alone")) == (1, 0, 0)
    for run, own in graphs.items():
        far, value = plain_paths(own)
        assert {k: v for (r, k), v in reached.items() if r == run} == far
        mine = {k: v for (r, k), v in between.items() if r == run}
        assert mine.keys() == value.keys() and all(abs(mine[k] - value[k]) < 1e-9 for k in value)


def test_twins_are_searched_once(spark, monkeypatch):
    """Leaves of the same hubs are one class: rounds do not grow with them, and results are those of a plain search."""
    rows = sorted({("r", min(h, x), max(h, x)) for i in range(400) for h in (f"h{i % 5}", f"h{i * 3 % 7}") for x in (f"x{i}",)} | {("r", "h0", "top"), ("r", "h6", "top"), ("s", "a", "b")})
    edges = spark.createDataFrame(rows, "run_id string, u string, v string")
    nodes = graph.ends(edges).select("run_id", "node").distinct()
    written = []
    real = paths.materialize
    monkeypatch.setattr(paths, "materialize", lambda df, name: written.append(name) or real(df, name))
    reached = {(r.run_id, r.node): (r.reached, r.far, r.ecc) for r in paths.reach(nodes, edges, words=1).collect()}
    between = {(r.run_id, r.node): r.centrality for r in paths.betweenness(edges, pairs=5000).collect()}
    assert len(written) < 70
    for run in "rs":
        far, value = plain_paths([(u, v) for r, u, v in rows if r == run])
        assert {k: v for (r, k), v in reached.items() if r == run} == far
        assert all(abs(between[run, k] - value[k]) < 1e-9 for k in value)


def test_a_spread_of_just_the_limit_is_none(spark):
    """Nine confidences whose deviation is exactly 0.2, in many orders: whatever order they are added in, none is spread."""
    values = [0.79, 0.40, 0.90, 0.91, 0.93, 0.42, 0.71, 0.62, 0.68]
    whole = [round(100 * v) for v in values]
    assert 9 * sum(v * v for v in whole) - sum(whole) ** 2 == 20 * 20 * 9 * 8
    rng = random.Random(1)
    rows = [(f"r{i}", "msr_1", f"ind_{j}", v) for i in range(50) for j, v in enumerate(rng.sample(values, 9))]
    c = spark.createDataFrame(rows, "run_id string, source_id string, target_id string, confidence double")
    assert {r.reasons for r in quality.ambiguous(c).collect()} <= {"low"}


def test_paths_of_nothing(spark):
    edges = spark.createDataFrame([], "run_id string, u string, v string")
    nodes = spark.createDataFrame([], "run_id string, node string")
    assert paths.reach(nodes, edges).collect() == [] and paths.betweenness(edges).collect() == []
    assert paths.path_lengths(paths.reach(nodes, edges)).collect() == []
