"""What a query sends or how often it starts anew, beside what it returns."""

import numpy as np

from strataweave.operators import resolve
from strataweave.plans import quality_queries


def test_blocks_grow_with_the_vectors():
    assert [resolve.cosine_parts(n, 2048) for n in (0, 2000, 3000, 49_152, 49_153, 393_216, 640_000)] == [1, 1, 2, 24, 24, 24, 40]


def test_similar_pairs_equal_all_pairs(spark):
    v = np.random.default_rng(3).normal(size=(1300, 4))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.95), strict=True) if i < j}
    for block in (700, 2048):  # strips of 512 in either
        got = [(r.a, r.b) for r in resolve.cosine_pairs(rows, 0.95, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_top_entities_works_out_nodes_once(spark, monkeypatch):
    written = []
    real = quality_queries.materialize
    monkeypatch.setattr(quality_queries, "materialize", lambda df, name: written.append(name) or real(df, name))
    got = quality_queries.top_entities(spark, "/root/testdata/sf0.001")
    assert written == ["nodes", "edges"] and got.where("rank > 3").count() == 0


def test_leaves_stay_out_of_the_rounds(spark, monkeypatch):
    """A hub of 20 leaves, a chain, a single edge, a ring with a tail, loops, and a node alone; only what is no leaf is contracted."""
    from strataweave.operators import components as rounds
    from strataweave.operators import graph

    pairs = [("h", f"l{i}") for i in range(20)] + [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("p", "q"), ("q", "r"), ("p", "r"), ("r", "s"), ("s", "t"), ("x", "x"), ("o", "o")]
    names = sorted({n for p in pairs for n in p} | {"z"})
    seen = []
    whole = rounds.connected_components
    monkeypatch.setattr(rounds, "connected_components", lambda e, **k: (seen.append(e.count()), whole(e, **k))[1])
    edges = spark.createDataFrame([(run, *sorted(p)) for run in ("1", "2") for p in pairs], "run_id string, u string, v string")
    nodes = spark.createDataFrame([(run, n) for run in ("1", "2") for n in names], "run_id string, node string")
    label = {n: n for n in names}
    for _ in names:
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
    got = {(r.run_id, r.node): r.component for r in graph.components(nodes, edges).collect()}
    assert got == {(run, n): c for run in ("1", "2") for n, c in label.items()}
    assert seen == [2 * (1 + 1 + 3 + 1)]  # b-c, x-y, the ring, r-s


def test_copies_of_texts_fall_away_where_they_are_read(spark):
    """No sort of whole texts before near pairs are looked for; parts are made in more tasks than read them."""
    from strataweave.operators import content
    from strataweave.plans import content_queries

    rows = [("run", f"one two three four five six seven {i % 3}") for i in range(60)] + [("run", ""), ("run", "other words")]
    forms = spark.createDataFrame(rows, "run_id string, norm string")
    found = content.near_pairs(forms, 0.6)
    assert sorted((r.a[-1], r.b[-1], round(r.similarity, 6)) for r in found.collect()) == [(a, b, round(7 / 9, 6)) for a, b in (("0", "1"), ("0", "2"), ("1", "2"))]
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    plan = content_queries._rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(p_partkey" in plan
