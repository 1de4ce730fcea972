"""What follows extraction: parents, shortcuts, names, nested projects; and the report of connectivity."""

import json

import pytest

from strataweave.operators import finish, state
from strataweave.plans import analyze
from tests.test_state import OPS, content, op, run


def links(df):
    return [(r.from_id, r.to_id, r.confidence) for r in state.connections(df).orderBy("from_id", "ord").collect()]


@pytest.fixture
def made(spark):
    return run(spark, [
        op(0, "CREATE", "action_field", {"title": "Mobilität"}), op(1, "CREATE", "action_field", {"title": "Mobilitaet"}), op(2, "CREATE", "project", {"title": "Radweg", "parent_action_field_id": "af_1"}),
        op(3, "CREATE", "project", {"title": "Ring", "parent_action_field_id": "af_1"}), op(4, "CREATE", "measure", {"title": "M", "parent_project_id": "proj_1", "parent_action_field_id": "proj_1"}), op(5, "CREATE", "measure", {"title": "N", "parent_action_field_id": "af_9"}),
        op(6, "CREATE", "indicator", {"title": "I", "parent_project_id": "proj_1"}), op(8, "CREATE", "measure", {"title": "L", "parent_action_field_id": "af_1", "parent_project_id": "proj_2"}), op(7, "CONNECT", "action_field", links=[("af_1", "msr_1", 0.9), ("af_1", "proj_2", 0.7), ("proj_1", "ind_1", 0.6)]),
    ])


def test_parents_and_shortcuts(spark, made):
    full = finish.with_parents(made)
    assert links(full) == [("af_1", "msr_1", 0.9), ("af_1", "proj_2", 0.7), ("af_1", "msr_3", 0.8), ("af_1", "proj_1", 0.8), ("proj_1", "ind_1", 0.6), ("proj_1", "msr_1", 0.8), ("proj_2", "msr_3", 0.8)]
    assert links(finish.without_shortcuts(full)) == [x for x in links(full) if x[:2] not in (("af_1", "msr_1"), ("af_1", "msr_3"))]
    assert finish.without_shortcuts(full).filter("kind <> 'connection'").count() == made.filter("kind <> 'connection'").count()
    assert links(finish.with_parents(full)) == links(full)


def test_registered_names(spark, made):
    named = content(finish.with_registered_names(made))
    assert named["af_1"] == named["af_2"] == {"title": "Mobilität", "name": "Mobilität"} and named["proj_1"] == content(made)["proj_1"]


def test_finished(spark, made):
    tree = finish.nested(finish.with_parents(made)).orderBy("ord").collect()
    assert [(t.action_field, [(p.title, p.measures, p.indicators) for p in t.projects]) for t in tree] == [("Mobilität", [("Ring", ["L"], []), ("Radweg", ["M"], ["I"])]), ("Mobilitaet", [])]
    projects, report = finish.finished(finish.with_parents(made))
    got = {r.title: r for r in projects.collect()}
    assert got["Radweg"].measures == ["M"] and not got["Radweg"].recovered_indicators and got["Ring"].measures == ["L"] and got["Ring"].recovered_indicators > 0
    r = report.first()
    assert (r.no_indicators_before, r.no_indicators, r.projects) == (1, 0, 2)


def test_nothing(spark):
    none = state.apply_log(spark.createDataFrame([], OPS))
    for step in (finish.with_parents, finish.without_shortcuts, finish.with_registered_names, finish.nested):
        assert step(none).count() == 0


def test_extraction_resolves_parents(spark):
    def client():
        ops = [{"operation": "CREATE", "entity_type": "action_field", "content": {"title": "A"}}, {"operation": "CREATE", "entity_type": "project", "content": {"title": "P", "parent_action_field_id": "af_1"}}]
        return lambda prompt: json.dumps({"operations": ops if "nodes" in prompt else [], "continue": False})

    pages = spark.createDataFrame([("s", 1, "Ein Text.")], "source_id string, page_number int, text string")
    assert links(state.extract_pages(pages, client)) == [("af_1", "proj_1", 0.8)]
    assert links(state.extract_pages(pages, client, parents=False)) == []


def test_connectivity(spark):
    nodes = spark.createDataFrame([("r", n, "project") for n in "abcd"] + [("q", "x", "project")], "run_id string, node string, type string")
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c")], "run_id string, u string, v string")
    got = {r.run_id: r for r in analyze.connectivity(nodes, edges).collect()}
    r, q = got["r"], got["q"]
    assert (r.components, r.largest, r.mean, r.diameter, r.radius, r.min_path) == (2, 3, round(4 / 3, 6), 2, 1, 1)
    assert (q.components, q.largest, q.diameter, q.betweenness_most, q.closeness_most) == (1, 1, None, 0, 0)
    assert r.degree_most == round(2 / 3, 6) and r.betweenness_least == 0 and r.betweenness_most == pytest.approx(1, abs=1e-6)
    assert r.pagerank_mean == 0.25 and r.closeness_most == round(2 / 2 * 2 / 3, 6) and r.closeness_least == 0
