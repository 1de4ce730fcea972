"""The carried state: fixtures with known outcomes, and the fold against the set-based operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataweave.operators import oplog, state

OPS = (
    "source_id string, chunk_index int, seq int, operation string, entity_type string, entity_id string, content string, "
    "connections array<struct<from_id string, to_id string, confidence double>>, confidence double, source_pages array<int>, source_quote string"
)


def op(n, kind, entity_type=None, content=None, entity_id=None, links=None, chunk=0, source="s", confidence=0.8, pages=None, quote=None):
    links = None if links is None else [(a, b, c) for a, b, c in links]
    return (source, chunk, n, kind, entity_type, entity_id, None if content is None else json.dumps(content), links, confidence, pages, quote)


def run(spark, ops, before=None, **settings):
    return state.apply_log(spark.createDataFrame(ops, OPS), before, **settings)


def content(df):
    return {r.id: r.content for r in state.entities(df).collect()}


def test_ids_go_on_over_chunks_and_logs(spark):
    one = [op(0, "CREATE", "action_field", {"title": "Mobilität"}), op(1, "CREATE", "project", {"title": "Stadtbahn"})]
    two = [op(0, "CREATE", "action_field", {"title": "Energie"}, chunk=1), op(1, "CREATE", "project", {"title": "Solarpark"}, chunk=1)]
    assert set(content(run(spark, one + two))) == {"af_1", "af_2", "proj_1", "proj_2"}
    later = run(spark, two, run(spark, one))
    assert content(later) == content(run(spark, one + two))


def test_operations_are_reordered_in_a_batch(spark):
    ops = [
        op(0, "CONNECT", "action_field", links=[("af_1", "proj_1", 0.9)]), op(1, "UPDATE", "action_field", {"description": "x"}, "af_1"), op(2, "CREATE", "action_field", {"title": "A"}),
        op(3, "CREATE", "project", {"title": "P"}), op(4, "CONNECT", "project", links=[("proj_1", "ind_1", None)]), op(5, "CREATE", "indicator", {"title": "I"}),
    ]
    got = run(spark, ops, validated=False)
    assert content(got)["af_1"] == {"title": "A", "description": "x"}
    assert {(r.from_id, r.to_id, r.confidence) for r in state.connections(got).collect()} == {("af_1", "proj_1", 0.9), ("proj_1", "ind_1", 0.8)}
    assert state.results(got).filter("success").count() == 6 and state.count_connections(got).first().connections == 2
    s = state.log_summary(got).first()
    assert (s.batches, s.operations, s.successful, s.failed, s.success_rate, s.entities_created) == (1, 6, 6, 0, 1.0, 3)


def test_sources_are_kept_once(spark):
    first = run(spark, [op(0, "CREATE", "measure", {"title": "M"}, pages=[5], quote="Initial quote from page 5"), op(1, "CREATE", "project", {"title": "P"}, pages=[5], quote="x")])
    assert [(r.id, r.page_number) for r in state.sources(first).collect()] == [("msr_1", 5)]
    for pages, quote, n in (([5], "Initial quote from page 5", 1), ([10], "new", 2), ([5], "different", 2), ([5], "  Initial quote from page 5 ", 1), ([5, 6], "Initial quote from page 5", 2)):
        after = run(spark, [op(0, "UPDATE", "measure", {"note": "y"}, "msr_1", pages=pages, quote=quote)], first)
        assert state.sources(after).count() == n and content(after)["msr_1"] == {"title": "M", "note": "y"}


def test_fields_merge_by_type():
    merge = state.merge_value
    assert merge("First description with period.", "Second description part.") == "First description with period. Second description part."
    assert merge("a", "b") == "a. b" and merge("abc", "b") == "abc" and merge(" ", "b") == "b"
    assert merge(["a", "a"], ["b", "a", "b"]) == ["a", "a", "b"]
    assert merge({"x": 1, "y": 2}, {"y": 3}) == {"x": 1, "y": 3}
    assert merge(7, "seven") == "seven" and merge("seven", 7) == "seven" and merge(None, [1, 2]) == [1, 2]


def test_what_cannot_be_is_left_out_and_failures_leave_the_state(spark):
    made = [op(0, "CREATE", "action_field", {"title": "A"}), op(1, "CREATE", "project", {"title": "P"})]
    bad = [op(2, "UPDATE", "project", {"title": "x"}), op(3, "CONNECT", "project"), op(4, "DELETE", "project", {"title": "x"}), op(5, "CREATE", "project", {})]
    got = run(spark, made + bad)
    assert state.results(got).count() == 2 and len(content(got)) == 2
    assert {r.error for r in state.results(run(spark, made + bad, validated=False)).filter("not success").collect()} == {
        "UPDATE operation requires entity_id", "CONNECT operation requires connections", "Unknown operation type: DELETE", "CREATE operation requires content"
    }
    # The second item's confidence ends the operation; nothing else succeeded, so its first item goes too.
    worse = [op(0, "CONNECT", "project", links=[("af_1", "proj_1", 0.5), ("proj_1", "af_1", 1.5)], chunk=1)]
    after = run(spark, worse, got)
    assert state.connections(after).count() == 0 and "1.5" in state.results(after).first().error
    kept = run(spark, [*worse, op(1, "CREATE", "project", {"title": "Q"}, chunk=1)], got)
    assert state.connections(kept).count() == 1


def test_reasons_of_connections(spark):
    made = [op(0, "CREATE", "action_field", {"title": "A"}), op(1, "CREATE", "project", {"title": "P"})]
    links = [("af_1", "proj_1", None), ("af_1", "proj_1", None), ("temp_1", "proj_1", None), ("af_1", "NEW_2", None), ("af_9", "proj_1", None), ("af_1", "proj_9", None)]
    r = state.results(run(spark, [*made, op(2, "CONNECT", "project", links=links)])).filter("operation = 'CONNECT'").first()
    assert r.success and r.error == "Partial success: 5/6 connections failed" and r.affected == ["af_1", "proj_1"]


def test_the_fold_equals_the_set_based_operators(spark):
    rng = random.Random(7)
    kinds = list(oplog.PREFIX)
    ops = []
    for n in range(300):
        kind = rng.choice(["CREATE", "CREATE", "UPDATE", "CONNECT"])
        title = rng.choice(["Rad", "Bahn", "Bus.", None])
        ends = (f"af_{rng.randint(1, 9)}", f"proj_{rng.randint(1, 9)}")
        ops.append((f"s{n % 3}", n // 100, n, kind, rng.choice(kinds), f"proj_{rng.randint(1, 9)}" if kind == "UPDATE" else None, title, [(*ends, None)] if kind == "CONNECT" else None))
    flat = spark.createDataFrame(ops, "source_id string, chunk_index int, seq int, operation string, entity_type string, entity_id string, title string, connections array<struct<from_id string, to_id string, confidence double>>")
    flat = flat.withColumns({"description": F.lit(None).cast("string"), "tags": F.lit(None).cast("array<string>"), "confidence": F.lit(0.8), "source_pages": F.lit(None).cast("array<int>"), "source_quote": F.lit(None).cast("string")})
    json_ops = flat.withColumn("content", F.when(F.col("title").isNotNull(), F.to_json(F.struct("title"))))
    got = state.apply_log(json_ops, validated=False)
    made = oplog.create_ids(flat)
    assert {(r.source_id, r.id) for r in state.entities(got).collect()} == {(r.source_id, r.id) for r in made.collect()}
    links = oplog.connect_outcomes(flat, made).filter("outcome = 'created'")
    assert {(r.source_id, r.from_id, r.to_id) for r in state.connections(got).collect()} == {(r.source_id, r.from_id, r.to_id) for r in links.collect()}
    assert {(r.source_id, r.id): r.content["title"] for r in state.entities(got).collect()} == {(r.source_id, r.id): r.title for r in oplog.entities(flat).collect()}


CHUNKS = "source_id string, chunk_index int, text string, pages array<int>"


def scripted():
    """Two entities a chunk in two rounds, one answer that is none, then edges."""
    asked = []

    def send(prompt):
        asked.append(prompt)
        chunk = 0 if "first text" in prompt else 1
        n = sum(("first text" in p) == (chunk == 0) and "Extract nodes" in p for p in asked)
        if "Extract nodes" in prompt:
            if chunk and n == 1:
                return "no json"
            title = f"c{chunk}r{n}"
            return "<think>{x}</think>```json\n" + json.dumps({"operations": [{"operation": "CREATE", "entity_type": "action_field" if n == 1 else "project", "content": {"title": title}}, {"operation": "CONNECT", "connections": [{"from_id": "af_1", "to_id": "proj_1"}]}], "continue": n == 1}) + "\n```"
        assert "ACTION FIELD IDs:\n  af_1 → c0r1\n\nPROJECT IDs:\n  proj_1 → c0r2\n  proj_2 → c1r2" in prompt
        if chunk:
            assert "EXISTING CONNECTIONS\n- ACTION FIELD:\n  af_1 → proj_1 (0.70)" in prompt
        return json.dumps({"operations": [{"operation": "CREATE", "entity_type": "project", "content": {"title": "no"}}, {"operation": "CONNECT", "connections": [{"from_id": "af_1", "to_id": f"proj_{1 + chunk}", "confidence": 0.7}]}]})

    return send


@pytest.mark.parametrize("sweep", [False, True])
def test_two_passes(spark, sweep):
    chunks = spark.createDataFrame([("s", 0, "first text", [1, 2]), ("s", 1, "second text", [3])], CHUNKS)
    got = state.extract(chunks, scripted, sweep=sweep)
    assert {i: c["title"] for i, c in content(got).items()} == {"af_1": "c0r1", "proj_1": "c0r2", "proj_2": "c1r2"}
    assert {(r.from_id, r.to_id) for r in state.connections(got).collect()} == {("af_1", "proj_1"), ("af_1", "proj_2")}
    modes = [r["mode"] for r in state.results(got).orderBy("ord").collect()]
    assert modes[:3] == ["nodes"] * 3 and modes.count("sweep") == (2 if sweep else 0)  # in the sweep both are duplicates, and fail


def test_rounds_end(spark):
    chunks = spark.createDataFrame([("s", 0, "x", [1])], CHUNKS)
    client = lambda: lambda prompt: '{"operations": [{"operation": "CREATE", "entity_type": "project", "content": {"title": "P"}}], "continue": true}'
    assert len(content(state.extract(chunks, client, two_pass=False))) == 8
    assert len(content(state.extract(chunks, client, two_pass=False, rounds=2))) == 2


def test_pages_to_state_without_a_model(spark):
    pages = spark.createDataFrame([("s", 1, "Die Stadt baut den Radweg für die Mobilität aus."), ("s", 2, "Solar auf dem Dach."), ("t", 1, "nichts")], "source_id string, page_number int, text string")
    got = state.extract_pages(pages, state.keyword_model, two_pass=False)
    assert {(r.source_id, r.entity_type) for r in state.entities(got).collect()} == {("s", "action_field"), ("s", "project"), ("s", "indicator"), ("t", "action_field")}
    assert state.extract_pages(pages.filter("false"), state.keyword_model).count() == 0


def test_no_context_yet():
    assert state.Fold("s").context() == state.FIRST_CHUNK and state.Fold("s").edges() == ""


def test_accumulation(spark):
    chunks = spark.createDataFrame([("s", 0, "one", [1]), ("s", 1, "two", [2]), ("s", 2, "three", [3]), ("t", 0, "none", [1])], CHUNKS)

    def client():
        asked = []

        def send(prompt):
            asked.append(prompt)
            if "none" in prompt or "two" in prompt or len(asked) == 1:
                return None
            if "three" in prompt:
                assert '"title": "P"' in prompt and "These 1 action" in prompt
                return json.dumps({"action_fields": [{"action_field": "A", "projects": [{"title": "P", "measures": ["m"], "indicators": []}]}, {"action_field": "B"}]})
            return json.dumps({"action_fields": [{"action_field": "A", "projects": [{"title": "P", "measures": []}]}]})

        return send

    got = {r.source_id: json.loads(r.value)["action_fields"] for r in state.accumulate(chunks, client).collect()}
    assert got == {"s": [{"action_field": "A", "projects": [{"title": "P", "measures": ["m"]}]}, {"action_field": "B", "projects": []}], "t": []}
