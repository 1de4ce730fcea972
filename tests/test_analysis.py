"""The analysis held against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from strataweave.plans import analyze
from strataweave.sources import graphs, pages, sinks


def entity(id_, title, *links, **more):
    return {"id": id_, "content": {"title": title, "name": title, "description": f"The {title} of the plan"}, "connections": [{"target_id": t, "confidence_score": c} for t, c in links], **more}


def review():
    """One entity a bucket around a project; one source."""
    return {
        "action_fields": [entity("af_1", "Action Field 1", ("proj_1", 0.9))],
        "projects": [entity("proj_1", "Project One", ("af_1", 0.9), ("msr_1", 0.8))],
        "measures": [entity("msr_1", "Measure One", ("proj_1", 0.8), sources=[{"page_number": 1, "quote": "we will plant  many trees"}])],
        "indicators": [entity("ind_1", "Indicator One", ("proj_1", 0.7))],
    }


TREE = {"action_fields": [{"action_field": "A", "projects": [{"title": "P", "measures": ["M"], "indicators": ["I"]}]}]}


def write(folder, name, data):
    (folder / name).write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf-8")


def by_name(df):
    return {r.run_id.rsplit("/", 1)[1]: r for r in df.collect()}


def test_scores_of_a_small_graph(spark, tmp_path):
    write(tmp_path, "f1.json", review())
    r = by_name(analyze.analyze(spark, str(tmp_path)))["f1.json"]
    # 100 - 15 for half of the sources - 30 for no quotes checked - 1 for the indicator without one
    assert (r.integrity, r.connectivity, r.confidence, r.sources) == (100.0, 100.0, 100.0, 54.0)
    assert (r.format, r.total_entities, r.total_connections, r.critical_issues, r.error) == ("EnrichedReviewJSON", 4, 3, 0, None)


def test_quotes_are_checked_against_the_page_file_beside(spark, tmp_path):
    data = review()
    data["measures"][0]["sources"] += [
        {"page_number": 2, "quote": "new trams go to every parts of town"}, {"page_number": 2, "quote": "words that are not there at all"},
        {"page_number": 9, "quote": "x"}, {"page_number": 2, "quote": "  "}, {"page_number": 0, "quote": "y"},
    ]
    write(tmp_path, "city_operations_result.json", data)
    write(tmp_path, "city_pages.txt", "=== Page 1 ===\nYes, we will plant  many trees.\n=== Page 2 ===\nAnd new trams go to every part of town, soon.\n")
    t = analyze.tables(graphs.read_graphs(spark, str(tmp_path)), pages.beside(spark, str(tmp_path)))
    assert sorted((r.src_ord, r.outcome) for r in analyze.quote_checks(t).collect()) == [(0, "exact"), (1, "fuzzy"), (2, "no_match"), (3, "page_not_found")]
    r = by_name(analyze.results(t))["city_operations_result.json"]
    # Half of the quotes hold: 100 - 15 - 21 (60 x 0.35) - 4 (two invalid) - 1.
    assert r.sources == 59.0 and r.invalid_quotes == 2.0 and r.critical_issues == 2


def test_nested_empty_and_broken_files(spark, tmp_path):
    write(tmp_path, "t.json", TREE)
    write(tmp_path, "e.json", {"action_fields": []})
    write(tmp_path, "b.json", "{")
    write(tmp_path, "l.json", "[1]")
    got = by_name(analyze.analyze(spark, str(tmp_path)))
    assert (got["t.json"].format, got["t.json"].total_entities, got["t.json"].total_connections) == ("ExtractionResult", 4, 3)
    assert got["t.json"].af_coverage == 1.0 and got["t.json"].connectivity == 100.0
    assert got["e.json"].format == "empty" and got["e.json"].total_entities == 0
    for name in ("b.json", "l.json"):
        assert (got[name].score, got[name].grade, got[name].error) == (0.0, "F", "not a JSON object")
    sinks.write_csv(analyze.batch_table(spark.createDataFrame([(r.run_id, r.score, r.grade, r.format, r.total_entities, r.total_connections, r.critical_issues, r.error) for r in got.values()], "run_id string, score double, grade string, format string, total_entities long, total_connections long, critical_issues long, error string")), str(tmp_path / "csv"))
    head = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()[0]
    assert head == "file_path,overall_score,grade,format,total_entities,total_connections,critical_issues,analysis_time_ms,error"


def test_bad_references(spark, tmp_path):
    data = review()
    data["action_fields"][0]["connections"].append({"target_id": "nonexistent_proj", "confidence_score": 0.9})
    data["projects"].append(entity("af_1", "Other"))
    write(tmp_path, "f4.json", data)
    r = by_name(analyze.analyze(spark, str(tmp_path)))["f4.json"]
    assert r.dangling == 1 and r.critical_issues == 1 and r.integrity == 100 - 5 - 2


def test_all_string_fields_and_missing_ones_count(spark, tmp_path):
    data = review()
    data["measures"][0]["content"] = {"name": "Only a name", "Kosten": "viel  Geld", "tags": ["a  b"], "n": 3}
    write(tmp_path, "m.json", data)
    t = analyze.tables(graphs.read_graphs(spark, str(tmp_path)))
    m = analyze.metrics(t).first()
    assert m.issues == 1.0  # the double space of Kosten; lists and numbers are no text
    assert m.outliers == 2.0  # no title of its own, no description


def test_language_is_by_entity(spark, tmp_path):
    data = review()
    data["indicators"][0]["content"] = {"title": "Der Plan und die Stadt", "description": "für das Haus"}
    write(tmp_path, "l.json", data)
    t = analyze.tables(graphs.read_graphs(spark, str(tmp_path)))
    assert analyze.metrics(t).first().language_inconsistency == 0.25
    detect = lambda x: F.when(F.contains(x, F.lit("Stadt")), "de").otherwise("en")
    assert analyze.metrics(t, detect=detect).first().language_inconsistency == 0.25


def test_registered_metrics_are_reported(spark, tmp_path):
    write(tmp_path, "f1.json", review())
    analyze.register_metric("longest_title", lambda t, config: t.entities.groupBy("run_id").agg(F.max(F.length("title")).alias("value")))
    try:
        assert analyze.analyze(spark, str(tmp_path)).first().longest_title == 14.0
    finally:
        analyze.unregister_metric("longest_title")
    with pytest.raises(ValueError):
        analyze.register_metric("dangling", lambda t, config: t.entities)


def test_comparison_has_the_drift(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    after = review()
    after["action_fields"].append(entity("af_2", "Action Field 2"))
    for folder, data in (("a", review()), ("b", after)):
        write(tmp_path / folder, "x.json", data)
        write(tmp_path / folder, "y.json", review())
    got = {r.key: r for r in analyze.compare_paths(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert set(got) == {"x", "y"}
    # 100 - 12.5 for a quarter of the buckets' churn - 15 for half of the coverage + 5
    assert (got["x"].churn, got["x"].stability, got["x"].stability_grade) == (0.175, 77.5, "C") and got["x"].af_coverage == -0.5
    assert got["y"].change == 0.0 and got["y"].stability == 100.0
    changes = analyze.compare_paths(spark, str(tmp_path / "a" / "x.json"), str(tmp_path / "b" / "y.json"))
    assert "stability grade A" in sinks.comparison_report(changes) and "<table>" in sinks.html_comparison(changes)


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path, "f1.json", review())
    assert analyze.main(["analyze", str(tmp_path / "f1.json"), "--verbose"]) == 0
    assert "integrity: 100.0" in capsys.readouterr().out
    assert analyze.main(["batch", str(tmp_path), "--format", "html", "--output", str(tmp_path / "r.html")]) == 0
    assert "<h2>Overview</h2>" in (tmp_path / "r.html").read_text()
    assert analyze.main(["config"]) == 0 and "weights" in capsys.readouterr().out


def test_comparison_keeps_every_pair_and_reports_say_what_they_leave_out(spark, tmp_path):
    for side in ("a", "b"):
        (tmp_path / side).mkdir()
        for i in range(103):
            fields = [{"id": f"af_{n}", "content": {"title": f"F{n}"}, "connections": []} for n in range(1 + (i % 3) * (side == "b"))]
            data = {"action_fields": fields, "projects": [], "measures": [], "indicators": []}
            (tmp_path / side / f"s{i:03d}.json").write_text(json.dumps(data), encoding="utf-8")
    changes = spark.createDataFrame(analyze.compare_paths(spark, str(tmp_path / "a"), str(tmp_path / "b")).toPandas())
    got = {r.key: r.churn for r in changes.collect()}
    assert len(got) == 103
    one = [analyze.tables(graphs.read_graphs(spark, f"{tmp_path}/{s}/s002.json", strict=True)) for s in ("a", "b")]
    alone = analyze.drift_between(*((t.entities, t.connections) for t in one)).first()
    assert got[next(k for k in got if k.endswith("002"))] == alone["churn"] or alone["churn"] is None
    assert sinks.comparison_report(changes, most=100).endswith("... and 3 more") and "... and 3 more" in sinks.html_comparison(changes, most=100)
