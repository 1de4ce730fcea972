"""Aggregation in halves against a plain recursion, with models that join, stall and fail."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataweave.operators import halves

TREE = "run_id string, ord int, action_field string, projects array<struct<title string, measures array<string>, indicators array<string>>>"


def stubborn():
    """Fails on halves that hold a field '!'; else joins names that are equal, but gives nothing for a half of fields '-' only."""
    join = halves.name_model()

    def send(prompt):
        names = [f["action_field"] for f in json.loads(prompt[prompt.index("[\n") :])]
        if "!" in names:
            return None
        return '{"action_fields": []}' if set(names) == {"-"} else join(prompt)

    return send


def plain(items, model, target, depth, level=0):
    """The rule as a recursion over one run."""

    def exact(some):
        out = {}
        for f in some:
            if f["action_field"] == "Overview":
                continue
            if f["action_field"] in out:
                own = out[f["action_field"]]["projects"]
                titles = {p["title"] for p in own}
                own += [p for p in f["projects"] if p["title"] not in titles]
            else:
                out[f["action_field"]] = {**f, "projects": list(f["projects"])}
        return list(out.values())

    if level >= depth:
        return exact(items)
    if len(items) <= target:
        return items
    got = []
    for half in (items[: len(items) // 2], items[len(items) // 2 :]):
        _, new = halves.ask_half(json.dumps(half), model)
        got += json.loads(new) if new else half
    if len(got) > target:
        return plain(got, model, target, depth, level + 1) if len(got) < len(items) else exact(got)
    return got


def titles(f):
    return f["action_field"], [p["title"] for p in f["projects"]]


@pytest.mark.parametrize("depth", [3, 1, 0])
def test_equals_the_recursion(spark, depth):
    r, rows = random.Random(depth), []
    for run, (n, names) in enumerate([(3, 9), (60, 5), (60, 50), (45, 25), (90, 40), (120, 70), (41, 1), (64, 30)]):
        for i in range(n):
            name = f"f{r.randrange(names)}"
            if run == 3 and i in (4, 30):
                name = "!"
            if run == 6:
                name = "-"
            if run == 7 and i % 9 == 0:
                name = r.choice(["Overview", "F1 ", "f1"])
            rows.append((f"r{run}", i, name, [(f"p{r.randrange(4)}", ["m"], []) for _ in range(r.randrange(3))]))
    r.shuffle(rows)
    left, report = halves.aggregate_halves(spark.createDataFrame(rows, TREE), stubborn, depth=depth)
    got = {}
    for x in sorted(left.collect(), key=lambda x: (x.run_id, x.ord)):
        got.setdefault(x.run_id, []).append((x.action_field, [p.title for p in x.projects]))
    for run in {x[0] for x in rows}:
        items = [{"action_field": a, "projects": [{"title": t, "measures": m} for t, m, _ in ps]} for q, _, a, ps in sorted(rows, key=lambda x: x[1]) if q == run]
        assert got.get(run, []) == [titles(f) for f in plain(items, stubborn(), 20, depth)], run
    asked = report.collect()
    assert (len(asked) > 0) == (depth > 0) and all(x.returned is None or x.reduction == round((x.asked - x.returned) / x.asked * 100, 6) for x in asked)
    assert all(x.too_aggressive == (x.reduction > 40) for x in asked if x.returned is not None)


def test_edge_cases(spark):
    tree = spark.createDataFrame([("a", 1, None, None), ("a", 1, None, None), (None, 0, "x", [(None, None, None)])], TREE).withColumn("outcome", F.lit("mine"))
    left, report = halves.aggregate_halves(tree, halves.name_model)
    assert sorted((x.run_id or "", x.ord, x.action_field, len(x.projects), x.outcome) for x in left.collect()) == [("", 0, "x", 1, "small"), ("a", 0, "", 0, "small"), ("a", 1, "", 0, "small")]
    assert report.count() == 0
    none, _ = halves.aggregate_halves(tree.limit(0), halves.name_model)
    assert none.count() == 0 and none.columns == left.columns
    sizes = spark.createDataFrame([(0,), (50_000,), (1_000_000,)], "n int").select(halves.answer_tokens(F.col("n")).alias("t"))
    assert [x.t for x in sizes.collect()] == [8192, 11428, 30720]
