"""Aggregation of action fields by a model in halves, level by level over all runs.

A run whose action fields are more than `target` is cut in two, the model gives back each half with like fields joined, and what both halves gave is
the next level's list, until it is short enough, nothing went away (stalled) or `depth` levels are done; the last two end in the exact merge by name.
A level is one job over all runs: one row, and one prompt, a half, so a half's fields are together in a row, as they are in the prompt; answers are
written before they are read, so no prompt is asked twice.

Cases: a half without an answer, or with one that holds no fields, stays as it was; null names are empty ones; null lists of projects are empty; a run
without fields is not in the result; repeated rows are fields of their own; further columns are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions import text as T
from strataweave.operators.state import Model, parse_answer, tidy_fields
from strataweave.session import materialize

ITEM = "STRUCT<action_field: STRING, projects: ARRAY<STRUCT<title: STRING, measures: ARRAY<STRING>, indicators: ARRAY<STRING>>>>"
ITEMS = f"ARRAY<{ITEM}>"
#: Asked for each half; a caller's own wording may take its place.
PROMPT = (
    "Join those of these {count} action fields that mean the same, so that {least} to {most} are left, and keep all projects, measures and indicators. "
    "Return JSON {\"action_fields\": [...]}.\n\n{fields}"
)
# Fields a run may have, levels, the share of fields that is to be left, the loss in percent that is too much, characters a token, the share of
# tokens that comes back, and the least and most tokens that are asked for.
TARGET, DEPTH, KEPT, TOO_MUCH, TOKEN, BACK, ANSWER = 20, 3, (0.7, 0.8), 40.0, 3.5, 0.8, (8192, 30720)


def answer_tokens(chars: Column) -> Column:
    """The number of tokens to ask a model for, from the characters of a half."""
    return F.greatest(F.lit(ANSWER[0]), F.least(F.floor(F.floor(chars / TOKEN) * BACK), F.lit(ANSWER[1])))


def ask_half(items: str, model: Model, template: str = PROMPT) -> tuple[int, str | None]:
    """Characters of the half as the prompt shows it, and the fields that came back as JSON, if any did."""
    some = json.loads(items)
    shown = json.dumps(some, indent=2, ensure_ascii=False)
    values = {"count": str(len(some)), "least": str(int(len(some) * KEPT[0])), "most": str(int(len(some) * KEPT[1])), "fields": shown}
    prompt = template
    for name, value in values.items():
        prompt = prompt.replace("{" + name + "}", value)
    fields = tidy_fields(parse_answer(model(prompt)) or {})
    return len(shown), json.dumps(fields, ensure_ascii=False) if fields else None


def _asked(halves: DataFrame, client: Callable[[], Model], template: str) -> DataFrame:
    """halves (run_id, half, items) with what the model gave."""
    run_type = halves.schema["run_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for frame in frames:
            both = [ask_half(items, model, template) for items in frame["items"]]
            yield frame.assign(chars=[b[0] for b in both], returned=[b[1] for b in both])

    rows = halves.select("run_id", "half", F.to_json("items").alias("items"))
    out = rows.mapInPandas(run, f"run_id {run_type}, half int, items string, chars bigint, returned string")
    return out.select("run_id", "half", "chars", F.from_json("items", ITEMS).alias("old"), F.from_json("returned", ITEMS).alias("new"))


def exact_fields(tree: DataFrame) -> DataFrame:
    """The fallback: fields of one exact name are one, at their first place; names in English go.

    The first one's projects stay, and of later ones those whose title no earlier one has; tree: run_id, ord, action_field, projects.
    """
    rows = tree.filter(~T.is_english_name(F.col("action_field")))
    each = rows.select("run_id", "ord", "action_field", F.posexplode_outer("projects").alias("at", "p"))
    first = F.min("ord").over(Window.partitionBy("run_id", "action_field"))
    seen = F.min(F.when(F.col("at").isNotNull(), F.col("ord"))).over(Window.partitionBy("run_id", "action_field", F.col("p.title")))
    kept = each.withColumns({"first": first, "seen": seen}).filter("at IS NULL OR seen = ord")
    lists = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("ord", "at", "p"))))
    merged = kept.groupBy("run_id", "action_field").agg(F.min("first").alias("ord"), lists.alias("ps"))
    return merged.select("run_id", "ord", "action_field", F.transform("ps", lambda x: x["p"]).alias("projects"))


def aggregate_halves(tree: DataFrame, client: Callable[[], Model], target: int = TARGET, depth: int = DEPTH, template: str = PROMPT) -> tuple[DataFrame, DataFrame]:
    """The fields that are left (run_id, ord, action_field, projects, outcome) and one row per prompt.

    tree: run_id, ord, action_field, projects (title, measures, indicators); `client` is called once per partition and returns the function that asks.
    Outcomes: small (nothing to do), done, stalled and depth (merged by exact name). The report has run_id, level, half, asked, returned (null: no answer),
    chars, answer_tokens, reduction in percent and too_aggressive.
    """
    item = F.struct(F.coalesce("action_field", F.lit("")).alias("action_field"), F.coalesce("projects", F.array()).alias("projects")).cast(ITEM)
    runs = tree.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"]).alias("items"))
    outcome = F.when(F.lit(depth < 1), "depth").when(F.size("items") <= target, "small").otherwise("open")
    state = materialize(runs.withColumn("outcome", outcome), "halves")
    report = []
    for level in range(1, depth + 1):
        n, mid = F.size("items"), F.floor(F.size("items") / 2).cast("int")
        halves = state.filter("outcome = 'open'").select("run_id", F.posexplode(F.array(F.slice("items", F.lit(1), mid), F.slice("items", mid + 1, n - mid))).alias("half", "items"))
        answers = materialize(_asked(halves, client, template), "halves")
        lost = (F.size("old") - F.size("new")) / F.size("old") * 100
        report.append(answers.select(
            "run_id", F.lit(level).alias("level"), "half", F.size("old").alias("asked"), F.when(F.col("new").isNotNull(), F.size("new")).alias("returned"), "chars",
            answer_tokens(F.col("chars")).alias("answer_tokens"), F.round(lost, 6).alias("reduction"), (lost > TOO_MUCH).alias("too_aggressive"),
        ))
        both = answers.groupBy("run_id").agg(F.sum(F.size("old")).alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("half", F.coalesce("new", "old").alias("items")))), lambda x: x["items"])).alias("items"))
        end = F.when(F.size("items") <= target, "done").when(F.size("items") >= F.col("n"), "stalled").when(F.lit(level == depth), "depth").otherwise("open")
        state = materialize(state.filter("outcome <> 'open'").unionByName(both.withColumn("outcome", end).drop("n")), "halves")
    each = state.select("run_id", "outcome", F.posexplode("items").alias("ord", "i")).select("run_id", "ord", "i.*", "outcome")
    rest = each.filter("outcome IN ('stalled', 'depth')")
    merged = exact_fields(rest.drop("outcome")).join(state.filter("outcome IN ('stalled', 'depth')").select(F.col("run_id").alias("run"), "outcome"), F.col("run_id").eqNullSafe(F.col("run"))).drop("run")
    empty = tree.sparkSession.createDataFrame([], f"run_id {tree.schema['run_id'].dataType.simpleString()}, level int, half int, asked int, returned int, chars bigint, answer_tokens bigint, reduction double, too_aggressive boolean")
    for r in report:
        empty = empty.unionByName(r)
    return each.filter("outcome IN ('small', 'done')").unionByName(merged.select(each.columns)), empty


def name_model() -> Model:
    """A model without a model: joins the fields of a prompt whose names are equal but for case and space, for tests and dry runs."""

    def send(prompt: str) -> str:
        found: dict[str, dict] = {}
        for field in json.loads(prompt[prompt.index("[\n") :]):
            own = found.setdefault(" ".join(field["action_field"].lower().split()), {"action_field": field["action_field"], "projects": []})
            titles = {p["title"] for p in own["projects"]}
            own["projects"] += [p for p in field["projects"] if p["title"] not in titles]
        return json.dumps({"action_fields": list(found.values())}, ensure_ascii=False)

    return send
