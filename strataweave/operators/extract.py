"""Extraction without a model: keyword rules to operations, and the text that a model would be given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions import text as T

# Keywords, entity type, title, confidence, pages of the deterministic extractor.
RULES = (
    (("mobilität", "verkehr"), "action_field", "Mobilität und Verkehr", 0.9),
    (("energie", "klimaschutz"), "action_field", "Energie und Klimaschutz", 0.88),
    (("radweg", "fahrrad"), "project", "Ausbau Radwegenetz", 0.85),
    (("elektrobus", "öpnv"), "project", "Elektrobus-Flotte", 0.82),
    (("sanierung", "gebäude"), "measure", "Gebäudesanierung Schulen", 0.80),
    (("co2", "emission"), "indicator", "CO2-Reduktion Verkehrssektor", 0.87),
    (("erneuerbar", "solar", "photovoltaik"), "indicator", "Anteil erneuerbarer Energien", 0.84),
)
FALLBACK = ("action_field", "Allgemeine Nachhaltigkeitsmaßnahmen", 0.7)
CONNECT_CONFIDENCE, UPDATE_CONFIDENCE = 0.75, 0.78


def keyword_operations(chunks: DataFrame, rules: tuple = RULES) -> DataFrame:
    """source_id, chunk_index, seq, operation, entity_type, title, confidence from chunks (source_id, chunk_index, text).

    An action field and a project give a connection; no rule gives a fallback field; a text that names
    both kinds of ids gives an update.
    """
    low = F.lower(F.col("text"))
    op = lambda kind, entity, title, c: F.struct(F.lit(kind).alias("operation"), F.lit(entity).alias("entity_type"), F.lit(title).cast("string").alias("title"), F.lit(c).cast("double").alias("confidence"))

    def any_of(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    created = F.array_compact(F.array(*(F.when(any_of(words), op("CREATE", entity, title, c)) for words, entity, title, c in rules)))
    rows = chunks.select("source_id", "chunk_index", "text", created.alias("made"))
    has = lambda entity: F.exists("made", lambda m: m["entity_type"] == entity)
    linked = F.array_compact(F.array(
        F.when(F.size("made") == 0, op("CREATE", *FALLBACK)),
        F.when(has("action_field") & has("project"), op("CONNECT", "action_field", None, CONNECT_CONFIDENCE)),
        F.when(F.contains("text", F.lit("af_")) & F.contains("text", F.lit("proj_")), op("UPDATE", "action_field", None, UPDATE_CONFIDENCE)),
    ))
    return rows.select("source_id", "chunk_index", F.posexplode(F.concat("made", linked)).alias("seq", "o")).select("source_id", "chunk_index", "seq", "o.*")


def registry_text(entities: DataFrame, detailed: bool = False) -> DataFrame:
    """Per source and type the known entities, in order, as a model is told them; entities: source_id, entity_type, id, ord, title, description."""
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("")))
    if detailed:
        line = F.concat(F.lit("- "), "id", F.lit(": "), F.coalesce("title", F.lit("")), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" - "), F.substring("description", 1, 150))).otherwise(""))
    rows = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return entities.groupBy("source_id", "entity_type").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def prompts(chunks: DataFrame, template: str, **values: Column) -> DataFrame:
    """A template with `{name}` parts put in by plain replacement; other braces stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return chunks.withColumn("prompt", out)


def dialog_numbers(turns: DataFrame) -> DataFrame:
    """Running number of each entry of a log; turns: log, ts."""
    return turns.withColumn("number", F.row_number().over(Window.partitionBy("log").orderBy("ts")))


def stage_durations(events: DataFrame) -> DataFrame:
    """Start events paired with the next end event of their source and stage: source_id, stage, started, seconds.

    events: source_id, stage, ts, kind ('start' or 'end'). A start without an end has null seconds.
    """
    w = Window.partitionBy("source_id", "stage").orderBy("ts", "kind")
    rows = events.withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_ts", F.lead("ts").over(w)).filter("kind = 'start'")
    seconds = F.when(F.col("next_kind") == "end", (F.unix_micros("next_ts") - F.unix_micros("ts")) / 1e6)
    return rows.select("source_id", "stage", F.col("ts").alias("started"), seconds.alias("seconds"))


def token_accounting(turns: DataFrame, estimate: Column) -> DataFrame:
    """Tokens by role, and the share that answers are of prompts; turns: log, role."""
    n = turns.withColumn("tokens", estimate)
    is_user = F.col("role") == "user"
    return n.groupBy("log").agg(
        F.sum("tokens").alias("tokens"), F.coalesce(F.sum(F.when(is_user, F.col("tokens"))), F.lit(0)).alias("asked"), F.coalesce(F.sum(F.when(~is_user, F.col("tokens"))), F.lit(0)).alias("answered")
    )


ANSWER = (
    "operations ARRAY<STRUCT<operation: STRING, entity_type: STRING, entity_id: STRING, content: MAP<STRING, STRING>, "
    "connections: ARRAY<STRUCT<from_id: STRING, to_id: STRING, confidence: DOUBLE>>, confidence: DOUBLE, source_pages: ARRAY<INT>, source_quote: STRING>>, `continue` BOOLEAN"
)


def ask(chunks: DataFrame, client: Callable[[], Callable[[str], str | None]], attempts: int = 3) -> DataFrame:
    """Answers of a model to the prompts: source_id, chunk_index, answer; null after `attempts` failures.

    `client` is called once per partition and returns the function that asks; any backend can stand behind it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = client()
        for frame in frames:
            answers = []
            for prompt in frame["prompt"]:
                answer = None
                for _ in range(attempts):
                    try:
                        answer = send(prompt)
                    except (OSError, ValueError):  # a backend that is away or answers badly is asked again
                        continue
                    if answer is not None:
                        break
                answers.append(answer)
            yield frame.assign(answer=answers)[["source_id", "chunk_index", "answer"]]

    return chunks.select("source_id", "chunk_index", "prompt").mapInPandas(run, "source_id string, chunk_index int, answer string")


def answered_operations(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations of the answers, in order, and the answers that hold none (to be looked at).

    Thinking text and code fences go; list items that are no operation (stray metadata) are left out.
    """
    rows = answers.withColumn("a", F.from_json(T.repair_json(F.col("answer")), ANSWER))
    bad = rows.filter("a is null or a.operations is null").select("source_id", "chunk_index", "answer")
    each = rows.filter("a.operations is not null").select("source_id", "chunk_index", F.posexplode("a.operations").alias("seq", "o"))
    return each.filter("o.operation is not null").select("source_id", "chunk_index", "seq", "o.*"), bad
