"""The operation log applied to a carried state, source by source, and extraction that runs a model over chunks.

A source is a document, and its operations depend on one another, so a source is one sequential fold. Its rows reach
the fold as a sorted stream, not as a group: a task holds the state of one source. What comes out is one table,
(source_id, kind, id, ord, payload), which `entities`, `connections`, `sources` and `results` take apart.

Operations within a batch (a chunk and pass) go CREATE, UPDATE, CONNECT, each in its order.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.extract import CONNECT_CONFIDENCE, FALLBACK, RULES
from strataweave.operators.oplog import ORDER, PREFIX
from strataweave.session import materialize

ROWS = "source_id string, kind string, id string, ord bigint, payload string"
#: An operation that names no confidence has this one.
CONFIDENCE = 0.8
# Beginnings of ids that stand for entities to come; kinds of entities in the order and words of a prompt.
TEMPORARY = ("temp_", "placeholder_", "new_", "created_", "temporary_", "tmp_")
KINDS = (("action_field", "ACTION FIELD"), ("project", "PROJECT"), ("measure", "MEASURE"), ("indicator", "INDICATOR"))
NO_ENTITIES = "No entities yet - use CREATE operations"
FIRST_CHUNK = "ERSTER CHUNK: Noch keine Entities extrahiert. Beginnen Sie mit CREATE-Operationen."


# What a result says of an operation or of one of its connections.
NO_CONTENT, NO_ID, NO_CONNECTIONS = "CREATE operation requires content", "UPDATE operation requires entity_id", "CONNECT operation requires connections"
NOT_FOUND, UNKNOWN = "Entity {} not found", "Unknown operation type: {}"
NO_END, TEMPORARY_SOURCE, TEMPORARY_TARGET = "missing ID", "temporary source ID", "temporary target ID"
NO_SOURCE, NO_TARGET, REPEATED = "source not found", "target not found", "duplicate connection"
OUT_OF_RANGE = "Failed to create connections: confidence {} is not between 0 and 1"
PARTLY, FAILED, FAILED_ONE = "Partial success: {}/{} connections failed", "{} failed connections: {}", "{} -> {} ({})"
SENTENCE_ENDS = (".", "!", "?", ":", ";")
CITED = frozenset(["measure", "indicator"])  # kinds of entities that keep sources

Result = tuple[str | None, list[str]]  # what is wrong, and the ids that were touched


def _sentences(old: str, new: str) -> str:
    parts = [x.strip() for x in (old, new) if x.strip()]
    return old if new in old else (" " if parts[0].endswith(SENTENCE_ENDS) else ". ").join(parts) if parts else ""


def _unseen(old: list, new: list) -> list:
    return old + [x for i, x in enumerate(new) if x not in old and x not in new[:i]]


#: How two values of one type become one; values of any other types: the longer one, the old one on ties.
MERGES: dict[type, Callable[[Any, Any], Any]] = {str: _sentences, list: _unseen, dict: lambda old, new: old | new}


def merge_value(old: Any, new: Any) -> Any:
    """Two values of one field: strings join as sentences, lists take unseen items, dicts are updated, else the longer one stays."""
    for kind, merge in MERGES.items():
        if isinstance(old, kind) and isinstance(new, kind):
            return merge(old, new)
    return max(old, new, key=lambda x: len(str(x)))


@dataclass
class Entity:
    kind: str
    content: dict[str, Any]
    links: dict[str, float] = field(default_factory=dict)  # confidence by target, in the order in which they came
    sources: list[tuple[int, str | None]] = field(default_factory=list)

    def learn(self, content: dict[str, Any]) -> None:
        self.content |= {k: merge_value(self.content[k], v) if k in self.content else v for k, v in content.items()}

    def cite(self, pages: list | None, quote: str | None) -> None:
        """Pages with a quote join the sources of a measure or an indicator, but for those it has: places are equal if page and stripped quote are."""
        if self.kind in CITED and pages and quote:
            places = {(page, text and text.strip()) for page, text in self.sources}
            self.sources += [(page, quote) for page in map(int, pages) if (page, quote.strip()) not in places]


#: The first rule that holds for a connection (state, from, to) is why it fails; none: it is made.
CONNECTION_RULES: tuple[tuple[str, Callable[[dict[str, Entity], str, str], bool]], ...] = (
    (NO_END, lambda state, a, b: not (a and b)),
    (TEMPORARY_SOURCE, lambda state, a, b: a.lower().startswith(TEMPORARY)),
    (TEMPORARY_TARGET, lambda state, a, b: b.lower().startswith(TEMPORARY)),
    (NO_SOURCE, lambda state, a, b: a not in state),
    (NO_TARGET, lambda state, a, b: b not in state),
    (REPEATED, lambda state, a, b: b in state[a].links),
)
#: The first rule that holds for an operation (state, operation) is why it is not to be tried.
OPERATION_RULES: tuple[tuple[str, Callable[[dict[str, Entity], dict], bool]], ...] = (
    ("unknown operation", lambda state, op: op.get("operation") not in ORDER),
    ("no content", lambda state, op: op["operation"] == "CREATE" and not op.get("content")),
    ("no entity id", lambda state, op: op["operation"] == "UPDATE" and not op.get("entity_id")),
    ("no connections", lambda state, op: op["operation"] == "CONNECT" and not op.get("connections")),
    ("connection without an end", lambda state, op: op["operation"] == "CONNECT" and not all(c.get("from_id") and c.get("to_id") for c in op["connections"])),
    ("unknown entity", lambda state, op: op["operation"] != "CREATE" and bool(op.get("entity_id")) and op["entity_id"] not in state),
)


class Fold:
    """One source's state, and what each operation came to."""

    def __init__(self, source: str):
        self.source = source
        self.entities: dict[str, Entity] = {}
        self.top: dict[str, int] = {}
        self.log: list[dict[str, Any]] = []
        self.made = 0

    # ---- one operation ---------------------------------------------------------------------

    def _next_id(self, kind: str) -> str:
        prefix = PREFIX.get(kind, "ent")
        self.top[prefix] = self.top.get(prefix, 0) + 1
        return f"{prefix}_{self.top[prefix]}"

    def _create(self, op: dict) -> Result:
        if not op.get("content"):
            return NO_CONTENT, []
        kind = op.get("entity_type")
        new = self._next_id(kind)
        self.entities[new] = Entity(kind, dict(op["content"]))
        self.entities[new].cite(op.get("source_pages"), op.get("source_quote"))
        self.made += 1
        return None, [new]

    def _update(self, op: dict) -> Result:
        name = op.get("entity_id")
        if name and name in self.entities:
            self.entities[name].learn(op.get("content") or {})
            self.entities[name].cite(op.get("source_pages"), op.get("source_quote"))
            return None, [name]
        return (NOT_FOUND.format(name) if name else NO_ID), []

    def _connect(self, op: dict) -> Result:
        """Connections one after the other, as an earlier one may make a later one a repetition."""
        items = op.get("connections") or []
        made: list[str] = []
        failed: list[str] = []
        for item in items:
            a, b = item.get("from_id"), item.get("to_id")
            why = next((reason for reason, holds in CONNECTION_RULES if holds(self.entities, a, b)), None)
            if why:
                failed.append(FAILED_ONE.format(a or "null", b or "null", why))
                continue
            confidence = next(c for c in (item.get("confidence"), op.get("confidence"), CONFIDENCE) if c is not None)
            if not 0 <= confidence <= 1:  # ends the operation; what it linked before stays
                return OUT_OF_RANGE.format(confidence), made
            self.entities[a].links[b] = float(confidence)
            made += [a, b]
        counts = len(failed), len(items)
        error = NO_CONNECTIONS if not items else None if not failed else PARTLY.format(*counts) if len(failed) < len(items) else FAILED.format(len(failed), "; ".join(failed))
        return error, made

    # ---- batches ---------------------------------------------------------------------------

    def problem(self, op: dict) -> str | None:
        """Why an operation is not to be tried on the state as it is."""
        return next((reason for reason, holds in OPERATION_RULES if holds(self.entities, op)), None)

    def apply(self, ops: list[dict], chunk: int, mode: str = "operations") -> int:
        """Apply a batch; the number of operations that succeeded."""
        good = 0
        for op in sorted(ops, key=lambda o: ORDER.get(o.get("operation"), 3)):
            step = {"CREATE": self._create, "UPDATE": self._update, "CONNECT": self._connect}.get(op.get("operation"))
            error, touched = step(op) if step else (UNKNOWN.format(op.get("operation")), [])
            success = error is None or error.startswith("Partial success")
            good += success
            new = touched[0] if success and op.get("operation") == "CREATE" else None
            self.log.append({"chunk": chunk, "mode": mode, "operation": op.get("operation"), "success": success, "error": error, "affected": touched, "new_id": new})
        return good

    def apply_valid(self, ops: list[dict], chunk: int, mode: str = "operations") -> int:
        """Leave out what is not to be tried, apply the rest; if nothing succeeds the old state stays."""
        valid = [op for op in ops if self.problem(op) is None]
        if not valid:
            return 0
        before = (copy.deepcopy(self.entities), dict(self.top), self.made)
        good = self.apply(valid, chunk, mode)
        if not good:
            self.entities, self.top, self.made = before
        return good

    # ---- in and out ------------------------------------------------------------------------

    def load(self, kind: str, id_: str, payload: dict) -> None:
        """Take one row of an earlier state."""
        if kind == "entity":
            self.entities[id_] = Entity(payload["entity_type"], payload["content"])
            prefix, _, number = id_.partition("_")
            if number.isdigit():
                self.top[prefix] = max(self.top.get(prefix, 0), int(number))
        elif kind == "connection" and id_ in self.entities:
            self.entities[id_].links.setdefault(payload["to_id"], payload["confidence"])
        elif kind == "source" and id_ in self.entities:
            self.entities[id_].sources.append((payload["page_number"], payload["quote"]))

    def rows(self) -> Iterator[tuple[str, str, str | None, int, str]]:
        dump = lambda x: json.dumps(x, ensure_ascii=False)
        for n, (id_, e) in enumerate(self.entities.items()):
            yield self.source, "entity", id_, n, dump({"entity_type": e.kind, "content": e.content})
            for i, (to, confidence) in enumerate(e.links.items()):
                yield self.source, "connection", id_, i, dump({"to_id": to, "confidence": confidence})
            for i, (page, quote) in enumerate(e.sources):
                yield self.source, "source", id_, i, dump({"page_number": page, "quote": quote})
        for n, r in enumerate(self.log):
            yield self.source, "result", r["new_id"], n, dump(r)

    def context(self, edges: bool = False) -> str:
        """What a model is told of the state: ids with titles and, for connections, the edges there are."""
        if not self.entities:
            return FIRST_CHUNK
        parts = []
        for kind, word in KINDS:
            own = [f"  {i} → {e.content.get('title') or ''}" for i, e in self.entities.items() if e.kind == kind]
            if own:
                parts.append("\n".join([f"{word} IDs:", *own]))
        text = "\n\n".join(parts) if parts else NO_ENTITIES
        shown = self.edges() if edges else ""
        return f"{text}\n\n{shown}" if shown else text

    def edges(self) -> str:
        """The edges from action fields to projects and from projects to measures and indicators, as a prompt lists them."""
        lines = []
        for kind, word, ends in (("action_field", "ACTION FIELD", ("proj_",)), ("project", "PROJECT", ("msr_", "ind_"))):
            own = [(i, [f"{t} ({c:.2f})" for t, c in e.links.items() if t.startswith(ends)]) for i, e in self.entities.items() if e.kind == kind]
            own = [f"  {i} → {', '.join(ts)}" for i, ts in own if ts]
            lines += [f"- {word}:", *own] if own else []
        return "\n".join(["EXISTING CONNECTIONS", *lines]) if lines else ""


def _streamed(rows: DataFrame, order: list[str], work: Callable[[str, Iterator[dict]], Fold]) -> DataFrame:
    """`work` over the rows of each source in order; a task reads its sources one after the other as a stream."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (r for frame in frames for r in frame.to_dict("records"))
        for source, own in groupby(each, key=lambda r: r["source_id"]):
            yield pd.DataFrame(list(work(source, own).rows()), columns=["source_id", "kind", "id", "ord", "payload"])

    return rows.repartition("source_id").sortWithinPartitions("source_id", *order).mapInPandas(run, ROWS)


def operation_json() -> Column:
    """An operation's columns as one JSON object, for `parse_operation`."""
    return F.to_json(F.struct("operation", "entity_type", "entity_id", "content", "connections", "confidence", "source_pages", "source_quote"))


def parse_operation(payload: str) -> dict:
    op = json.loads(payload)
    op["content"] = json.loads(op["content"]) if op.get("content") else None
    return op


def apply_log(ops: DataFrame, before: DataFrame | None = None, validated: bool = True) -> DataFrame:
    """The state after a log: source_id, kind, id, ord, payload. `before`: the state to go on from, as this returns it (its results are left out).

    ops: source_id, chunk_index, seq, operation, entity_type, entity_id, content (a JSON object as a string), connections, confidence, source_pages,
    source_quote. A chunk's operations are one batch. With `validated` those that cannot succeed are left out first.
    """
    rows = ops.select("source_id", F.lit(1).alias("step"), F.col("chunk_index").cast("bigint").alias("at"), F.col("seq").cast("bigint").alias("n"), F.lit("").alias("kind"), F.lit("").alias("id"), operation_json().alias("payload"))
    if before is not None:
        rank = F.when(F.col("kind") == "entity", 0).when(F.col("kind") == "connection", 1).otherwise(2).cast("bigint")
        rows = rows.unionByName(before.filter("kind <> 'result'").select("source_id", F.lit(0).alias("step"), rank.alias("at"), F.col("ord").alias("n"), "kind", "id", "payload"))

    def work(source: str, own: Iterator[dict]) -> Fold:
        fold = Fold(source)
        for (step, chunk), batch in groupby(own, key=lambda r: (r["step"], r["at"])):
            if not step:
                for r in batch:
                    fold.load(r["kind"], r["id"], json.loads(r["payload"]))
                continue
            (fold.apply_valid if validated else fold.apply)([parse_operation(r["payload"]) for r in batch], chunk)
        return fold

    return _streamed(rows, ["step", "at", "n"], work)


def _payload(state: DataFrame, kind: str, schema: str) -> DataFrame:
    return state.filter(F.col("kind") == kind).select("source_id", "id", "ord", F.from_json("payload", schema).alias("p")).select("source_id", "id", "ord", "p.*")


def entities(state: DataFrame) -> DataFrame:
    """source_id, id, ord, entity_type, content (field to JSON value)."""
    return _payload(state, "entity", "entity_type STRING, content MAP<STRING, STRING>")


def connections(state: DataFrame) -> DataFrame:
    """source_id, from_id, ord, to_id, confidence."""
    return _payload(state, "connection", "to_id STRING, confidence DOUBLE").withColumnRenamed("id", "from_id")


def sources(state: DataFrame) -> DataFrame:
    """source_id, id, ord, page_number, quote."""
    return _payload(state, "source", "page_number INT, quote STRING")


def results(state: DataFrame) -> DataFrame:
    """source_id, new_id, ord, chunk, mode, operation, success, error, affected."""
    return _payload(state, "result", "chunk INT, mode STRING, operation STRING, success BOOLEAN, error STRING, affected ARRAY<STRING>").withColumnRenamed("id", "new_id")


def count_connections(state: DataFrame) -> DataFrame:
    """source_id, connections: how many each source has."""
    return state.groupBy("source_id").agg(F.count_if(F.col("kind") == "connection").alias("connections"))


def log_summary(state: DataFrame) -> DataFrame:
    """Per source: chunks, operations, successes, failures, share of successes, entities created."""
    r = results(state)
    good = F.count_if("success")
    return r.groupBy("source_id").agg(
        F.count_distinct("chunk", "mode").alias("batches"), F.count(F.lit(1)).alias("operations"), good.alias("successful"), (F.count(F.lit(1)) - good).alias("failed"),
        F.round(good / F.count(F.lit(1)), 6).alias("success_rate"), F.count("new_id").alias("entities_created"),
    )


# ---- extraction with a model -----------------------------------------------------------------

#: Asked with a prompt, answers with text, or nothing if it failed.
Model = Callable[[str], str | None]
PROMPT = "Extract {what} as JSON {\"operations\": [...], \"continue\": false} from the text below (pages {pages}).\n\n{context}\n\n{text}"
MODES = {"nodes": ("CREATE", "UPDATE"), "connections": ("CONNECT",), "operations": tuple(ORDER)}


def parse_answer(answer: str | None) -> dict | None:
    """The JSON object of an answer; thinking text and code fences go. None if there is none."""
    if not answer:
        return None
    bare = re.sub(r"<think>.*?</think>", "", answer, flags=re.DOTALL)
    first, last = bare.find("{"), bare.rfind("}")
    if first < 0 or last < first:
        return None
    try:
        found = json.loads(bare[first : last + 1])
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _prompt(template: str, fold: Fold, mode: str, text: str, pages: list[int]) -> str:
    values = {"what": mode, "pages": ", ".join(map(str, pages)), "context": fold.context(edges=mode == "connections"), "text": text}
    for name, value in values.items():
        template = template.replace("{" + name + "}", value)
    return template


def _pass(fold: Fold, chunks: list[dict], mode: str, model: Model, template: str, rounds: int, label: str) -> None:
    """All chunks in one mode. A chunk is asked again while the model says that there is more or gives no answer, `rounds` times at most."""
    for chunk in chunks:
        for _ in range(rounds):
            answer = parse_answer(model(_prompt(template, fold, mode, chunk["text"], list(chunk["pages"]))))
            ops = [o for o in (answer or {}).get("operations") or () if isinstance(o, dict) and o.get("operation") in MODES[mode]]
            for o in ops:
                o.setdefault("source_pages", [int(p) for p in chunk["pages"]])
            if ops:
                fold.apply_valid(ops, int(chunk["chunk_index"]), label)
            if answer is not None and not answer.get("continue"):
                break


def extract(chunks: DataFrame, client: Callable[[], Model], two_pass: bool = True, sweep: bool = False, rounds: int = 8, template: str = PROMPT) -> DataFrame:
    """The state that a model extracts from chunks (source_id, chunk_index, text, pages), as `apply_log` returns it.

    Two passes: entities of all chunks, then connections of all chunks, then, with `sweep`, connections once more, without repeats. Else one pass with all
    operations. `client` is called once per source and returns the function that asks.
    """

    def work(source: str, own: Iterator[dict]) -> Fold:
        fold, model = Fold(source), client()
        some = list(own)  # one document, read twice
        if two_pass:
            _pass(fold, some, "nodes", model, template, rounds, "nodes")
            _pass(fold, some, "connections", model, template, rounds, "connections")
            if sweep:
                _pass(fold, some, "connections", model, template, 1, "sweep")
        else:
            _pass(fold, some, "operations", model, template, rounds, "operations")
        return fold

    return _streamed(chunks.select("source_id", "chunk_index", "text", "pages"), ["chunk_index"], work)


def keyword_model() -> Model:
    """A model without a model: the keyword rules over the text of the prompt, for tests and dry runs."""

    def send(prompt: str) -> str:
        low = prompt.lower()
        found = [(kind, title, c) for words, kind, title, c in RULES if any(w in low for w in words)]
        ops = [{"operation": "CREATE", "entity_type": kind, "content": {"title": title}, "confidence": c} for kind, title, c in found or [FALLBACK]]
        ids = {p: re.search(rf"\b{p}_\d+", prompt) for p in ("af", "proj")}
        if all(ids.values()):
            ops.append({"operation": "CONNECT", "entity_type": "action_field", "connections": [{"from_id": ids["af"][0], "to_id": ids["proj"][0], "confidence": CONNECT_CONFIDENCE}]})
        return json.dumps({"operations": ops, "continue": False})

    return send


def extract_pages(pages: DataFrame, client: Callable[[], Model], most: int = 8000, least: int = 1500, parents: bool = True, prune: bool = False, **settings) -> DataFrame:
    """From pages (source_id, page_number, text) to the extracted state: packing, headers, extraction, connections of parent references.

    `prune` leaves out shortcuts past a project. `operators.finish` makes checked projects of the state.
    """
    from strataweave.operators import finish
    from strataweave.operators.chunking import pack_pages, with_header

    found = materialize(extract(with_header(pack_pages(pages, most, least)), client, **settings), "extracted")  # the model is asked once
    found = finish.with_parents(found) if parents else found
    return finish.without_shortcuts(found) if prune else found


ENHANCE = "These {count} action fields were found so far:\n{found}\n\nReturn them all as JSON {\"action_fields\": [...]}, with what the text below adds.\n\n{text}"
FIRST = "Extract action fields with their projects, measures and indicators as JSON {\"action_fields\": [...]} from the text below.\n\n{text}"


def tidy_fields(answer: dict) -> list[dict]:
    """The action fields of an answer; projects lose empty lists, as published."""
    out = []
    for af in answer.get("action_fields") or ():
        own = [{"title": p.get("title"), **{k: p[k] for k in ("measures", "indicators") if p.get(k)}} for p in af.get("projects") or ()]
        out.append({"action_field": af.get("action_field"), "projects": own})
    return out


def accumulate(chunks: DataFrame, client: Callable[[], Model], attempts: int = 3, first: str = FIRST, enhance: str = ENHANCE) -> DataFrame:
    """source_id, value (nested extraction as JSON): each chunk's prompt holds what was found so far, and the answer replaces it; without an answer it stays.

    The first chunk is asked up to `attempts` times. Projects lose empty lists, as published.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (r for frame in frames for r in frame.to_dict("records"))
        for source, own in groupby(each, key=lambda r: r["source_id"]):
            model, found = client(), None
            for r in own:
                if found is None:
                    answers = (parse_answer(model(first.replace("{text}", r["text"]))) for _ in range(attempts))
                    found = tidy_fields(next((a for a in answers if a is not None), {}))
                    continue
                values = {"count": str(len(found)), "found": json.dumps({"action_fields": found}, indent=2, ensure_ascii=False), "text": r["text"].strip()}
                prompt = enhance
                for name, value in values.items():
                    prompt = prompt.replace("{" + name + "}", value)
                answer = parse_answer(model(prompt))
                found = found if answer is None else tidy_fields(answer)
            yield pd.DataFrame({"source_id": [source], "value": [json.dumps({"action_fields": found or []}, ensure_ascii=False)]})

    rows = chunks.select("source_id", "chunk_index", "text").repartition("source_id").sortWithinPartitions("source_id", "chunk_index")
    return rows.mapInPandas(run, "source_id string, value string")
