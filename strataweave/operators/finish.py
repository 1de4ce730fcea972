"""From an extracted state (`operators.state`) to checked projects: parent references, shortcuts, names, resolution, imputation.

A state comes in and goes out as `apply_log` returns it, so each step can be left out. Cases: a reference to no entity, or to one of a kind that
cannot be a parent, gives no connection; entities without a title go by their name, without both by ''; repeated titles below one project count
once; connections to unknown ids are left out of the tree; an empty state gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.operators import graph, oplog, resolve
from strataweave.operators import state as S
from strataweave.session import materialize


# The fields that name parents with the beginning of their ids, and the order in which kinds of children get their connections.
PARENTS = (("parent_action_field_id", "af_"), ("parent_project_id", "proj_"))
CHILDREN = ("action_field", "measure", "project")


def with_parents(state: DataFrame) -> DataFrame:
    """The state with a connection for every parent that an entity's content names, behind the parent's others: to action fields, measures, then projects, each in order."""
    e = S.entities(state)
    named = F.array_compact(F.array(*(F.when(F.startswith(F.col("content")[f], F.lit(p)), F.col("content")[f]) for f, p in PARENTS)))
    nodes = e.select("source_id", "id", "ord", "entity_type", F.explode_outer(named).alias("parent_id"))
    links = S.connections(state)
    rank = F.array_position(F.array(*map(F.lit, CHILDREN)), F.col("entity_type"))
    new = oplog.parent_edges(nodes, links).join(e.select("source_id", F.col("id").alias("to_id"), rank.alias("rank"), "ord"), ["source_id", "to_id"])
    last = links.groupBy("source_id", "from_id").agg(F.max("ord").alias("last"))
    place = F.coalesce(F.col("last") + 1, F.lit(0)) + F.row_number().over(Window.partitionBy("source_id", "from_id").orderBy("rank", "ord")) - 1
    rows = new.join(last, ["source_id", "from_id"], "left").select(
        "source_id", F.lit("connection").alias("kind"), F.col("from_id").alias("id"), place.cast("bigint").alias("ord"), F.to_json(F.struct("to_id", "confidence")).alias("payload")
    )
    return state.unionByName(rows)


def without_shortcuts(state: DataFrame) -> DataFrame:
    """The state without connections between action fields and measures that a project between makes redundant."""
    links = S.connections(state).select(F.col("source_id").alias("run_id"), F.col("from_id").alias("source_id"), F.col("to_id").alias("target_id"), "ord", "confidence")
    kept = graph.redundant_shortcuts(links).select(F.col("run_id").alias("source_id"), F.lit("connection").alias("kind"), F.col("source_id").alias("id"), "ord")
    return state.join(kept, ["source_id", "kind", "id", "ord"], "left_semi").unionByName(state.filter("kind <> 'connection'"))


def with_registered_names(state: DataFrame, least: float = 0.8) -> DataFrame:
    """The state with each action field under the canonical name that it takes in the order of extraction, as its title and its name."""
    title = F.coalesce(F.nullif(F.get_json_object("payload", "$.content.name"), F.lit("")), F.get_json_object("payload", "$.content.title"))
    fields = state.filter("kind = 'entity'").filter(F.get_json_object("payload", "$.entity_type") == "action_field").withColumn("name", title).filter("name <> ''")
    known = resolve.register(fields.select(F.col("source_id").alias("run_id"), F.lit("action_field").alias("kind"), "name", "ord"), least)
    to = known.select(F.col("run_id").alias("source_id"), F.lit("entity").alias("kind"), "ord", "canonical")
    old = F.from_json("payload", "entity_type STRING, content MAP<STRING, STRING>")
    # Values that are no strings keep their JSON as text, so only the two names are put in, and the rest is left as it came.
    content = F.map_concat(F.map_filter(old["content"], lambda k, v: ~k.isin("name", "title")), F.create_map(F.lit("title"), F.col("canonical"), F.lit("name"), F.col("canonical")))
    renamed = F.to_json(F.struct(old["entity_type"].alias("entity_type"), content.alias("content")))
    return state.join(to, ["source_id", "kind", "ord"], "left").withColumn("payload", F.when(F.col("canonical").isNotNull(), renamed).otherwise(F.col("payload"))).select(state.columns)


def nested(state: DataFrame) -> DataFrame:
    """The state as action fields with their projects, and these with measures and indicators by title, each in the order of the connections: run_id, ord, action_field, projects."""
    e = S.entities(state).select("source_id", "id", "ord", "entity_type", F.coalesce(F.col("content")["title"], F.col("content")["name"], F.lit("")).alias("title"))
    links = S.connections(state).select("source_id", "from_id", "to_id", F.col("ord").alias("at"))
    to = e.select("source_id", F.col("id").alias("to_id"), "entity_type", "title")
    below = links.join(to, ["source_id", "to_id"])

    def titles(kind: str):
        return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("entity_type") == kind, F.struct("at", "title")))), lambda x: x["title"]))

    details = below.filter("entity_type IN ('measure', 'indicator')").groupBy("source_id", F.col("from_id").alias("id")).agg(titles("measure").alias("measures"), titles("indicator").alias("indicators"))
    none = F.array().cast("array<string>")
    project = F.struct("title", F.coalesce("measures", none).alias("measures"), F.coalesce("indicators", none).alias("indicators"), none.alias("sources"))
    projects = e.filter("entity_type = 'project'").join(details, ["source_id", "id"], "left").select("source_id", F.col("id").alias("to_id"), project.alias("p"))
    per = links.join(projects, ["source_id", "to_id"]).groupBy("source_id", F.col("from_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("projects"))
    fields = e.filter("entity_type = 'action_field'").join(per, ["source_id", "id"], "left")
    return fields.select(F.col("source_id").alias("run_id"), "ord", F.col("title").alias("action_field"), F.coalesce("projects", F.array().cast(per.schema["projects"].dataType)).alias("projects"))


def finished(state: DataFrame, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Projects with one name for what is one and with inferred measures and indicators where they had none, and what changed per run.

    The projects have run_id, action_field, title, measures, indicators, recovered_measures, recovered_indicators; an action field without projects has
    one row without a title. `vectors` (name, v): see `resolve.resolve`.
    """
    tree = resolve.resolve_or_keep(nested(state), vectors)
    rows = tree.select("run_id", "action_field", F.explode_outer("projects").alias("p")).select("run_id", "action_field", *(F.col(f"p.{c}").alias(c) for c in ("title", "measures", "indicators")))
    bare = rows.filter("title IS NULL").withColumns({"recovered_measures": F.lit(0), "recovered_indicators": F.lit(0)})
    better = materialize(resolve.improve(rows.filter("title IS NOT NULL")).unionByName(bare), "finished")
    return better, resolve.improvement_report(rows, better)
