"""The operation log: validation, ordered fold into entities and connections, summary.

operations: source_id, chunk_index, seq, operation, entity_type, entity_id, title, description, tags,
connections (array of from_id, to_id, confidence), confidence, source_pages, source_quote
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions import text as T

PREFIX = {"action_field": "af", "project": "proj", "measure": "msr", "indicator": "ind"}
ORDER = {"CREATE": 0, "UPDATE": 1, "CONNECT": 2}


def in_order(ops: DataFrame) -> DataFrame:
    """Adds priority and pos, the place of an operation in its source: by chunk, then CREATE, UPDATE, CONNECT, then seq."""
    rank = F.lit(3)
    for name, n in ORDER.items():
        rank = F.when(F.col("operation") == name, n).otherwise(rank)
    at = Window.partitionBy("source_id").orderBy("chunk_index", "priority", "seq")
    return ops.withColumn("priority", rank).withColumn("pos", F.row_number().over(at))


def by_mode(ops: DataFrame, mode: str) -> DataFrame:
    """Operations of a pass: 'nodes' creates and updates, 'connections' connects."""
    kinds = {"nodes": ("CREATE", "UPDATE"), "connections": ("CONNECT",)}
    if mode not in kinds:
        raise ValueError(f"unknown mode {mode!r}")
    return ops.filter(F.col("operation").isin(*kinds[mode]))


def validate(ops: DataFrame, known: DataFrame) -> DataFrame:
    """Adds `error`, null if valid; known: source_id, id of the entities before the batch."""
    ids = known.select("source_id", F.col("id").alias("entity_id"), F.lit(True).alias("known")).distinct()
    rows = ops.join(ids, ["source_id", "entity_id"], "left")
    op = F.col("operation")
    bad_item = F.exists("connections", lambda c: (F.coalesce(c["from_id"], F.lit("")) == "") | (F.coalesce(c["to_id"], F.lit("")) == ""))
    error = (
        F.when(~op.isin(*ORDER), "unknown operation")
        .when((op == "CREATE") & (F.coalesce("title", "description", F.lit("")) == ""), "no content")
        .when((op == "UPDATE") & (F.coalesce("entity_id", F.lit("")) == ""), "no entity id")
        .when((op == "CONNECT") & (F.coalesce(F.size("connections"), F.lit(0)) < 1), "no connections")
        .when((op == "CONNECT") & bad_item, "connection without an end")
        .when((op != "CREATE") & (F.coalesce("entity_id", F.lit("")) != "") & F.col("known").isNull(), "unknown entity")
    )
    return rows.withColumn("error", error).drop("known")


def create_ids(ops: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The created entities with ids: a counter per source and type that goes on after the highest known number.

    A creation without content fails and uses no number. source_id, id, entity_type, title, description, tags, confidence, pos.
    """
    made = in_order(ops).filter((F.col("operation") == "CREATE") & (F.coalesce("title", "description", F.lit("")) != ""))
    counter = F.row_number().over(Window.partitionBy("source_id", "entity_type").orderBy("pos"))
    prefix = F.lit("x")
    for t, p in PREFIX.items():
        prefix = F.when(F.col("entity_type") == t, p).otherwise(prefix)
    made = made.withColumn("number", counter).withColumn("prefix", prefix)
    if known is not None:
        top = known.select("source_id", F.split_part("id", F.lit("_"), F.lit(1)).alias("prefix"), F.expr("try_cast(split_part(id, '_', 2) AS BIGINT)").alias("n"))
        top = top.groupBy("source_id", "prefix").agg(F.max("n").alias("top"))
        made = made.join(top, ["source_id", "prefix"], "left").withColumn("number", F.col("number") + F.coalesce("top", F.lit(0)))
    return made.select("source_id", F.concat_ws("_", "prefix", F.col("number").cast("string")).alias("id"), "entity_type", "title", "description", "tags", "confidence", "source_pages", "source_quote", "pos")


def merge_text(old: Column, new: Column) -> Column:
    """A string with another: nothing if it is in it, else behind it as a new sentence."""
    a, b = T.strip(old), T.strip(new)
    joined = F.when(a.rlike(r"[.!?:;]\z"), F.concat(a, F.lit(" "), b)).otherwise(F.concat(a, F.lit(". "), b))
    return F.when(new.isNull(), old).when(old.isNull(), new).when(F.contains(old, new), old).otherwise(joined)


def merge_list(old: Column, new: Column) -> Column:
    """Unseen items behind, in order; duplicates in the old list stay."""
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.concat(old, F.array_distinct(F.array_except(new, old))))


def merge_other(old: Column, new: Column) -> Column:
    """The longer text of two values, the old one on a tie."""
    return F.when(old.isNull() | (F.length(new.cast("string")) > F.length(old.cast("string"))), new).otherwise(old)


def entities(ops: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The created entities after all updates that come later in the log: source_id, id, entity_type, title, description, tags, updates."""
    made = create_ids(ops, known)
    ups = in_order(ops).filter("operation = 'UPDATE'").select("source_id", F.col("entity_id").alias("id"), F.struct("pos", "title", "description", "tags").alias("u"))
    later = made.select("source_id", "id", F.col("pos").alias("made_pos")).join(ups, ["source_id", "id"]).filter("u.pos > made_pos")
    lists = later.groupBy("source_id", "id").agg(F.array_sort(F.collect_list("u")).alias("ups"))
    rows = made.join(lists, ["source_id", "id"], "left").withColumn("ups", F.coalesce("ups", F.filter(F.array(F.struct(F.col("pos"), "title", "description", "tags")), lambda x: F.lit(False))))

    def fold(s: Column, u: Column) -> Column:
        return F.struct(merge_text(s["title"], u["title"]).alias("title"), merge_text(s["description"], u["description"]).alias("description"), merge_list(s["tags"], u["tags"]).alias("tags"))

    state = F.aggregate("ups", F.struct("title", "description", "tags"), fold)
    return rows.select("source_id", "id", "entity_type", state.alias("s"), F.size("ups").alias("updates")).select("source_id", "id", "entity_type", "s.title", "s.description", "s.tags", "updates")


def source_rows(ops: DataFrame) -> DataFrame:
    """Sources that creations of measures and indicators bring: one per page, where pages and a quote are given."""
    made = create_ids(ops).filter(F.col("entity_type").isin("measure", "indicator") & (F.coalesce("source_quote", F.lit("")) != ""))
    return made.select("source_id", "id", F.explode("source_pages").alias("page_number"), F.col("source_quote").alias("quote"))


def connect_outcomes(ops: DataFrame, known: DataFrame) -> DataFrame:
    """Every connection of the log in order, with its outcome: created or the first reason against it.

    known: source_id, id, pos (place from which the entity exists; 0 for older ones).
    """
    at = known.select("source_id", "id", F.col("pos").alias("known_pos"))
    items = in_order(ops).filter("operation = 'CONNECT'").select("source_id", "pos", "confidence", F.posexplode("connections").alias("item", "c")).select(
        "source_id", "pos", "item", F.col("c.from_id").alias("from_id"), F.col("c.to_id").alias("to_id"), F.coalesce("c.confidence", "confidence").alias("confidence")
    )
    side = lambda c: at.select("source_id", F.col("id").alias(c), F.col("known_pos").alias(f"{c}_pos"))
    rows = items.join(side("from_id"), ["source_id", "from_id"], "left").join(side("to_id"), ["source_id", "to_id"], "left")
    absent = lambda c: F.col(f"{c}_pos").isNull() | (F.col(f"{c}_pos") >= F.col("pos"))
    reason = (
        F.when((F.coalesce("from_id", F.lit("")) == "") | (F.coalesce("to_id", F.lit("")) == ""), "missing id")
        .when(T.is_temporary_id(F.col("from_id")), "temporary source")
        .when(T.is_temporary_id(F.col("to_id")), "temporary target")
        .when(absent("from_id"), "source not found")
        .when(absent("to_id"), "target not found")
    )
    rows = rows.withColumn("reason", reason)
    nth = F.row_number().over(Window.partitionBy("source_id", "from_id", "to_id", F.col("reason").isNull()).orderBy("pos", "item"))
    outcome = F.when(F.col("reason").isNotNull(), F.col("reason")).when(nth > 1, "duplicate").otherwise("created")
    return rows.withColumn("outcome", outcome).select("source_id", "pos", "item", "from_id", "to_id", "confidence", "outcome")


def summary(ops: DataFrame) -> DataFrame:
    """Per source: chunks, operations by kind, share that is valid; ops as `validate` returns them."""
    kind = lambda k: F.count_if(F.col("operation") == k).alias(k.lower())
    return ops.groupBy("source_id").agg(
        F.count_distinct("chunk_index").alias("chunks"), F.count(F.lit(1)).alias("operations"), kind("CREATE"), kind("UPDATE"), kind("CONNECT"),
        F.round(F.avg(F.col("error").isNull().cast("int")), 6).alias("success_rate"),
    )


def describe(ops: DataFrame) -> DataFrame:
    """A line of text per operation."""
    links = F.array_join(F.transform("connections", lambda c: F.concat(c["from_id"], F.lit("->"), c["to_id"])), ", ")
    text = (
        F.when(F.col("operation") == "CREATE", F.concat(F.lit("CREATE "), "entity_type", F.lit(": "), F.coalesce("title", F.lit(""))))
        .when(F.col("operation") == "UPDATE", F.concat(F.lit("UPDATE "), F.coalesce("entity_id", F.lit(""))))
        .otherwise(F.concat(F.lit("CONNECT "), F.coalesce(links, F.lit(""))))
    )
    return ops.select("source_id", "chunk_index", "seq", text.alias("text"))


def merge_chunks(found: DataFrame, edges: DataFrame, remap: bool = True) -> tuple[DataFrame, DataFrame]:
    """Entities of all chunks of a source under new numbers, and their connections under the new ids.

    found: source_id, chunk_index, id, ord; edges: source_id, chunk_index, from_id, to_id, confidence.
    Without `remap` the ends keep their old ids, as the service leaves them.
    """
    prefix = F.split_part("id", F.lit("_"), F.lit(1))
    number = F.row_number().over(Window.partitionBy("source_id", prefix).orderBy("chunk_index", "ord"))
    new = found.withColumn("new_id", F.concat_ws("_", prefix, number.cast("string")))
    if not remap:
        return new, edges
    to = lambda c: new.select("source_id", "chunk_index", F.col("id").alias(c), F.col("new_id").alias(f"new_{c}"))
    both = edges.join(to("from_id"), ["source_id", "chunk_index", "from_id"]).join(to("to_id"), ["source_id", "chunk_index", "to_id"])
    return new, both.select("source_id", "chunk_index", F.col("new_from_id").alias("from_id"), F.col("new_to_id").alias("to_id"), "confidence")


def parent_edges(nodes: DataFrame, edges: DataFrame, confidence: float = 0.8) -> DataFrame:
    """Edges from parent references: nodes (source_id, id, entity_type, parent_id), edges (source_id, from_id, to_id).

    Parents are action fields of action fields, projects of measures, action fields of measures and of
    projects; the confidence is the stored default. Edges that exist are not made again.
    """
    pairs = (("action_field", "action_field"), ("project", "measure"), ("action_field", "measure"), ("action_field", "project"))
    parents = nodes.select("source_id", F.col("id").alias("parent_id"), F.col("entity_type").alias("parent_type"))
    linked = nodes.filter("parent_id is not null").join(parents, ["source_id", "parent_id"])
    fits = F.lit(False)
    for parent, child in pairs:
        fits = fits | ((F.col("parent_type") == parent) & (F.col("entity_type") == child))
    new = linked.filter(fits).select("source_id", F.col("parent_id").alias("from_id"), F.col("id").alias("to_id")).distinct()
    return new.join(edges.select("source_id", "from_id", "to_id"), ["source_id", "from_id", "to_id"], "left_anti").withColumn("confidence", F.lit(confidence))


# The least confidence that the published prompt asks of an operation of each kind.
FLOORS = {"CREATE": 0.7, "UPDATE": 0.8, "CONNECT": 0.6}


def below_floor(ops: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    """Operations whose confidence is below the floor of their kind, with `floor`. Operations without a confidence or of another kind are not among them."""
    floor = F.create_map(*(F.lit(x) for pair in (floors or FLOORS).items() for x in pair))[F.col("operation")]
    return ops.withColumn("floor", floor).filter(F.col("confidence") < F.col("floor"))


def state_changes(states: DataFrame) -> DataFrame:
    """Size of each state's JSON against the one before: source_id, step, chars, tokens, change; states: source_id, step, state."""
    chars = F.length(F.to_json("state"))
    before = F.lag("chars").over(Window.partitionBy("source_id").orderBy("step"))
    rows = states.select("source_id", "step", chars.alias("chars"))
    return rows.withColumn("tokens", F.floor(F.col("chars") / 3.5)).withColumn("change", F.col("chars") - F.coalesce(before, F.lit(0)))


LAST_NUMBER = 9_999  # of an id; entities beyond it are named by a hash of their titles


def free_ids(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """Ids for new entities per source and prefix: the smallest numbers that are not taken, in order.

    wanted: source_id, prefix, ord and perhaps title; taken: source_id, prefix, number. With titles, numbers end at LAST_NUMBER, and what is
    beyond is named by the first four digits of its title's MD5, with a running number from the second on.
    """
    n = F.row_number().over(Window.partitionBy("source_id", "prefix").orderBy("ord"))
    own = taken.filter("number >= 1").distinct().withColumn("below", F.col("number") - F.row_number().over(Window.partitionBy("source_id", "prefix").orderBy("number")))
    # The k-th free number is k plus the taken ones that have fewer than k free numbers below them: a running count, no list of what is taken.
    asked = wanted.withColumn("k", n).withColumn("taken", F.lit(0)).withColumn("mark", F.col("k").cast("bigint"))
    held = own.select("source_id", "prefix", F.lit(1).alias("taken"), F.col("below").cast("bigint").alias("mark"))
    before = Window.partitionBy("source_id", "prefix").orderBy("mark", "taken").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = asked.unionByName(held, allowMissingColumns=True).withColumn("skipped", F.sum("taken").over(before)).filter("taken = 0").drop("mark")
    skipped = F.col("skipped")
    rows = rows.withColumn("number", F.col("k") + skipped)
    id_ = F.concat_ws("_", "prefix", F.col("number").cast("string"))
    if "title" in wanted.columns:
        rows = rows.withColumn("far", F.col("number") > LAST_NUMBER).withColumn("mark", F.substring(F.md5(F.coalesce("title", F.lit(""))), 1, 4))
        again = F.row_number().over(Window.partitionBy("source_id", "prefix", "far", "mark").orderBy("ord")) - 1
        id_ = F.when(F.col("far"), F.concat_ws("_", "prefix", "mark", F.when(again > 0, again.cast("string")))).otherwise(id_)
    return rows.select("source_id", "prefix", "ord", id_.alias("id"))
