"""Integrity, confidence and provenance rules, and the scores built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.config import ALLOWED, PREFIXES, REQUIRED_FIELDS, STRICT, Config
from strataweave.operators.graph import BUCKETS, type_of_id

BLANK = r"^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*$"


def r6(c: Column) -> Column:
    return F.round(c, 6)


def has_text(c: Column | str) -> Column:
    """Neither null nor white space only."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~c.rlike(BLANK), F.lit(False))


# ---- integrity -----------------------------------------------------------------------------


def dangling(entities: DataFrame, connections: DataFrame) -> DataFrame:
    """Connections whose target is no entity: an anti-join."""
    ids = entities.filter("id <> ''").select("run_id", F.col("id").alias("target_id")).distinct()
    kept = connections.filter("target_id <> ''").join(ids, ["run_id", "target_id"], "left_anti")
    return kept.select("run_id", "source_id", "target_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def id_validity(entities: DataFrame) -> DataFrame:
    """Per run: ids missing, repeated, malformed, with the wrong prefix; share of unique ids (may be negative)."""
    nth = F.row_number().over(Window.partitionBy("run_id", "id").orderBy("bucket_ord", "ord"))
    wrong = reduce(lambda a, b: a | b, ((F.col("bucket") == b) & ~F.col("id").startswith(f"{p}_") for b, p in PREFIXES.items()))
    there = F.coalesce("id", F.lit("")) != ""
    rows = entities.withColumn("nth", nth)
    out = rows.groupBy("run_id").agg(
        F.count_if(~there).alias("missing"),
        F.count_if(there & (F.col("nth") > 1)).alias("duplicates"),
        F.count_if(there & ~F.col("id").rlike(r"^[a-zA-Z][\p{L}\p{N}_]*$")).alias("malformed"),
        F.count_if(there & wrong).alias("wrong_prefix"),
        F.count_if(there & (F.col("nth") == 1)).alias("distinct_ids"),
    )
    return out.withColumn("unique_rate", r6(F.when(F.col("distinct_ids") > 0, 1 - F.col("duplicates") / F.col("distinct_ids")).otherwise(1.0)))


def field_completeness(entities: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Share of entities with text in a field; required fields that no entity has appear with 0."""
    present = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(has_text(f).cast("int") for f in fields)))
    each = entities.select("run_id", "bucket", F.explode(present).alias("field", "there"))
    found = each.groupBy("run_id", "bucket", "field").agg(r6(F.avg("there")).alias("rate"), F.sum("there").alias("n"))
    needed = [(b, f) for b, fs in REQUIRED_FIELDS.items() for f in fs]
    grid = entities.sparkSession.createDataFrame(needed, "bucket string, field string")
    required = entities.select("run_id", "bucket").distinct().join(F.broadcast(grid), "bucket")
    both = found.join(required.withColumn("required", F.lit(True)), ["run_id", "bucket", "field"], "full_outer")
    return both.filter("required or n > 0").select("run_id", "bucket", "field", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def type_violations(connections: DataFrame, strict: bool = False) -> DataFrame:
    """Connections that the table of allowed types has in neither direction (`strict`: not in this one)."""
    pairs = STRICT if strict else sorted({p for a, b in ALLOWED for p in ((a, b), (b, a))})
    allowed = connections.sparkSession.createDataFrame(pairs, "source_type string, target_type string")
    typed = connections.filter("target_id <> ''").select(
        "run_id", "source_id", "target_id", type_of_id(F.col("source_id")).alias("source_type"), type_of_id(F.col("target_id")).alias("target_type")
    )
    return typed.join(F.broadcast(allowed), ["source_type", "target_type"], "left_anti").select("run_id", "source_id", "target_id", "source_type", "target_type")


# ---- confidence ----------------------------------------------------------------------------


def connection_type(c: DataFrame) -> DataFrame:
    return c.withColumn("kind", F.concat(type_of_id(F.col("source_id")), F.lit("-"), type_of_id(F.col("target_id")))).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def confidence_by_type(connections: DataFrame, config: Config = Config()) -> DataFrame:
    """Statistics per kind of connection; sample deviation, 0 for one."""
    low = F.count_if(F.col("confidence") < config.low_confidence)
    return connection_type(connections).groupBy("run_id", "kind").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg("confidence")).alias("mean"),
        r6(F.median("confidence")).alias("median"),
        F.min("confidence").alias("least"),
        F.max("confidence").alias("most"),
        r6(F.coalesce(F.stddev_samp("confidence"), F.lit(0.0))).alias("std"),
        low.alias("low"),
        r6(low / F.count(F.lit(1))).alias("low_ratio"),
    )


def low_confidence(connections: DataFrame, config: Config = Config()) -> DataFrame:
    c = connection_type(connections)
    low = F.count_if(F.col("confidence") < config.low_confidence)
    return c.groupBy("run_id").agg(low.alias("low"), F.count(F.lit(1)).alias("total"), r6(low / F.count(F.lit(1))).alias("ratio"))


def ambiguous(connections: DataFrame, config: Config = Config()) -> DataFrame:
    """Entities with many low, widely spread or very many connections, with the reasons, least mean first."""
    per = connection_type(connections).groupBy("run_id", "source_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("confidence").alias("mean"),
        (F.count_if(F.col("confidence") < config.low_confidence) / F.count(F.lit(1))).alias("low_ratio"),
        # Rounded, so that a spread of just the limit does not pass it by the last bit of the sums.
        F.coalesce(F.round(F.stddev_samp("confidence"), 9), F.lit(0.0)).alias("std"),
    )
    reasons = F.array_compact(F.array(
        F.when(F.col("low_ratio") > 0.5, "low"),
        F.when((F.col("n") > 2) & (F.col("std") > config.confidence_spread), "spread"),
        F.when(F.col("n") > config.many_connections, "many"),
    ))
    out = per.withColumn("reasons", F.concat_ws(",", reasons)).filter("reasons <> ''")
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("mean", "source_id"))
    return out.select("run_id", "source_id", "n", r6(F.col("mean")).alias("mean"), "reasons", rank.alias("rank"))


def calibration(connections: DataFrame, config: Config = Config()) -> DataFrame:
    c = F.col("confidence")
    share = lambda cond: r6(F.avg(cond.cast("int")))
    return connection_type(connections).groupBy("run_id").agg(
        r6(F.avg(c)).alias("mean"), r6(F.max(c) - F.min(c)).alias("span"), share(c > 0.9).alias("high"),
        share((c >= config.low_confidence) & (c <= 0.9)).alias("middle"), share(c < config.low_confidence).alias("low"),
    )


def confidence_histogram(connections: DataFrame) -> DataFrame:
    """Confidences per bucket in tenths; all four buckets are there."""
    grid = connections.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    tenths = F.least(F.floor(F.col("confidence") * 10 + 1e-9), F.lit(9)).cast("bigint")
    found = connection_type(connections).groupBy("bucket", tenths.alias("tenth")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(found, "bucket", "left").select("bucket", F.coalesce("tenth", F.lit(-1)).alias("tenth"), F.coalesce("n", F.lit(0)).alias("n"))


# ---- provenance ----------------------------------------------------------------------------

SOURCED = ("measures", "indicators")


def per_entity_sources(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """Measures and indicators with their number of sources, and of sources with a quote."""
    valid = has_text("quote")
    per = sources.groupBy("run_id", F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(valid).alias("n_valid"))
    own = entities.filter(F.col("bucket").isin(*SOURCED)).select("run_id", "bucket", "id")
    return own.join(per, ["run_id", "id"], "left").fillna(0, ["n_sources", "n_valid"])


def source_coverage(per: DataFrame) -> DataFrame:
    """Share with a quote per bucket; `overall` asks for any source only."""
    share = lambda c: r6(F.avg((F.col(c) > 0).cast("int")))
    by = per.groupBy("run_id", "bucket").agg(share("n_valid").alias("coverage"))
    return by.union(per.groupBy("run_id").agg(share("n_sources").alias("coverage")).select("run_id", F.lit("overall").alias("bucket"), "coverage"))


def evidence_density(per: DataFrame) -> DataFrame:
    return per.groupBy("run_id", "bucket").agg(r6(F.avg("n_valid")).alias("density"))


def missing_sources(per: DataFrame) -> DataFrame:
    return per.filter("n_sources = 0").select("run_id", "bucket", "id")


def chunk_linkage(sources: DataFrame) -> DataFrame:
    return sources.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count("chunk_id").alias("linked"), F.count_distinct("chunk_id").alias("chunks"), r6(F.count("chunk_id") / F.count(F.lit(1))).alias("ratio")
    )


def page_validity(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Page references against the pages there are (run_id, page_number). Coverage counts invalid pages too, so it may exceed 1."""
    there = pages.select("run_id", "page_number").distinct().withColumn("known", F.lit(True))
    rows = sources.filter("page_number is not null and page_number <> 0").join(there, ["run_id", "page_number"], "left")
    total = there.groupBy("run_id").agg(F.count(F.lit(1)).alias("available"))
    out = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("refs"), F.count_if(F.col("known").isNull()).alias("invalid"), F.count_distinct("page_number").alias("pages"),
        F.min("page_number").alias("least"), F.max("page_number").alias("most"),
    )
    return out.join(total, "run_id", "left").withColumn("coverage", r6(F.col("pages") / F.col("available")))


# ---- scores --------------------------------------------------------------------------------


def capped(amount: Column, cap: float) -> Column:
    """A penalty between 0 and its cap; null counts as 0."""
    return F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.coalesce(amount.cast("double"), F.lit(0.0))))


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def scores(m: DataFrame, config: Config = Config()) -> DataFrame:
    """Five scores, penalties, bonuses, the final score and its grade, from one row of metrics per run.

    Metrics: dangling, duplicate_rate, completeness, violations, af_coverage, project_coverage, mean_measures,
    low_ratio, ambiguous, mean_confidence, source_coverage, quote_match, invalid_quotes, missing_sources,
    repetition, language_inconsistency, issues, outliers.
    """
    c = F.col
    below = lambda limit, x: F.lit(limit) - c(x)
    integrity = clip(100 - capped(5 * c("dangling"), 40) - capped(50 * c("duplicate_rate"), 30) - capped(40 * below(config.min_completeness, "completeness"), 20) - capped(2 * c("violations"), 10))
    connectivity = clip(
        100 - capped(60 * below(config.min_af_coverage, "af_coverage"), 30) - capped(50 * below(config.min_project_coverage, "project_coverage"), 25)
        - capped(20 * below(config.min_measures, "mean_measures"), 20) + F.when(c("af_coverage") > 0.95, 5.0).otherwise(0.0)
    )
    confidence = clip(100 - capped(80 * (c("low_ratio") - config.max_low_ratio), 40) - capped(3 * c("ambiguous"), 30) - capped(40 * below(config.min_mean_confidence, "mean_confidence"), 20))
    sources = clip(
        100 - capped(50 * below(config.min_source_coverage, "source_coverage"), 40) - capped(60 * below(config.min_quote_match, "quote_match"), 30)
        - capped(2 * c("invalid_quotes"), 20) - capped(c("missing_sources"), 10)
    )
    content = clip(
        100 - capped(60 * (c("repetition") - config.max_repetition), 30) - capped(50 * (c("language_inconsistency") - config.max_language_inconsistency), 25)
        - capped(2 * c("issues"), 25) - capped(1.5 * c("outliers"), 20)
    )
    parts = {"integrity": integrity, "connectivity": connectivity, "confidence": confidence, "sources": sources, "content": content}
    composite = clip(reduce(lambda a, b: a + b, (parts[k] * w for k, w in config.shares().items())))
    penalty = 2.0 * c("dangling") + F.when(c("af_coverage") < 0.5, 10.0).otherwise(0.0)
    bonus = F.when(c("af_coverage") > 0.95, 3.0).otherwise(0.0) + F.when(c("mean_confidence") > 0.9, 2.0).otherwise(0.0)
    out = m.select("run_id", *(r6(v).alias(k) for k, v in parts.items()), r6(composite).alias("composite"), penalty.alias("penalty"), bonus.alias("bonus"))
    out = out.withColumn("score", r6(clip(c("composite") - c("penalty") + c("bonus"))))
    return out.withColumn("grade", grade(c("score")))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def batch_summary(scored: DataFrame) -> DataFrame:
    """Runs and mean score over all, failed runs (null score) with 0, and the grade histogram."""
    s = scored.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("grade", grade(F.col("score")))
    total = s.agg(F.count(F.lit(1)).alias("runs"), r6(F.avg("score")).alias("mean"))
    by = s.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))
    return by.join(F.broadcast(total))


# The rules of the triage as metric, limit, severity, and whether only a verbose report has it.
TRIAGE = (
    ("dangling", 0, "critical", False), ("duplicate_texts", 50, "critical", False), ("repetition", 0.5, "critical", False), ("components", 5, "critical", False),
    ("missing_sources", 0, "minor", True), ("ambiguous", 0, "minor", False), ("isolated", 0, "minor", True),
)


def severity(m: DataFrame, verbose: bool = True) -> DataFrame:
    """run_id, rule, value, severity for metrics past the limits of the triage. Duplicate texts that are not critical are minor."""
    row = lambda k, s: F.struct(F.lit(k).alias("rule"), F.col(k).cast("double").alias("value"), F.lit(s).alias("severity"))
    found = [F.when(F.col(k) > limit, row(k, s)) for k, limit, s, wordy in TRIAGE if k in m.columns and (verbose or not wordy)]
    if "duplicate_texts" in m.columns:
        found.append(F.when((F.col("duplicate_texts") > 0) & (F.col("duplicate_texts") <= 50), row("duplicate_texts", "minor")))
    return m.select("run_id", F.inline(F.array_compact(F.array(*found))))


def compare(before: DataFrame, after: DataFrame, names: tuple[str, ...] = ("integrity", "connectivity", "confidence", "sources", "content")) -> DataFrame:
    """Two runs' scores side by side (key): change, trend, what got better and worse. No change counts as worse, as the report lists it."""
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, "key")
    change = F.col("b.score") - F.col("a.score")
    trend = F.when(change > 5, "significant improvement").when(change > 1, "slight improvement").when(change < -5, "significant regression").when(change < -1, "slight regression").otherwise("stable")
    better = F.concat_ws(",", *(F.when(F.col(f"b.{n}") > F.col(f"a.{n}"), n) for n in names))
    worse = F.concat_ws(",", *(F.when(F.col(f"b.{n}") <= F.col(f"a.{n}"), n) for n in names))
    return both.select("key", r6(change).alias("change"), trend.alias("trend"), better.alias("better"), worse.alias("worse"))
