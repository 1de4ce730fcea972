"""The whole analysis of graph files, and its command line: analyze, compare, batch, report, config."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.config import Config
from strataweave.functions import text as T
from strataweave.operators import content, drift, graph, paths, quality, resolve
from strataweave.session import materialize
from strataweave.sources import graphs as files
from strataweave.sources import pages as page_files
from strataweave.sources import sinks


@dataclass
class Tables:
    """What metrics are computed from, each table keyed by run_id."""

    graphs: DataFrame
    entities: DataFrame
    connections: DataFrame
    sources: DataFrame
    nodes: DataFrame
    edges: DataFrame
    pages: DataFrame  # run_id, page_number, text

    def release(self) -> None:
        for t in (self.graphs, self.entities, self.connections, self.sources, self.nodes, self.edges, self.pages):
            t.unpersist()


#: A metric that the caller adds: from the tables and the configuration to run_id and value.
Metric = Callable[[Tables, Config], DataFrame]
_METRICS: dict[str, Metric] = {}


def register_metric(name: str, metric: Metric) -> None:
    """Have every analysis report one more metric, in a column of its own beside the scores."""
    if not name.isidentifier() or name in ZERO:
        raise ValueError(f"no name for a metric: {name!r}")
    _METRICS[name] = metric


def unregister_metric(name: str) -> None:
    _METRICS.pop(name, None)


ZERO = (
    "dangling", "duplicate_rate", "violations", "ambiguous", "missing_sources", "repetition", "language_inconsistency", "issues", "outliers", "low_ratio",
    "af_coverage", "project_coverage", "mean_measures", "source_coverage", "completeness", "mean_confidence", "quote_match", "invalid_quotes", "total_entities", "total_connections",
)


SMALL = 8 << 20  # bytes of graph files up to which one partition holds the tables, so that nothing is shuffled


def tables(graphs: DataFrame, pages: DataFrame | None = None) -> Tables:
    """The tables of graph files, kept while they are read more than once. pages: folder, source_id, page_number, text, as `pages.beside` gives them."""
    graphs = graphs.persist()
    small = (graphs.agg(F.sum("size").alias("n")).first()["n"] or 0) <= SMALL
    keep = (lambda t: t.coalesce(1).persist()) if small else DataFrame.persist
    if small:
        graphs = keep(graphs)
    e, c, s = (keep(t) for t in (files.entities(graphs), files.connections(graphs), files.sources(graphs)))
    nested, nested_edges = graph.hierarchical_nodes_edges(files.trees(graphs))
    at = F.struct(F.lit(0).alias("bucket_ord"), F.lit(0).cast("bigint").alias("ord"))
    nodes = graph.build_nodes(e).unionByName(nested.select("run_id", "node", "type", "name", at.alias("pos")))
    nodes = keep(nodes)
    edges = graph.build_edges(nodes, c).unionByName(nested_edges.withColumn("confidence", F.lit(None).cast("double")))
    edges = keep(edges)
    runs = graphs.select("run_id", page_files.folder(F.col("run_id")).alias("folder"), page_files.source_key(F.col("run_id")).alias("source_id"))
    if pages is None:
        pages = graphs.sparkSession.createDataFrame([], "folder string, source_id string, page_number int, text string")
    own = runs.join(pages, ["folder", "source_id"]).select("run_id", "page_number", "text")
    own = keep(own)
    return Tables(graphs, e, c, s, nodes, edges, own)


def quote_checks(t: Tables, config: Config = Config()) -> DataFrame:
    """run_id, entity_id, src_ord, page_number, quote, outcome for the quotes of measures and indicators in runs that have pages."""
    asked = t.sources.filter(F.col("bucket").isin("measures", "indicators") & (F.coalesce("page_number", F.lit(0)) != 0)).join(t.pages.select("run_id").distinct(), "run_id", "left_semi")
    asked = asked.select("run_id", "page_number", "quote", F.struct("bucket", "entity_id", "src_ord").alias("q_id"))
    found = resolve.fuzzy_quote(asked, t.pages, config.fuzzy_match, ("run_id", "page_number"))
    return found.select("run_id", "q_id.entity_id", "q_id.src_ord", "page_number", "outcome")


def metrics(t: Tables, config: Config = Config(), detect=None) -> DataFrame:
    """One row of metrics per run, for `quality.scores`: every metric is a row (run_id, name, value), and one shuffle brings a run's together.

    `detect`: a language detector, see `content.detected_languages`.
    """
    degree = graph.degrees(t.nodes, t.edges)
    per = quality.per_entity_sources(t.entities, t.sources)
    some = content.texts(t.entities, content.FIELDS)
    every = content.all_texts(t.entities)
    names = t.entities.filter("title <> ''").select("run_id", "bucket", F.col("title").alias("name"), "ord")
    required = t.entities.withColumn("title", F.col("own_title"))

    def row(name: str, frame: DataFrame, value=None) -> DataFrame:
        value = F.count(F.lit(1)) if value is None else value
        return frame.groupBy("run_id").agg(value.cast("double").alias("value")).select("run_id", F.lit(name).alias("name"), "value")

    checks = quote_checks(t, config)
    valid = F.col("outcome").isin("exact", "fuzzy")
    language = content.language_consistency(content.detection_texts(t.entities) if detect else content.entity_texts(t.entities), detect)
    parts = [
        row("dangling", quality.dangling(t.entities, t.connections)),
        row("duplicate_rate", resolve.duplicate_rate(names, resolve.star_groups(names, config.duplicate_similarity)), F.avg("rate")),
        row("completeness", quality.field_completeness(t.entities, ("title", "name", "description")), F.min("rate")),
        row("violations", quality.type_violations(t.connections)),
        row("af_coverage", graph.action_field_coverage(t.nodes, t.edges, degree), F.max("coverage")),
        row("project_coverage", graph.project_coverage(t.nodes, t.edges), F.max("coverage")),
        row("mean_measures", graph.measures_per_project(t.nodes, t.edges), F.avg("measures")),
        row("low_ratio", quality.low_confidence(t.connections, config), F.max("ratio")),
        row("ambiguous", quality.ambiguous(t.connections, config)),
        row("mean_confidence", t.connections, F.avg(F.coalesce("confidence", F.lit(1.0)))),
        row("source_coverage", per, F.avg((F.col("n_sources") > 0).cast("int"))),
        row("missing_sources", quality.missing_sources(per)),
        row("quote_match", checks, F.avg(valid.cast("int"))),
        row("invalid_quotes", checks.filter(~valid)),
        row("repetition", content.repetition_rate(some.select("run_id", T.compare_form(F.col("text")).alias("norm")), config.near_duplicate), F.max("rate")),
        row("language_inconsistency", language, F.max("inconsistency")),
        row("issues", content.normalization_issues(every)),
        row("outliers", content.outliers(every.filter(T.strip(F.col("text")) != ""), config).select("run_id").union(content.missing_required(required).select("run_id"))),
        row("total_entities", t.nodes),
        row("total_connections", t.edges),
        *(row(name, made(t, config), F.max("value")) for name, made in sorted(_METRICS.items())),
    ]
    while len(parts) > 1:  # in pairs, so that no long chain of plans is analysed again at each step
        parts = [reduce(DataFrame.union, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    [long] = parts
    columns = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in (*ZERO, *sorted(_METRICS))]
    found = long.groupBy("run_id").agg(*columns)
    return t.graphs.select("run_id", "layout").distinct().join(found, "run_id", "left").fillna(0.0, list(ZERO))


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per run: components, nodes of the largest, its path lengths, and mean, most, least and deviation of four centralities over all nodes.

    nodes: run_id, node, type and further columns; edges: run_id, u, v. Runs without pairs in reach have no path lengths. All nodes count, whatever the graph's size.
    """
    labels = materialize(graph.components(nodes, edges), "components")
    largest = paths.largest_component(labels)
    reached = materialize(paths.reach(nodes, edges), "reach")
    values = {
        "degree": graph.degree_centrality(graph.degrees(nodes, edges)), "closeness": paths.closeness(reached),
        "betweenness": nodes.select("run_id", "node").join(paths.betweenness(edges), ["run_id", "node"], "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0))),
        "pagerank": graph.pagerank(nodes, edges).withColumnRenamed("rank", "centrality"),
    }
    out = labels.groupBy("run_id").agg(F.count_distinct("component").alias("components")).join(largest.groupBy("run_id").agg(F.count(F.lit(1)).alias("largest")), "run_id")
    out = out.join(paths.path_lengths(reached.join(largest, ["run_id", "node"], "left_semi")).drop("pairs"), "run_id", "left")
    for name, value in values.items():
        summary = graph.centrality_summary(value)
        out = out.join(summary.select("run_id", *(F.col(c).alias(f"{name}_{c}") for c in summary.columns if c != "run_id")), "run_id", "left")
    return out


def results(t: Tables, config: Config = Config(), detect=None) -> DataFrame:
    """Scores and counts of every run. A run that is no JSON object has the score 0, the grade F and an error."""
    found = metrics(t, config, detect).persist()
    extra = found.select(
        "run_id", F.col("layout").alias("format"), *(F.col(c).cast("bigint").alias(c) for c in ("total_entities", "total_connections")),
        (F.col("dangling") + F.col("invalid_quotes")).cast("bigint").alias("critical_issues"), "dangling", "invalid_quotes", "af_coverage", *sorted(_METRICS),
    )
    both = quality.scores(found, config).join(extra, "run_id")
    bad = F.col("format") == "unreadable"
    failed = {"score": F.when(bad, 0.0).otherwise(F.col("score")), "grade": F.when(bad, "F").otherwise(F.col("grade")), "error": F.when(bad, "not a JSON object")}
    return both.withColumns(failed)


def analyze(spark: SparkSession, path: str, config: Config = Config(), pattern: str = "*.json", detect=None) -> DataFrame:
    """Scores of all graph files below a path, with the page files beside them."""
    return results(tables(files.read_graphs(spark, path, pattern), page_files.beside(spark, _folder(path))), config, detect)


def _folder(path: str) -> str:
    """Where the page files of a path of results lie."""
    return path.rsplit("/", 1)[0] or "/" if path.endswith(".json") and "/" in path else "." if path.endswith(".json") else path


def batch_table(scored: DataFrame, milliseconds: float = 0.0) -> DataFrame:
    """The columns of a batch file: fixed ones first."""
    named = scored.withColumnsRenamed({"run_id": "file_path", "score": "overall_score"}).withColumn("analysis_time_ms", F.lit(float(milliseconds)))
    return named.select(*sinks.LEADING)


def drift_between(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """A row a pair of states: churn, stability score and grade, most volatile bucket, advice. The two are (entities, connections); `by`: columns that name a pair."""
    return drift.stability(
        drift.node_churn(before, after, by), drift.edge_churn(before[1], after[1], by), drift.coverage_delta(before, after, by), drift.confidence_drift(before[1], after[1], by),
        drift.structural_similarity(before, after, by), by,
    )


PAIR = ("pair", "run_a", "run_b")


def compare_paths(spark: SparkSession, before: str, after: str, config: Config = Config()) -> DataFrame:
    """Runs of one source on both sides: change of scores, and the drift from one to the other, for all pairs at once.

    Two single files are compared whatever their names. The drift of all pairs comes from the same few joins, keyed by pair.
    """
    sides = [tables(files.read_graphs(spark, p, strict=True), page_files.beside(spark, _folder(p))) for p in (before, after)]
    single = all(p.endswith(".json") for p in (before, after))
    key = F.lit("run") if single else page_files.source_key(F.col("run_id"))
    scored = [materialize(results(t, config).withColumn("key", key), "scores") for t in sides]
    of = lambda i, s: scored[i].select("key", F.col("run_id").alias(f"run_{s}"), F.col("dangling").alias(f"dangling_{s}"), F.col("af_coverage").alias(f"coverage_{s}"))
    pairs = materialize(of(0, "a").join(of(1, "b"), "key").withColumn("pair", F.col("key")), "pairs")

    def state(i: int, run: str) -> tuple[DataFrame, DataFrame]:
        own = pairs.select(*PAIR, F.col(run).alias("run_id"))
        return tuple(materialize(df.join(own, "run_id").drop("run_id"), "state") for df in (sides[i].entities, sides[i].connections))

    found = drift_between(state(0, "run_a"), state(1, "run_b"), PAIR).withColumnsRenamed({"score": "stability", "grade": "stability_grade"})
    found = materialize(found, "drift")
    out = quality.compare(*scored).join(pairs, "key").join(found, list(PAIR), "left")
    change = F.format_string("Quality %s (Δ%+.1f points), stability grade %s", "trend", F.col("change").cast("double"), "stability_grade")
    return out.select(
        "key", F.col("run_a").alias("before"), F.col("run_b").alias("after"), "change", "trend", "better", "worse", (F.col("dangling_a") - F.col("dangling_b")).cast("double").alias("dangling_refs_fixed"),
        (F.col("coverage_b") - F.col("coverage_a")).cast("double").alias("af_coverage"), "churn", "stability", "stability_grade", "volatile", "advice", change.alias("summary"),
    )


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strataweave")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("analyze", "batch"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--config")
        p.add_argument("--format", choices=("terminal", "json", "csv", "html"), default="terminal")
        p.add_argument("--output")
        p.add_argument("--pattern", default="*.json")
        p.add_argument("--verbose", action="store_true")
    p = sub.add_parser("compare")
    p.add_argument("before")
    p.add_argument("after")
    p.add_argument("--format", choices=("terminal", "json", "html"), default="terminal")
    p.add_argument("--output")
    p = sub.add_parser("report")
    p.add_argument("saved")
    p.add_argument("--format", default="html")
    p = sub.add_parser("config")
    p.add_argument("--output")
    a = parser.parse_args(args)

    def put(text: str) -> None:
        if getattr(a, "output", None):
            with open(a.output, "w", encoding="utf-8") as file:
                file.write(text)
        else:
            print(text)

    if a.command == "config":
        put(Config().to_json())
        return 0
    if a.command == "report":
        with open(a.saved, encoding="utf-8") as file:
            print(sinks.render(file.read(), a.format))
        return 0
    from strataweave.session import build_session

    spark = build_session()
    if a.command == "compare":
        changes = compare_paths(spark, a.before, a.after)
        if a.format == "json":
            put("\n".join(changes.toJSON().collect()))
        else:
            put(sinks.comparison_report(changes) if a.format == "terminal" else sinks.html_comparison(changes))
        return 0
    config = Config()
    if a.config:
        with open(a.config, encoding="utf-8") as file:
            config = Config.from_json(file.read())
    begin = time.monotonic()
    if a.command == "analyze":
        files.read_graphs(spark, a.path, a.pattern, strict=True)
    scores = analyze(spark, a.path, config, a.pattern).persist()
    runs = max(scores.count(), 1)
    table = batch_table(scores, round(1000 * (time.monotonic() - begin) / runs, 3))
    if a.format == "terminal":
        put(sinks.terminal_report(scores, verbose=a.verbose))
        if a.command == "batch":
            quality.batch_summary(scores).orderBy("grade").show()
    elif a.format == "html":
        put(sinks.html_report(scores))
    else:
        {"json": sinks.write_json, "csv": sinks.write_csv}[a.format](table, a.output or "scores")
    return 0


if __name__ == "__main__":
    sys.exit(main())
