"""Queries of the integrity, confidence, provenance and score families."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.operators import graph, quality
from strataweave.plans import adapters
from strataweave.plans.adapters import GRAPH
from strataweave.plans.registry import query
from strataweave.session import materialize

KIND = lambda c: f"CASE WHEN {c} LIKE 'af!_%' ESCAPE '!' THEN 'af' WHEN {c} LIKE 'proj!_%' ESCAPE '!' THEN 'proj' WHEN {c} LIKE 'msr!_%' ESCAPE '!' THEN 'msr' WHEN {c} LIKE 'ind!_%' ESCAPE '!' THEN 'ind' ELSE 'unknown' END"
TYPED = f"typed AS (SELECT *, {KIND('source_id')} AS s, {KIND('target_id')} AS t FROM connections)"
#: Entities with faults: suppliers under measures' ids, some without an id, some with another prefix.
FAULTY = """
  SELECT bucket, bucket_ord, id, ord, title, description FROM entities
  UNION ALL SELECT 'measures', 2, CASE WHEN s_suppkey % 13 = 0 THEN '' WHEN s_suppkey % 7 = 0 THEN concat('9', CAST(s_suppkey AS STRING)) ELSE concat('msr_', CAST(s_suppkey AS STRING)) END,
    1000000000 + s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN '  ' END FROM supplier
"""


def _faulty(spark, sf_dir):
    adapters.entities(spark, sf_dir).createOrReplaceTempView("entities")
    return adapters.sql(spark, sf_dir, f"SELECT 'run' AS run_id, *, title AS name FROM ({FAULTY})")


@query(f"WITH {GRAPH} SELECT source_id, target_id, confidence FROM connections WHERE target_id NOT IN (SELECT id FROM entities)")
def dangling_refs(spark, sf_dir):
    return quality.dangling(adapters.entities(spark, sf_dir), adapters.connections(spark, sf_dir)).drop("run_id")


@query(f"""WITH {GRAPH}, f AS ({FAULTY}), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY bucket_ord, ord) AS nth FROM f)
SELECT *, round(1 - duplicates / distinct_ids, 6) AS unique_rate FROM (SELECT count(*) FILTER (id = '') AS missing, count(*) FILTER (id <> '' AND nth > 1) AS duplicates,
 count(*) FILTER (id <> '' AND NOT regexp_full_match(id, '[a-zA-Z][\\p{{L}}\\p{{N}}_]*')) AS malformed,
 count(*) FILTER (id <> '' AND NOT starts_with(id, CASE bucket WHEN 'action_fields' THEN 'af_' WHEN 'projects' THEN 'proj_' WHEN 'measures' THEN 'msr_' ELSE 'ind_' END)) AS wrong_prefix,
 count(*) FILTER (id <> '' AND nth = 1) AS distinct_ids FROM n)""")
def id_validity(spark, sf_dir):
    return quality.id_validity(_faulty(spark, sf_dir)).drop("run_id")


@query(f"""WITH {GRAPH}, f AS (SELECT *, title AS name FROM ({FAULTY})), e AS (
 SELECT bucket, 'title' AS field, title AS x FROM f UNION ALL SELECT bucket, 'name', name FROM f UNION ALL SELECT bucket, 'description', description FROM f),
r AS (SELECT bucket, field, round(avg(CASE WHEN trim(coalesce(x, '')) <> '' THEN 1 ELSE 0 END), 6) AS rate FROM e GROUP BY ALL)
SELECT bucket, field, rate FROM r WHERE rate > 0 OR field = 'title' OR (bucket = 'action_fields' AND field = 'name') OR (bucket = 'indicators' AND field = 'description')""")
def field_completeness(spark, sf_dir):
    return quality.field_completeness(_faulty(spark, sf_dir), ("title", "name", "description")).drop("run_id")


ODD = "odd AS (SELECT source_id, target_id FROM connections UNION ALL SELECT concat('ind_', s_suppkey), concat('ind_', s_suppkey + 1) FROM supplier UNION ALL SELECT concat('msr_', s_suppkey), concat('x', s_suppkey) FROM supplier WHERE s_suppkey % 5 = 0)"


def _odd(spark, sf_dir):
    adapters.connections(spark, sf_dir).createOrReplaceTempView("connections")
    return adapters.sql(spark, sf_dir, f"WITH {ODD} SELECT 'run' AS run_id, * FROM odd /* supplier */")


@query(f"""WITH {GRAPH}, {ODD} SELECT * FROM (SELECT source_id, target_id, {KIND('source_id')} AS source_type, {KIND('target_id')} AS target_type FROM odd)
WHERE source_type = target_type OR source_type = 'unknown' OR target_type = 'unknown'""")
def type_violations(spark, sf_dir):
    return quality.type_violations(_odd(spark, sf_dir)).drop("run_id")


@query(f"""WITH {GRAPH}, {ODD} SELECT source_type, target_type, count(*) AS n FROM (SELECT {KIND('source_id')} AS source_type, {KIND('target_id')} AS target_type FROM odd)
WHERE (source_type, target_type) NOT IN (('af','af'),('af','proj'),('proj','msr'),('af','msr'),('proj','ind'),('msr','ind'),('af','ind'),('msr','msr')) GROUP BY ALL""")
def strict_type_violations(spark, sf_dir):
    return quality.type_violations(_odd(spark, sf_dir), strict=True).groupBy("source_type", "target_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {GRAPH}, {TYPED} SELECT concat(s, '-', t) AS kind, count(*) AS n, round(avg(confidence), 6) AS mean, round(median(confidence), 6) AS median, min(confidence) AS least,
max(confidence) AS most, round(coalesce(stddev_samp(confidence), 0), 6) AS std, count(*) FILTER (confidence < 0.7) AS low, round(count(*) FILTER (confidence < 0.7) / count(*), 6) AS low_ratio FROM typed GROUP BY kind""")
def confidence_by_type(spark, sf_dir):
    return quality.confidence_by_type(adapters.connections(spark, sf_dir)).drop("run_id")


@query(f"WITH {GRAPH} SELECT count(*) FILTER (confidence < 0.7) AS low, count(*) AS total, round(count(*) FILTER (confidence < 0.7) / count(*), 6) AS ratio FROM connections")
def low_confidence(spark, sf_dir):
    return quality.low_confidence(adapters.connections(spark, sf_dir)).drop("run_id")


@query(f"""WITH {GRAPH}, per AS (SELECT source_id, count(*) AS n, avg(confidence) AS mean, count(*) FILTER (confidence < 0.7) / count(*) AS lr, coalesce(stddev_samp(confidence), 0) AS sd FROM connections GROUP BY source_id),
w AS (SELECT source_id, n, mean, concat_ws(',', CASE WHEN lr > 0.5 THEN 'low' END, CASE WHEN n > 2 AND sd > 0.2 THEN 'spread' END, CASE WHEN n > 10 THEN 'many' END) AS reasons FROM per)
SELECT source_id, n, round(mean, 6) AS mean, reasons FROM w WHERE reasons <> ''""")
def ambiguous_nodes(spark, sf_dir):
    return quality.ambiguous(adapters.connections(spark, sf_dir)).drop("run_id", "rank")


@query(f"""WITH {GRAPH} SELECT round(avg(confidence), 6) AS mean, round(max(confidence) - min(confidence), 6) AS span, round(avg(CASE WHEN confidence > 0.9 THEN 1 ELSE 0 END), 6) AS high,
round(avg(CASE WHEN confidence BETWEEN 0.7 AND 0.9 THEN 1 ELSE 0 END), 6) AS middle, round(avg(CASE WHEN confidence < 0.7 THEN 1 ELSE 0 END), 6) AS low FROM connections""")
def calibration(spark, sf_dir):
    return quality.calibration(adapters.connections(spark, sf_dir)).drop("run_id")


@query(f"""WITH {GRAPH}, h AS (SELECT bucket, CAST(least(floor(confidence * 10 + 1e-9), 9) AS BIGINT) AS tenth, count(*) AS n FROM connections GROUP BY ALL)
SELECT b.bucket, coalesce(tenth, -1) AS tenth, coalesce(n, 0) AS n FROM (VALUES ('action_fields'), ('projects'), ('measures'), ('indicators')) b(bucket) LEFT JOIN h USING (bucket)""")
def conf_distribution(spark, sf_dir):
    return quality.confidence_histogram(adapters.connections(spark, sf_dir))


PER = """per AS (SELECT e.bucket, e.id, count(s.entity_id) AS n_sources, count(*) FILTER (trim(s.quote) <> '') AS n_valid FROM entities e LEFT JOIN sources s ON s.entity_id = e.id
WHERE e.bucket IN ('measures', 'indicators') GROUP BY e.bucket, e.id)"""


def _per(spark, sf_dir):
    return quality.per_entity_sources(adapters.entities(spark, sf_dir), adapters.sources(spark, sf_dir))


@query(f"""WITH {GRAPH}, {PER} SELECT bucket, round(avg(CASE WHEN n_valid > 0 THEN 1 ELSE 0 END), 6) AS coverage FROM per GROUP BY bucket
UNION ALL SELECT 'overall', round(avg(CASE WHEN n_sources > 0 THEN 1 ELSE 0 END), 6) FROM per""")
def source_coverage(spark, sf_dir):
    return quality.source_coverage(_per(spark, sf_dir)).drop("run_id")


@query(f"WITH {GRAPH}, {PER} SELECT bucket, round(avg(n_valid), 6) AS density FROM per GROUP BY bucket")
def evidence_density(spark, sf_dir):
    return quality.evidence_density(_per(spark, sf_dir)).drop("run_id")


@query(f"WITH {GRAPH}, {PER} SELECT bucket, id FROM per WHERE n_sources = 0")
def missing_sources(spark, sf_dir):
    return quality.missing_sources(_per(spark, sf_dir)).drop("run_id")


@query(f"WITH {GRAPH} SELECT count(*) AS total, count(chunk_id) AS linked, count(DISTINCT chunk_id) AS chunks, round(count(chunk_id) / count(*), 6) AS ratio FROM sources")
def chunk_linkage(spark, sf_dir):
    return quality.chunk_linkage(adapters.sources(spark, sf_dir)).drop("run_id")


@query(f"""WITH {GRAPH}, s AS (SELECT *, page_number IN (SELECT CAST(n_nationkey AS BIGINT) FROM nation) AS ok FROM sources WHERE page_number <> 0)
SELECT count(*) AS refs, count(*) FILTER (NOT ok) AS invalid, count(DISTINCT page_number) AS pages, min(page_number) AS least, max(page_number) AS most,
(SELECT count(*) FROM nation) AS available, round(count(DISTINCT page_number) / (SELECT count(*) FROM nation), 6) AS coverage FROM s""")
def page_validity(spark, sf_dir):
    pages = adapters.sql(spark, sf_dir, "SELECT 'run' AS run_id, CAST(n_nationkey AS BIGINT) AS page_number FROM nation")
    return quality.page_validity(adapters.sources(spark, sf_dir), pages).drop("run_id")


#: Metrics of many runs: each supplier is a run, its line items give the figures.
METRICS = """
SELECT concat('run_', CAST(l_suppkey AS STRING)) AS run_id, CAST(count(CASE WHEN l_tax = 0.08 AND l_linenumber = 1 THEN 1 END) AS DOUBLE) AS dangling,
  avg(l_discount) AS duplicate_rate, 1 - avg(l_tax) * 2 AS completeness, CAST(count(CASE WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN 1 END) % 7 AS DOUBLE) AS violations,
  avg(CASE WHEN l_returnflag <> 'R' THEN 1e0 ELSE 0e0 END) * 1.3e0 AS af_coverage, avg(CASE WHEN l_returnflag = 'A' THEN 1e0 ELSE 0.6e0 END) AS project_coverage, avg(l_linenumber) / 5 AS mean_measures,
  avg(l_tax) * 5 AS low_ratio, CAST(count(*) % 11 AS DOUBLE) AS ambiguous, 1 - avg(l_discount) AS mean_confidence, avg(l_quantity) / 40 AS source_coverage,
  avg(l_quantity) / 30 AS quote_match, CAST(count(*) % 5 AS DOUBLE) AS invalid_quotes, CAST(count(*) % 17 AS DOUBLE) AS missing_sources, avg(l_discount) * 4 AS repetition,
  avg(l_tax) * 2 AS language_inconsistency, CAST(count(*) % 9 AS DOUBLE) AS issues, CAST(count(*) % 13 AS DOUBLE) AS outliers
FROM lineitem GROUP BY l_suppkey
"""
CAP = lambda x, cap: f"least({cap}, greatest(0, {x}))"
SCORES = f"""m AS ({METRICS}), s AS (SELECT *, 
 greatest(0, least(100, 100 - {CAP('5 * dangling', 40)} - {CAP('50 * duplicate_rate', 30)} - {CAP('40 * (0.9 - completeness)', 20)} - {CAP('2 * violations', 10)})) AS integrity,
 greatest(0, least(100, 100 - {CAP('60 * (0.9 - af_coverage)', 30)} - {CAP('50 * (0.85 - project_coverage)', 25)} - {CAP('20 * (1 - mean_measures)', 20)} + CASE WHEN af_coverage > 0.95 THEN 5 ELSE 0 END)) AS connectivity,
 greatest(0, least(100, 100 - {CAP('80 * (low_ratio - 0.15)', 40)} - {CAP('3 * ambiguous', 30)} - {CAP('40 * (0.8 - mean_confidence)', 20)})) AS confidence,
 greatest(0, least(100, 100 - {CAP('50 * (0.8 - source_coverage)', 40)} - {CAP('60 * (0.85 - quote_match)', 30)} - {CAP('2 * invalid_quotes', 20)} - {CAP('missing_sources', 10)})) AS sources,
 greatest(0, least(100, 100 - {CAP('60 * (repetition - 0.1)', 30)} - {CAP('50 * (language_inconsistency - 0.05)', 25)} - {CAP('2 * issues', 25)} - {CAP('1.5 * outliers', 20)})) AS content,
 2 * dangling + CASE WHEN af_coverage < 0.5 THEN 10 ELSE 0 END AS penalty, CASE WHEN af_coverage > 0.95 THEN 3 ELSE 0 END + CASE WHEN mean_confidence > 0.9 THEN 2 ELSE 0 END AS bonus FROM m),
c AS (SELECT *, greatest(0, least(100, 0.35 * integrity + 0.25 * content + 0.25 * connectivity + 0.1 * confidence + 0.05 * sources)) AS composite FROM s),
f AS (SELECT run_id, round(integrity, 6) AS integrity, round(connectivity, 6) AS connectivity, round(confidence, 6) AS confidence, round(sources, 6) AS sources, round(content, 6) AS content,
 round(composite, 6) AS composite, CAST(penalty AS DOUBLE) AS penalty, CAST(bonus AS DOUBLE) AS bonus, round(greatest(0, least(100, composite - penalty + bonus)), 6) AS score FROM c),
g AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM f)"""


def _scores(spark, sf_dir):
    m = adapters.sql(spark, sf_dir, METRICS)
    return quality.scores(m.select("run_id", *(F.col(c).cast("double").alias(c) for c in m.columns[1:])))


@query(f"WITH {SCORES} SELECT * FROM g")
def quality_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(f"WITH {SCORES} SELECT grade, count(*) AS n, (SELECT count(*) FROM g) AS runs, (SELECT round(avg(score), 6) FROM g) AS mean FROM g GROUP BY grade")
def batch_summary(spark, sf_dir):
    return quality.batch_summary(_scores(spark, sf_dir))


@query(f"""WITH {SCORES}, k AS (SELECT *, CAST(split_part(run_id, '_', 2) AS BIGINT) AS i FROM g), p AS (SELECT a.i // 2 AS key, b.score - a.score AS ch,
 concat_ws(',', CASE WHEN b.integrity > a.integrity THEN 'integrity' END, CASE WHEN b.connectivity > a.connectivity THEN 'connectivity' END, CASE WHEN b.confidence > a.confidence THEN 'confidence' END, CASE WHEN b.sources > a.sources THEN 'sources' END, CASE WHEN b.content > a.content THEN 'content' END) AS better,
 concat_ws(',', CASE WHEN b.integrity <= a.integrity THEN 'integrity' END, CASE WHEN b.connectivity <= a.connectivity THEN 'connectivity' END, CASE WHEN b.confidence <= a.confidence THEN 'confidence' END, CASE WHEN b.sources <= a.sources THEN 'sources' END, CASE WHEN b.content <= a.content THEN 'content' END) AS worse
 FROM k a JOIN k b ON b.i = a.i + 1 WHERE a.i % 2 = 0)
SELECT key, round(ch, 6) AS change, CASE WHEN ch > 5 THEN 'significant improvement' WHEN ch > 1 THEN 'slight improvement' WHEN ch < -5 THEN 'significant regression' WHEN ch < -1 THEN 'slight regression' ELSE 'stable' END AS trend, better, worse FROM p""")
def run_comparison(spark, sf_dir):
    """Runs with even numbers against the next ones."""
    s = _scores(spark, sf_dir).withColumn("i", F.split_part("run_id", F.lit("_"), F.lit(2)).cast("bigint"))
    key = F.expr("i div 2").alias("key")
    names = ("integrity", "connectivity", "confidence", "sources", "content", "score")
    return quality.compare(s.filter("i % 2 = 0").select(key, *names), s.filter("i % 2 = 1").select(key, *names))


@query(f"""WITH {SCORES} SELECT run_id, rule, value, severity FROM (
 SELECT run_id, 'dangling' AS rule, dangling AS value, 'critical' AS severity FROM m WHERE dangling > 0 UNION ALL SELECT run_id, 'repetition', repetition, 'critical' FROM m WHERE repetition > 0.5
 UNION ALL SELECT run_id, 'ambiguous', ambiguous, 'minor' FROM m WHERE ambiguous > 0 UNION ALL SELECT run_id, 'missing_sources', missing_sources, 'minor' FROM m WHERE missing_sources > 0)""")
def issue_triage(spark, sf_dir):
    return quality.severity(adapters.sql(spark, sf_dir, METRICS))


@query(f"""WITH {GRAPH} SELECT type, node, degree, CAST(row_number() OVER (PARTITION BY type ORDER BY degree DESC, node) AS INT) AS rank, count(*) OVER (PARTITION BY type) AS total FROM degrees QUALIFY rank <= 3""")
def top_entities(spark, sf_dir):
    """The three best connected entities of each type, with how many there are."""
    from pyspark.sql import Window

    # Written once: degrees, ends and totals read them several times.
    nodes = materialize(graph.build_nodes(adapters.entities(spark, sf_dir)), "nodes")
    edges = materialize(graph.build_edges(nodes, adapters.connections(spark, sf_dir)), "edges")
    d = graph.degrees(nodes, edges)
    w = Window.partitionBy("type").orderBy(F.desc("degree"), "node")
    ranked = d.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
    return ranked.join(graph.nodes_by_type(nodes).select("type", F.col("n").alias("total")), "type").select("type", "node", "degree", "rank", "total")
