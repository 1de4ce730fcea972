"""Queries of the drift family: the graph against itself after a deterministic change."""

from __future__ import annotations

from strataweave.operators import drift
from strataweave.plans import adapters
from strataweave.plans.adapters import GRAPH
from strataweave.plans.registry import query

AFTER_E = "SELECT bucket, bucket_ord, id, ord, CASE WHEN ord % 9 = 4 THEN concat(title, '!') ELSE title END AS title, description FROM entities WHERE NOT (bucket = 'indicators' AND ord % 8 = 3) UNION ALL SELECT 'projects', 1, concat('proj_', CAST(900 + s_suppkey AS STRING)), 900 + s_suppkey, s_name, CAST(NULL AS STRING) FROM supplier"
AFTER_C = "SELECT bucket, source_id, conn_ord, target_id, CASE WHEN conn_ord % 6 = 1 THEN CAST(0.55 AS DOUBLE) ELSE confidence END AS confidence FROM connections WHERE conn_ord % 10 <> 7"
BOTH = f"{GRAPH}, ea AS ({AFTER_E}), ca AS ({AFTER_C})"
KIND = lambda c: f"CASE WHEN starts_with({c}, 'af_') THEN 'af' WHEN starts_with({c}, 'proj_') THEN 'proj' WHEN starts_with({c}, 'msr_') THEN 'msr' WHEN starts_with({c}, 'ind_') THEN 'ind' ELSE 'unknown' END"
K = f"concat({KIND('source_id')}, '-', {KIND('target_id')})"


def _states(spark, sf_dir):
    e, c = adapters.entities(spark, sf_dir), adapters.connections(spark, sf_dir)
    e.createOrReplaceTempView("entities")
    c.createOrReplaceTempView("connections")
    return (e, c), (adapters.sql(spark, sf_dir, AFTER_E), spark.sql(AFTER_C))


NODE = """st0 AS (SELECT e.bucket, e.id AS key, e.title, e.description, (SELECT list_sort(list(DISTINCT (target_id, confidence))) FROM connections c WHERE c.source_id = e.id) AS links FROM entities e),
st1 AS (SELECT e.bucket, e.id AS key, e.title, e.description, (SELECT list_sort(list(DISTINCT (target_id, confidence))) FROM ca c WHERE c.source_id = e.id) AS links FROM ea e),
nc AS (SELECT coalesce(a.bucket, b.bucket) AS bucket, count(*) FILTER (a.key IS NULL) AS added, count(*) FILTER (b.key IS NULL) AS removed,
 count(*) FILTER (a.key IS NOT NULL AND b.key IS NOT NULL AND NOT (a.title IS NOT DISTINCT FROM b.title AND a.description IS NOT DISTINCT FROM b.description AND a.links IS NOT DISTINCT FROM b.links)) AS modified,
 count(a.key) AS before, count(b.key) AS after FROM st0 a FULL JOIN st1 b ON a.bucket = b.bucket AND a.key = b.key GROUP BY 1), nr AS (SELECT *, round((added + removed + modified) / greatest(before, 1), 6) AS rate FROM nc)"""
EDGE = f"""e0 AS (SELECT DISTINCT {K} AS kind, source_id, target_id, confidence FROM connections), e1 AS (SELECT DISTINCT {K} AS kind, source_id, target_id, confidence FROM ca),
ec AS (SELECT kind, count(*) FILTER (w = 'a') AS added, count(*) FILTER (w = 'r') AS removed, count(*) FILTER (w = 'k') AS kept FROM (SELECT kind, 'a' AS w FROM (FROM e1 EXCEPT FROM e0) UNION ALL SELECT kind, 'r' FROM (FROM e0 EXCEPT FROM e1) UNION ALL SELECT kind, 'k' FROM (FROM e0 INTERSECT FROM e1)) GROUP BY kind),
er AS (SELECT *, round((added + removed) / greatest(removed + kept, 1), 6) AS rate FROM ec)"""
COV = """cov AS (SELECT bucket, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS delta FROM (SELECT bucket, avg(CASE WHEN id IN (SELECT source_id FROM connections) THEN 1 ELSE 0 END) AS b FROM entities GROUP BY bucket)
 JOIN (SELECT bucket, avg(CASE WHEN id IN (SELECT source_id FROM ca) THEN 1 ELSE 0 END) AS a FROM ea GROUP BY bucket) USING (bucket))"""
CONF = f"""cd AS (SELECT kind, round(coalesce(b.m, 0), 6) AS mean_before, round(coalesce(a.m, 0), 6) AS mean_after, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, round(coalesce(a.m, 0) - coalesce(b.m, 0), 6) AS delta
 FROM (SELECT {K} AS kind, avg(confidence) AS m, count(*) AS n FROM connections GROUP BY 1) b FULL JOIN (SELECT {K} AS kind, avg(confidence) AS m, count(*) AS n FROM ca GROUP BY 1) a USING (kind))"""
SIM = f"""sg AS (SELECT 0 AS w, concat('n', bucket, count(*) // 10) AS x FROM entities GROUP BY bucket UNION ALL SELECT 0, concat('e', {K}, count(*) // 5) FROM connections GROUP BY {K} UNION ALL SELECT 1, concat('n', bucket, count(*) // 10) FROM ea GROUP BY bucket UNION ALL SELECT 1, concat('e', {K}, count(*) // 5) FROM ca GROUP BY {K}),
sim AS (SELECT round(count(*) FILTER (n = 2) / count(*), 6) AS similarity FROM (SELECT x, count(DISTINCT w) AS n FROM sg GROUP BY x))"""


@query(f"WITH {BOTH}, {NODE} SELECT * FROM nr")
def node_churn(spark, sf_dir):
    return drift.node_churn(*_states(spark, sf_dir))


@query(f"WITH {BOTH}, {EDGE} SELECT * FROM er")
def edge_churn(spark, sf_dir):
    (_, a), (_, b) = _states(spark, sf_dir)
    return drift.edge_churn(a, b)


@query(f"WITH {BOTH}, {COV} SELECT * FROM cov")
def coverage_delta(spark, sf_dir):
    return drift.coverage_delta(*_states(spark, sf_dir))


@query(f"WITH {BOTH}, {CONF} SELECT * FROM cd")
def confidence_drift(spark, sf_dir):
    (_, a), (_, b) = _states(spark, sf_dir)
    return drift.confidence_drift(a, b)


@query(f"WITH {BOTH}, {SIM} SELECT * FROM sim")
def structural_similarity(spark, sf_dir):
    return drift.structural_similarity(*_states(spark, sf_dir))


@query(f"""WITH {BOTH}, {NODE}, {EDGE}, {COV}, {CONF}, {SIM}, v AS (SELECT (SELECT avg(rate) FROM nr) AS n, (SELECT avg(rate) FROM er) AS e, (SELECT max(abs(delta)) FROM cov) AS c, (SELECT max(abs(delta)) FROM cd) AS d, (SELECT similarity FROM sim) AS s, (SELECT bucket FROM nr ORDER BY rate DESC, bucket DESC LIMIT 1) AS volatile),
s AS (SELECT *, greatest(0, least(100, 100 - least(40, 50 * n) - least(30, 40 * e) - least(15, 30 * c) - least(10, 20 * d) + least(5, 25 * (s - 0.8)))) AS score FROM v)
SELECT round(0.7 * n + 0.3 * e, 6) AS churn, round(score, 6) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade, volatile,
concat_ws('; ', CASE WHEN n > 0.3 THEN 'nodes change much' END, CASE WHEN e > 0.3 THEN 'edges change much' END, CASE WHEN c > 0.1 THEN 'coverage moves' END, CASE WHEN d > 0.1 THEN 'confidence drifts' END) AS advice FROM s""")
def stability_score(spark, sf_dir):
    before, after = _states(spark, sf_dir)
    return drift.stability(
        drift.node_churn(before, after), drift.edge_churn(before[1], after[1]), drift.coverage_delta(before, after), drift.confidence_drift(before[1], after[1]), drift.structural_similarity(before, after)
    )
