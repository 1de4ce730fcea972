"""The test tables seen as a document graph.

Regions are action fields, nations projects, customers measures and orders indicators; foreign
keys are connections. Customers whose key ends in 0 are left out of the measures, so
references to them dangle. The SQL is common to Spark and DuckDB, and the oracles begin with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ENTITIES = """
  SELECT 'action_fields' AS bucket, 0 AS bucket_ord, concat('af_', CAST(r_regionkey AS STRING)) AS id, CAST(r_regionkey AS BIGINT) AS ord,
         r_name AS title, CAST(NULL AS STRING) AS description FROM region
  UNION ALL
  SELECT 'projects', 1, concat('proj_', CAST(n_nationkey AS STRING)), CAST(n_nationkey AS BIGINT), n_name, CAST(NULL AS STRING) FROM nation
  UNION ALL
  SELECT 'measures', 2, concat('msr_', CAST(c_custkey AS STRING)), c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL
  SELECT 'indicators', 3, concat('ind_', CAST(o_orderkey AS STRING)), o_orderkey, o_orderpriority, o_orderstatus FROM orders
"""

CONNECTIONS = """
  SELECT 'action_fields' AS bucket, concat('af_', CAST(n_regionkey AS STRING)) AS source_id, CAST(n_nationkey AS BIGINT) AS conn_ord,
         concat('proj_', CAST(n_nationkey AS STRING)) AS target_id, CAST(0.9 AS DOUBLE) AS confidence FROM nation
  UNION ALL
  SELECT 'projects', concat('proj_', CAST(c_nationkey AS STRING)), c_custkey, concat('msr_', CAST(c_custkey AS STRING)),
         CAST(50 + c_custkey % 50 AS DOUBLE) / 100 FROM customer
  UNION ALL
  SELECT 'measures', concat('msr_', CAST(o_custkey AS STRING)), o_orderkey, concat('ind_', CAST(o_orderkey AS STRING)),
         CAST(40 + o_orderkey % 60 AS DOUBLE) / 100 FROM orders WHERE o_custkey % 10 <> 0
  UNION ALL
  SELECT 'action_fields', concat('af_', CAST(n_regionkey AS STRING)), 1000 + c_custkey, concat('msr_', CAST(c_custkey AS STRING)),
         CAST(0.75 AS DOUBLE) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 = 0
"""

#: Sources of measures and indicators: a quote and a page for some of them.
SOURCES = """
  SELECT 'indicators' AS bucket, concat('ind_', CAST(l_orderkey AS STRING)) AS entity_id, CAST(l_linenumber AS BIGINT) AS src_ord,
         CAST(l_partkey % 40 AS BIGINT) AS page_number,
         CASE WHEN l_linenumber % 3 = 0 THEN '  ' ELSE l_returnflag END AS quote,
         CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS BIGINT) END AS chunk_id
  FROM lineitem WHERE l_orderkey % 4 <> 0
  UNION ALL
  SELECT 'measures', concat('msr_', CAST(c_custkey AS STRING)), CAST(0 AS BIGINT), CAST(c_nationkey AS BIGINT), c_mktsegment, CAST(NULL AS BIGINT)
  FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 10 <> 0
"""

#: Nodes and undirected simple edges as in `operators.graph`, for the oracles.
GRAPH = f"""
entities AS ({ENTITIES}), connections AS ({CONNECTIONS}), sources AS ({SOURCES}),
nodes AS (SELECT id AS node, replace(bucket, 's', 's') AS bucket, bucket_ord, ord,
                 CASE bucket WHEN 'action_fields' THEN 'action_field' WHEN 'projects' THEN 'project' WHEN 'measures' THEN 'measure' ELSE 'indicator' END AS type
          FROM entities),
pairs AS (SELECT least(source_id, target_id) AS u, greatest(source_id, target_id) AS v, max(confidence) AS confidence
          FROM connections WHERE source_id IN (SELECT node FROM nodes) AND target_id IN (SELECT node FROM nodes)
          GROUP BY 1, 2),
ends AS (SELECT u AS node, v AS other FROM pairs UNION ALL SELECT v, u FROM pairs),
degrees AS (SELECT node, type, bucket_ord, ord, count(other) AS degree FROM nodes LEFT JOIN ends USING (node) GROUP BY ALL)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores by their keys: a file of few row groups is read by few tasks, and work on its texts would stay with them."""
    return df.repartition(max(64, 4 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL with the tables of `sf_dir` as views; only tables that the text names are opened."""
    for name in TABLES:
        if name in text:
            read(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, f"SELECT 'run' AS run_id, * FROM ({ENTITIES})")


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, f"SELECT 'run' AS run_id, * FROM ({CONNECTIONS})")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, f"SELECT 'run' AS run_id, * FROM ({SOURCES})")
