"""Graph files: both JSON layouts to flat tables, with the ordinals that order-dependent rules need."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.operators.graph import BUCKETS

ENTITY = (
    "STRUCT<id: STRING, content: MAP<STRING, VARIANT>, connections: ARRAY<STRUCT<target_id: STRING, confidence_score: DOUBLE>>, "
    "sources: ARRAY<STRUCT<page_number: INT, quote: STRING, chunk_id: INT>>, action_field: STRING, "
    "projects: ARRAY<STRUCT<title: STRING, measures: ARRAY<STRING>, indicators: ARRAY<STRING>, sources: ARRAY<STRUCT<page_number: INT, quote: STRING>>>>>"
)
SCHEMA = ", ".join(f"{b} ARRAY<{ENTITY}>" for b in BUCKETS)


def layout(value: Column) -> Column:
    """EnrichedReviewJSON (flat), ExtractionResult (nested), empty or unknown, by the first action field; unreadable if it is no JSON object."""
    v = F.try_parse_json(value)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    fields = get("$.action_fields", "array<variant>")
    has = lambda path: get(path, "variant").isNotNull()
    return (
        F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "unreadable").when(fields.isNull(), "unknown").when(F.size(fields) == 0, "empty")
        .when(has("$.action_fields[0].projects"), "ExtractionResult").when(has("$.action_fields[0].id") & has("$.action_fields[0].connections"), "EnrichedReviewJSON").otherwise("unknown")
    )


def parse_graphs(files: DataFrame) -> DataFrame:
    """run_id, layout, size (bytes), g (typed struct, null if it is no JSON) from files (run_id, value)."""
    return files.select("run_id", layout(F.col("value")).alias("layout"), F.octet_length("value").alias("size"), F.from_json("value", SCHEMA).alias("g"))


def read_graphs(spark: SparkSession, path: str, pattern: str = "*.json", strict: bool = False) -> DataFrame:
    """Graph files below a path; a missing path has none. A file that is no JSON object keeps its row, with the layout `unreadable`, or is an error if `strict`."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    try:
        read = files.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run_id"), "value")
    except AnalysisException as error:
        if strict or error.getCondition() != "PATH_NOT_FOUND":
            raise
        read = spark.createDataFrame([], "run_id string, value string")
    graphs = parse_graphs(read)
    if strict and (bad := graphs.filter("layout = 'unreadable'").select("run_id").take(3)):
        raise ValueError(f"not JSON: {[r['run_id'] for r in bad]}")
    return graphs


def _buckets(graphs: DataFrame) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(i).alias("bucket_ord"), F.col(f"g.{b}").alias("items")) for i, b in enumerate(BUCKETS)))).alias("b")
    return graphs.filter("layout not in ('ExtractionResult', 'unreadable')").select("run_id", each).select("run_id", "b.bucket", "b.bucket_ord", F.posexplode("b.items").alias("ord", "e"))


def _strings(content: Column) -> Column:
    """The fields that are strings."""
    return F.transform_values(F.map_filter(content, lambda _, v: F.schema_of_variant(v) == "STRING"), lambda _, v: v.cast("string"))


def entities(graphs: DataFrame) -> DataFrame:
    """run_id, bucket, bucket_ord, id, ord, title (title or else name), name, description, full_description, content."""
    rows = _buckets(graphs).select("run_id", "bucket", "bucket_ord", F.col("e.id").alias("id"), F.col("ord").cast("bigint").alias("ord"), _strings(F.col("e.content")).alias("content"))
    get = lambda k: F.try_element_at("content", F.lit(k))
    return rows.select(
        "run_id", "bucket", "bucket_ord", "id", "ord", F.coalesce(F.nullif(get("title"), F.lit("")), get("name"), F.lit("")).alias("title"), get("title").alias("own_title"),
        get("name").alias("name"), get("description").alias("description"), get("full_description").alias("full_description"), "content",
    )


def connections(graphs: DataFrame) -> DataFrame:
    rows = _buckets(graphs).select("run_id", "bucket", F.col("e.id").alias("source_id"), F.posexplode("e.connections").alias("conn_ord", "c"))
    return rows.select("run_id", "bucket", "source_id", "conn_ord", F.col("c.target_id").alias("target_id"), F.col("c.confidence_score").alias("confidence"))


def sources(graphs: DataFrame) -> DataFrame:
    rows = _buckets(graphs).select("run_id", "bucket", F.col("e.id").alias("entity_id"), F.posexplode("e.sources").alias("src_ord", "s"))
    return rows.select("run_id", "bucket", "entity_id", "src_ord", F.col("s.page_number").cast("bigint").alias("page_number"), F.col("s.quote").alias("quote"), F.col("s.chunk_id").cast("bigint").alias("chunk_id"))


def trees(graphs: DataFrame) -> DataFrame:
    """run_id, action_fields of the nested layout; missing lists are empty."""
    none = F.array().cast("array<string>")
    fix = lambda p: F.struct(p["title"].alias("title"), F.coalesce(p["measures"], none).alias("measures"), F.coalesce(p["indicators"], none).alias("indicators"))
    field = lambda a: F.struct(a["action_field"].alias("action_field"), F.transform(a["projects"], fix).alias("projects"))
    return graphs.filter("layout = 'ExtractionResult'").select("run_id", F.transform("g.action_fields", field).alias("action_fields"))
