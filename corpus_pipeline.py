"""The corpus pipeline: quality, exact dedup, near dedup, decontamination, packing.

Each stage takes the rows that its predecessor kept, and all but the last return the columns they
came with. Stage results are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import decontaminate, exact_dedup, jaccard, packing, quality
from strataweave.llm.common import fresh, table
from strataweave.session import materialize


BROADCAST_ROWS = 200_000  # names of texts that a join broadcasts


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learnt from `labels`, accepts; null and empty texts are scored as empty ones, repeated rows alike, an empty table stays empty. All columns stay."""
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that with the largest doc_id; null texts count as empty, nulls lose to any id. All columns stay, whatever their names."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that with the least doc_id. Rows without words, null texts among them, stay. All columns stay, whatever their names."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of `benchmark`.

    Texts are named by their SHA-256, so null and repeated ids are handled too; null texts stay. Ties, very long texts and other
    columns are as the operator has them; an empty table stays empty.
    """
    key, bad = fresh(docs.columns, "key"), fresh(docs.columns, "bad")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    named = docs.select(sha.alias("doc_id"), "text")
    found = decontaminate.contaminated(named, table(spark, sf_dir, "benchmark", "item_id", "text"))
    names = materialize(found.select(F.col("doc_id").alias(bad)).distinct(), "contaminated")
    if names.count() <= BROADCAST_ROWS:  # about 100 bytes each; more are joined by shuffle
        names = F.broadcast(names)
    return docs.withColumn(key, sha).join(names, F.col(key) == F.col(bad), "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining rows as sequences of 4096 ids; a null or empty text is the end id, repeated rows are packed one by one, an empty table gives no rows."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Tokenising and the classifier are not expressible in SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
