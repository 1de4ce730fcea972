"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. Rows come in numbered batches. A batch is reduced to one
row per digest and sort-merge anti-joined with the index; what is new is appended with the row that stays, what is known
is appended as a count of further copies, so the index always knows each text's number of copies. A batch whose
number is in the index already is left alone, so one that is run again adds nothing. The number of buckets follows the rows
that are expected, and `compact` deals a grown index over more. Only DataFrame functions run here.

The query sends its table through an index in `batches` batches, the largest ids first, so that of
equal texts the row with the largest id is the one the index meets first.

Defined results: a null text is the empty text. Of equal texts the largest doc_id stays
(nulls lose to any id; a group of null ids keeps one of its rows). Of repeated rows with the
same id and text one stays. Texts that an earlier batch brought stay with that batch's
row: all rows of later batches are dropped. Empty input gives an empty result. Very long texts are hashed whole. Columns
beside doc_id and text never enter; `keep_first` returns them as they came, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import fresh, table
from strataweave.session import materialize, scratch_path

BUCKET_ROWS = 2_000_000  # digests that a bucket is to hold (about 60 bytes each)


def buckets_for(rows: int) -> int:
    return max(32, -(-rows // BUCKET_ROWS))


class DigestIndex:
    """Digest -> row that stays and number of copies, in buckets at `path` (a folder all executors see).

    The number of buckets is written beside the data when the index is made (32 unless `buckets` says otherwise) and read when it is
    opened again, by any session; opening it with another number is an error, as its files would be paired wrongly.
    """

    SCHEMA = "digest BINARY, keep_id BIGINT, copies BIGINT, batch INT"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, (path or scratch_path(spark, "digest-index")).rstrip("/")
        self.buckets = self._agree(buckets)
        self.table = "digest_index_" + "".join(c if c.isalnum() else "_" for c in self.path)[-80:].lower()
        # One file a bucket and append is sorted as it lies, so a compact index is merged without another sort.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({self.SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.data}'"
        )

    def _agree(self, buckets: int | None) -> int:
        """The index's own number of buckets; a new index gets one."""
        exists = lambda path: path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        there = self.spark._jvm.org.apache.hadoop.fs.Path
        # The note's name hides it from readers of the folder, which is the table; an index made before has two folders.
        self.data, note = self.path, f"{self.path}/_buckets"
        if exists(there(f"{self.path}/digests")):
            self.data, note = f"{self.path}/digests", f"{self.path}/buckets"
        if not exists(there(f"{note}/_SUCCESS")):
            status = there(self.data).getFileSystem(self.spark._jsc.hadoopConfiguration())
            if exists(there(self.data)) and any(f.getPath().getName().endswith(".parquet") for f in status.listStatus(there(self.data))):
                raise ValueError(f"{self.path} has digests and no number of buckets")
            number = buckets or 32
            self.spark.range(1).select(F.lit(number).alias("buckets")).write.mode("overwrite").parquet(note)
            return number
        own = self.spark.read.parquet(note).head()["buckets"]
        if buckets and buckets != own:
            raise ValueError(f"{self.path} has {own} buckets, not {buckets}")
        return own

    def rows(self) -> DataFrame:
        """What was appended: one row per digest and batch."""
        return self.spark.table(self.table)

    def read(self) -> DataFrame:
        """digest, keep_id (of the batch that brought it), copies, batch: one row per digest; no exchange, as the buckets are by digest."""
        least = F.min_by(F.struct("keep_id", "batch"), "batch").alias("first")
        return self.rows().groupBy("digest").agg(least, F.sum("copies").alias("copies")).select("digest", "first.keep_id", "copies", "first.batch")

    def next_batch(self) -> int:
        last = self.rows().agg(F.max("batch").alias("b")).first()["b"]
        return 0 if last is None else last + 1

    def missing(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks: a sort-merge anti-join."""
        return groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: int) -> None:
        """Add a batch of groups (digest, keep_id, copies): new ones whole, known ones as further copies."""
        if self.rows().filter(F.col("batch") == batch).take(1):
            return
        new = self.missing(groups).select("digest", "keep_id", "copies")
        more = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_semi").select("digest", F.lit(None).cast("bigint").alias("keep_id"), "copies")
        self._write(new.union(more).withColumn("batch", F.lit(batch)))

    def _write(self, rows: DataFrame) -> None:
        # The table's own bucket number: a task writes one bucket, as one sorted file.
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        rows.select("digest", "keep_id", "copies", "batch").repartitionById(self.buckets, bucket).write.insertInto(self.table)

    def compact(self) -> "DigestIndex":
        """The same index in a new folder, one row a digest, one sorted file a bucket, with buckets for its size."""
        whole = DigestIndex(self.spark, None, max(self.buckets, buckets_for(self.rows().count())))
        whole._write(self.read())
        return whole


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the whole text."""
    return docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))


def dedupe(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256; `index` takes the rows in.

    group_size is the number of copies that the index knows after these rows. `batches`: parts that go through the index one
    after the other, from the largest ids to the smallest and null.
    """
    index = index or DigestIndex(docs.sparkSession, buckets=buckets_for(docs.count()))
    first = index.next_batch()
    # Repeated rows become a count first, so a text with very many copies is many (digest, id) keys.
    ids = materialize(digests(docs).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("times")), "digests")
    part = F.lit(first)
    if batches > 1:
        cuts = ids.agg(F.percentile_approx("doc_id", F.lit([i / batches for i in range(batches - 1, 0, -1)])).alias("cuts")).first()["cuts"] or []
        for cut in sorted(set(cuts), reverse=True):  # ids above the highest cut are the first batch, nulls are in the last
            part = part + F.when(F.col("doc_id") > cut, 0).otherwise(1)
        batches = len(set(cuts)) + 1
    ids = ids.withColumn("part", part)
    for batch in range(first, first + batches):
        groups = ids.filter(F.col("part") == batch).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("copies"))
        index.append(materialize(groups, "digest-groups"), batch)
    known = index.read().select(F.col("digest").alias("g_digest"), "keep_id", F.col("copies").alias("group_size"), "batch")
    joined = ids.join(known.hint("merge"), F.col("digest") == F.col("g_digest"))
    each = joined.select("doc_id", "keep_id", "group_size", "batch", "part", "digest", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    return each.select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("batch") == F.col("part")) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("time") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of `docs` that `dedupe` keeps, with the columns they came with."""
    result = materialize(dedupe(docs, index), "dedupe")
    names = docs.columns
    key, id_, sha = (fresh(names, c) for c in ("key", "id", "sha"))
    kept = result.filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha))
    repeats = result.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = marked.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(sha)), "left_semi")
    if repeats.take(1):  # the same row more than once: one of them, whole
        rows = rows.groupBy("doc_id", key).agg(F.first(F.struct(*names)).alias("row")).select("row.*")
    return rows.select(*names)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedupe `documents` in three batches against an index that starts empty."""
    return dedupe(table(spark, sf_dir, "documents", "doc_id", "text"), batches=3)


ORACLE = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
         max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
  FROM documents)
"""
