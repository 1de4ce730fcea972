"""How far the sources of a language differ in their words, by DuckDB over shards of (lang, term).

Four steps, each partitioned by Spark:

1. Every task counts its rows' terms with DuckDB, block by block, and sends one row for each (lang, source, term) it has seen.
2. Shards of (lang, term), sorted so that a term's rows are neighbours, add these up in SQL and keep the terms of at least `least` documents.
   A term's rows in a shard are at most its sources times the tasks, whatever its frequency.
3. Sizes of groups and vocabularies are sums over the kept counts. They join the counts, which are dealt into shards again.
4. Each shard joins a term's sources with each other in SQL and gives partial sums of what their values are beyond those of terms that one
   of the two lacks, a histogram of counts by group, and its own leading terms by group. Spark adds up the sums, and terms that one or both
   lack come in by histogram: a count's value against a missing one is the same for all terms with that count. So a pair costs as many steps
   as both have terms in common, not as the language has terms.

The arithmetic is exact: 128-bit integers in DuckDB, decimals of 38 digits and integral division in Spark.

Defined results: null lang, source and text are ''. Each row counts as a document, repeated rows and repeated or null ids too. A group without
terms has its pairs and no terms. A language without kept terms has pairs of value 0. A source alone in its language has no pairs. Ties are in
the order of the items' UTF-8 bytes. An empty table gives no rows. Texts are counted whole. Columns beside lang, source and text never enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.llm.common import blocks, table
from strataweave.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes in plain texts: A-Z in lower case, all other ASCII but a-z a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
HELD = 1_000_000  # rows of counts that a task holds before it sends them on
SHARD_ROWS = 200_000  # rows of whole terms that one SQL statement sees, and one term's rows beyond that
GROUPS = 200_000  # groups' sizes that a join broadcasts (about 100 bytes each); more are joined by shuffle

#: Texts are plain: terms in lower case, and spaces. A document's language and source come in by number, after its terms are counted.
COUNT = """
SELECT lang, source, term, sum(c)::BIGINT AS n, count(*)::BIGINT AS docs
FROM (SELECT doc, term, count(*) AS c FROM (SELECT doc, unnest(string_split(text, ' ')) AS term FROM texts) WHERE term <> '' GROUP BY ALL)
JOIN (SELECT doc, lang, source FROM texts) USING (doc)
GROUP BY ALL"""

KEEP = """
SELECT lang, term, source, n, total, place = 1 AS lead
FROM (
  SELECT lang, term, source, n, sum(n) OVER w::BIGINT AS total, sum(docs) OVER w AS spread, row_number() OVER (PARTITION BY lang, term ORDER BY source) AS place
  FROM (SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs) AS docs FROM shard GROUP BY ALL)
  WINDOW w AS (PARTITION BY lang, term))
WHERE spread >= {least}"""

#: p of a count, z of a term that a group lacks, q of the language.
SHARES = """
CREATE OR REPLACE TEMP TABLE share AS
SELECT lang, term, source, n,
  (1 + {scale}::HUGEINT * (n + 1) // (size + kept))::BIGINT AS p, (1 + {scale} // (size + kept))::BIGINT AS z, (1 + {scale}::HUGEINT * (total + 1) // (lang_size + kept))::BIGINT AS q
FROM shard"""

F_SQL = "(({p} - {q}) * ({p} - {q}) // {q})"
_f = lambda p, q: F_SQL.format(p=p, q=q)

SUMS = f"""
SELECT 'both' AS kind, a.lang, a.source, b.source AS item, 0::BIGINT AS n,
  sum({_f("a.p", "b.p")}::HUGEINT - {_f("a.p", "b.z")} - {_f("a.z", "b.p")} + {_f("a.z", "b.z")})::DECIMAL(38,0) AS value
FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
UNION ALL
SELECT 'count', lang, source, '', n, count(*)::DECIMAL(38,0) FROM share GROUP BY ALL
UNION ALL
SELECT 'term', lang, source, term, 0, value::DECIMAL(38,0)
FROM (SELECT lang, source, term, {_f("p", "q")} AS value FROM share WHERE p > q)
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {{top}}"""

PARTIAL = "lang string, source string, term string, n bigint, docs bigint"
COUNTS = "lang string, term string, source string, n bigint, total bigint, lead boolean"
PARTS = "kind string, lang string, source string, item string, n bigint, value decimal(38,0)"


def _engine():
    """DuckDB in memory with one thread: a task has one core."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "preserve_insertion_order": False})


def _ask(con, statement: str) -> list[tuple]:
    """A statement's rows, fetched to the end: an open result blocks the connection."""
    return con.execute(statement).fetchall()


def _batches(found: pa.Table, names: str) -> Iterator[pa.RecordBatch]:
    strings = pa.schema([(f.name, pa.string() if pa.types.is_large_string(f.type) else f.type) for f in found.schema])
    yield from found.cast(strings).select([c.split()[0] for c in names.split(", ")]).to_batches(max_chunksize=50_000)


def plain(texts: pa.Array) -> pa.Array:
    """Texts of terms and spaces: in UTF-8 each byte of PLAIN's ASCII stands for itself, so a column is changed as a whole."""
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    data = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(data.translate(PLAIN)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: counts of a task's rows by (lang, source, term)."""
    con = _engine()
    _ask(con, "CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
    total = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL"
    rows = 0
    for block in blocks(batches):
        names = [pc.fill_null(block.column(c), "") for c in ("lang", "source")]
        con.register("texts", pa.table([*names, plain(block.column("text")), pa.array(range(block.num_rows), pa.int32())], ["lang", "source", "text", "doc"]))
        rows += _ask(con, f"INSERT INTO held {COUNT}")[0][0]
        if rows > HELD:
            rows = _ask(con, f"CREATE TABLE fewer AS {total}")[0][0]
            if rows > HELD // 2:
                yield from _batches(con.sql("SELECT * FROM fewer").to_arrow_table(), PARTIAL)
                rows = 0
                _ask(con, "DELETE FROM fewer")
            _ask(con, "DROP TABLE held")
            _ask(con, "ALTER TABLE fewer RENAME TO held")
    yield from _batches(con.sql(total).to_arrow_table(), PARTIAL)
    con.close()


def whole_terms(batches: Iterator[pa.RecordBatch], rows: int = SHARD_ROWS) -> Iterator[pa.Table]:
    """Tables of about `rows` rows of a stream sorted by (lang, term) that cut no term."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        lang, term = batch.column("lang"), batch.column("term")
        last = pc.and_(pc.equal(lang, lang[-1]), pc.equal(term, term[-1]))
        cut = pc.index(last, pa.scalar(True)).as_py()
        if cut == 0:  # one term so far; it may have begun in an earlier batch
            continue
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
        held, size = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def kept_counts(docs: DataFrame, least: int = 3) -> DataFrame:
    """lang, term, source, n, the language's total of the term, and whether the row leads its term, for terms of at least `least` documents."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        for shard in whole_terms(batches):
            con.register("shard", shard)
            yield from _batches(con.sql(KEEP.format(least=least)).to_arrow_table(), COUNTS)
        con.close()

    partial = docs.select("lang", "source", "text").mapInArrow(_count, PARTIAL)
    return partial.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(keep, COUNTS)


def group_sizes(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Of each occurring (lang, source): its size, its language's size and number of kept terms."""
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    sized = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.col("lead").cast("long")).alias("kept"))
    every = groups.distinct().join(sized, ["lang", "source"], "left")
    langs = every.groupBy("lang").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("lang_size"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"))
    return every.select("lang", "source", F.coalesce("size", F.lit(0)).alias("size")).join(langs, "lang")


def _value(p: str, q: str) -> F.Column:
    return F.expr(F_SQL.format(p=p, q=q).replace("//", "div")).cast("decimal(38,0)")


def _share(n: F.Column, size: str, scale: int) -> F.Column:
    """1 + floor(scale * (n + 1) / (size + kept)); the language has kept terms."""
    above = F.lit(scale).cast("decimal(19,0)") * (n.cast("decimal(19,0)") + 1)
    return F.call_function("div", above.cast("decimal(38,0)"), (F.col(size) + F.col("kept")).cast("decimal(38,0)")) + 1


def audit(docs: DataFrame, least: int = 3, top: int = 200, scale: int = 1_000_000_000) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank for the sources of each language of `docs` (lang, source, text)."""
    counts = materialize(kept_counts(docs, least), "counts")
    groups = materialize(group_sizes(docs, counts), "groups")
    sized = F.broadcast(groups) if groups.count() <= GROUPS else groups

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        for shard in whole_terms(batches):
            con.register("shard", shard)
            _ask(con, SHARES.format(scale=scale))
            yield from _batches(con.sql(SUMS.format(top=top)).to_arrow_table(), PARTS)
        con.close()

    dealt = counts.drop("lead").join(sized, ["lang", "source"]).repartition("lang", "term").sortWithinPartitions("lang", "term")
    parts = materialize(dealt.mapInArrow(sums, PARTS), "sums")

    # Pairs: terms of both, terms that the other lacks by their counts, and what a term that both lack is worth.
    zeros = groups.where("kept > 0").withColumn("z", _share(F.lit(0), "size", scale))
    other = zeros.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"))
    pairs = zeros.join(other, "lang").where("source <> item")
    counted = parts.where("kind = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").alias("terms")).join(zeros, ["lang", "source"])
    counted = counted.withColumn("p", _share(F.col("n"), "size", scale)).select("lang", "source", "p", "z", "terms").join(other, "lang").where("source <> item")
    times = lambda value: (value * F.col("terms").cast("decimal(18,0)")).cast("decimal(38,0)").alias("value")
    spread = (
        parts.where("kind = 'both'").select("lang", "source", "item", "value")
        .unionByName(counted.select("lang", "source", "item", times((_value("p", "other_z") - _value("z", "other_z")).cast("decimal(20,0)"))))
        .unionByName(counted.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), times((_value("other_z", "p") - _value("other_z", "z")).cast("decimal(20,0)"))))
        .unionByName(pairs.select("lang", "source", "item", (_value("z", "other_z").cast("decimal(20,0)") * F.col("kept").cast("decimal(18,0)")).cast("decimal(38,0)").alias("value")))
    )
    bare = groups.where("kept = 0")
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("decimal(38,0)").alias("value"))
    pair = spread.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(none)
    term = parts.where("kind = 'term'").select("lang", "source", "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = [F.lit(0).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank"]
    ranked = [
        df.withColumn("rank", place).where(F.col("rank") <= last if last else F.lit(True)).select("lang", "source", F.lit(name).alias("part"), *out[1:])
        for name, df, last in (("pair", pair, 0), ("term", term, top))
    ]
    return ranked[0].unionByName(ranked[1])


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence between the sources of each language of `documents`, and the terms that set a source apart."""
    return audit(table(spark, sf_dir, "documents", "lang", "source", "text"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '{TERM}')), '{UPPER}', '{LOWER}') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
langs AS (SELECT lang, sum(total) AS size, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM groups LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000 * (coalesce(c.n, 0) + 1) // (s.size + l.v))::BIGINT AS p, (1 + 1000000000 * (k.total + 1) // (l.size + l.v))::BIGINT AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM every
UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200
"""
