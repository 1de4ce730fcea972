"""Bounded chunks of page texts, with context headers and overlap.

pages: source_id, page_number, text. chunks: source_id, chunk_index, text, pages.
Packing is a fold over the lengths of a source's pages in order. Only lengths go through it, as a sorted stream that a task
reads once and holds one open chunk of; the texts meet their chunk numbers by row and are gathered per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions import text as T
from strataweave.session import materialize

# The lines of a chunk's header, the marks around an overlap, and the ends of sentences in the order they are tried.
RULE = "=" * 80
DOCUMENT, SPAN, SECTION = "DOKUMENT: ", "SEITEN: ", "ABSCHNITT: "
OVERLAP = ("\n\n[OVERLAP_START]\n", "\n[OVERLAP_END]")
ENDINGS = (". ", ".\n", "! ", "!\n", "? ", "?\n")


class _Packer:
    """The chunk numbers of one source's pages; `pages` holds those of the open chunk, `last` the length of the chunk before."""

    def __init__(self, source: str, most: int, least: int):
        self.source, self.most, self.least = source, most, least
        self.pages: list[int] = []
        self.size, self.number, self.last = 0, -1, 0

    def close(self) -> Iterator[tuple[int, int]]:
        """(row, chunk number) of the open chunk; a small one joins the one before where both fit."""
        if not self.pages:
            return
        if self.size < self.least and self.number >= 0 and self.last + self.size + 2 <= self.most:
            self.last += self.size + 2
        else:
            self.number, self.last = self.number + 1, self.size
        yield from ((row, self.number) for row in self.pages)
        self.pages, self.size = [], 0

    def add(self, row: int, size: int) -> Iterator[tuple[int, int]]:
        if self.pages and size > self.most:  # stands alone, unless nothing is open: then it opens a chunk
            yield from self.close()
            self.pages, self.size = [row], size
            yield from self.close()
        elif self.pages and self.size + size + 2 <= self.most:
            self.pages.append(row)
            self.size += size + 2
        else:
            yield from self.close()
            self.pages, self.size = [row], size


def pack_pages(pages: DataFrame, most: int = 8000, least: int = 1500) -> DataFrame:
    """Greedy packing of stripped pages, then small chunks join the one before where both fit."""
    rows = pages.select("source_id", "page_number", T.strip(F.col("text")).alias("text")).filter("text <> ''")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer: _Packer | None = None
        held: list[tuple[int, int]] = []
        for batch in batches:
            for source, row, size in zip(*(batch.column(c).to_pylist() for c in ("source_id", "row", "size")), strict=True):
                if packer is None or packer.source != source:
                    held += packer.close() if packer else ()
                    packer = _Packer(source, most, least)
                held += packer.add(row, size)
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], ["p_row", "chunk_index"])
                held = []
        held += packer.close() if packer else ()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], ["p_row", "chunk_index"])

    sizes = rows.select("source_id", "page_number", "row", F.length("text").cast("bigint").alias("size"))
    places = sizes.repartition("source_id").sortWithinPartitions("source_id", "page_number", "row").mapInArrow(run, "p_row bigint, chunk_index bigint")
    placed = rows.join(places, F.col("row") == F.col("p_row"))
    parts = placed.groupBy("source_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("page_number", "row", "text"))).alias("parts"))
    return parts.select(
        "source_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.array_join("parts.text", "\n\n").alias("text"), F.array_sort(F.array_distinct("parts.page_number")).alias("pages")
    )


def with_header(chunks: DataFrame, title: Column | str = "Dokument") -> DataFrame:
    """Chunks below a header with the document's title, the page range and, if one of the first five lines is one, a heading."""
    title = F.lit(title) if isinstance(title, str) else title
    first, last = F.array_min("pages").cast("string"), F.array_max("pages").cast("string")
    span = F.when(F.size("pages") > 1, F.concat(first, F.lit("-"), last)).otherwise(first)
    heading = F.get(F.filter(F.transform(F.slice(F.split("text", T.LINE_END), 1, 5), T.strip), lambda x: (x != "") & T.is_heading(x)), 0)
    section = F.when(heading.isNotNull(), F.concat(F.lit(SECTION), F.substring(heading, 1, 100)))
    head = F.concat_ws("\n", F.lit(RULE), F.concat(F.lit(DOCUMENT), title), F.concat(F.lit(SPAN), span), section, F.lit(RULE))
    return chunks.withColumn("text", F.concat(head, F.lit("\n"), F.col("text")))


def _last(text: Column, mark: str) -> Column:
    """Place (from 0) of the last `mark` in a text, negative if there is none."""
    return F.when(F.contains(text, F.lit(mark)), F.length(text) - F.length(F.substring_index(text, mark, -1)) - len(mark)).otherwise(-1)


def with_overlap(chunks: DataFrame, share: float = 0.15) -> DataFrame:
    """Each chunk followed by as much of the next as `share` of its own length, if the next is longer than that.

    The piece ends after the last sentence end of the first kind that has one past its half, else after the last paragraph past its 30 %.
    """
    size = F.floor(F.length("text") * share).cast("int")
    own = materialize(chunks.select("source_id", "chunk_index", "text", "pages", size.alias("size"), F.struct("source_id", "chunk_index").alias("key")), "chunks")
    most = own.agg(F.max("size")).head()[0] or 0
    # Only keys are put in order source by source. A chunk gets the beginning of the next by its key, never longer than the longest piece needs.
    ahead = Window.partitionBy("key.source_id").orderBy("key.chunk_index")
    after = own.select("key", F.lead("key").over(ahead).alias("next")).where("next is not null")
    begins = own.select(F.col("key").alias("next"), F.substring("text", 1, most + 1).alias("follow"))
    rows = own.join(after.join(begins, "next").select("key", "follow"), "key", "left")
    rows = rows.withColumn("piece", F.when((F.col("size") > 0) & (F.length("follow") > F.col("size")), F.substring("follow", F.lit(1), F.col("size"))))
    piece, size = F.col("piece"), F.col("size")
    cut = F.when(_last(piece, "\n\n") > size * 0.3, _last(piece, "\n\n") + 2).otherwise(size)
    for mark in reversed(ENDINGS):
        cut = F.when(_last(piece, mark) > size * 0.5, _last(piece, mark) + len(mark)).otherwise(cut)
    tail = T.strip(F.substring(piece, F.lit(1), cut.cast("int")))
    whole = F.concat(F.col("text"), F.lit(OVERLAP[0]), tail, F.lit(OVERLAP[1]))
    return rows.select("source_id", "chunk_index", F.when(F.coalesce(tail, F.lit("")) != "", whole).otherwise(F.col("text")).alias("text"), "pages")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    n = T.estimate_tokens(F.col("text"))
    return chunks.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(n).alias("tokens"), F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most")
    )


def first_chunks(chunks: DataFrame, most: int = 50) -> DataFrame:
    """At most `most` chunks of a source, 0 for all: the cap of the extraction service."""
    return chunks.filter(F.col("chunk_index") < most) if most else chunks
