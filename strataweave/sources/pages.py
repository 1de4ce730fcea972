"""Page-level text: reading files with page markers, tables as markdown, pluggable parsers, and loading checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The two page markers, as written and as the analyzer reads them, and suffixes that names lose.
MARKERS = {"bracket": r"\[Page (\d+)\]", "banner": r"===\s*Page\s*(\d+)\s*==="}
SUFFIXES = ("_operations_result", "_enhanced_structure", "_intermediate_extraction", "_pages", ".pdf", ".txt", ".json")
#: A page is text if it has more characters than this, else it goes to recognition.
TEXT_PAGE = 50


def split_pages(files: DataFrame, marker: str = "either") -> DataFrame:
    """source_id, page_number, text from whole files (source_id, value).

    The last page counts; blank pages go; a repeated number keeps its last text.
    """
    mark = "|".join(MARKERS.values()) if marker == "either" else MARKERS[marker]
    heads = F.regexp_extract_all("value", F.lit(f"(?m)^(?:{mark})[ ]*$"), F.lit(0))
    bodies = F.split("value", f"(?m)^(?:{mark})[ ]*$", -1)
    rows = files.select("source_id", heads.alias("heads"), bodies.alias("bodies")).filter("size(heads) > 0")
    each = rows.select("source_id", F.posexplode(F.arrays_zip("heads", F.slice("bodies", F.lit(2), F.size("heads")))).alias("at", "x"))
    each = each.select("source_id", "at", "x.*").toDF("source_id", "at", "head", "body")
    number = F.regexp_extract("head", r"(\d+)", 1).cast("int")
    pages = each.select("source_id", "at", number.alias("page_number"), F.regexp_replace("body", r"^\s+|\s+\z", "").alias("text")).filter("text <> ''")
    return pages.groupBy("source_id", "page_number").agg(F.max_by("text", "at").alias("text"))


def source_key(name: Column) -> Column:
    """A file's name without folders and known suffixes: results and their page files have one key."""
    suffixes = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), f"(?:{suffixes})+$", "")


def read_pages(spark: SparkSession, path: str, marker: str = "either") -> DataFrame:
    """Pages of all text files below a path or pattern. A missing path is an error; no pages at all is one, too."""
    files = spark.read.text(path, wholetext=True).select(source_key(F.col("_metadata.file_path")).alias("source_id"), "value")
    pages = split_pages(files, marker)
    if not pages.take(1):
        raise ValueError(f"no pages in {path}")
    return pages


def beside(spark: SparkSession, path: str) -> DataFrame:
    """folder, source_id, page_number, text of the page files (`*_pages.txt`) below a path of results; none is no error."""
    try:
        files = spark.read.option("pathGlobFilter", "*_pages.txt").option("recursiveFileLookup", "true").text(path, wholetext=True)
        files = files.select(F.col("_metadata.file_path").alias("source_id"), "value")
    except AnalysisException:
        files = spark.createDataFrame([], "source_id string, value string")
    found = split_pages(files)
    return found.select(folder(F.col("source_id")).alias("folder"), source_key(F.col("source_id")).alias("source_id"), "page_number", "text")


def folder(name: Column) -> Column:
    return F.regexp_replace(name, "[^/]*$", "")


def page_stats(pages: DataFrame) -> DataFrame:
    """Pages and estimated tokens per source."""
    n = F.floor(F.length("text") / 3.5).cast("bigint")
    return pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("pages"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"))


def parse_documents(spark: SparkSession, path: str, parser: Callable[[bytes], list[tuple[int, str]]], pattern: str = "*.pdf", recogniser: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """Pages of binary documents by a parser that the caller brings: bytes to (page_number, text).

    Pages of at most TEXT_PAGE characters go to the recogniser, if there is one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(n, t if len(t) > TEXT_PAGE or recogniser is None else recogniser(content, n)) for n, t in parser(content)]
                yield pd.DataFrame({"source_id": name, "page_number": [n for n, _ in rows], "text": [t for _, t in rows]})

    pages = files.mapInPandas(run, "source_id string, page_number int, text string")
    return pages.withColumn("source_id", source_key(F.col("source_id")))


def table_markdown(rows: Column, names: Column | None = None) -> Column:
    """A table (array of arrays of strings) as markdown.

    The header is the given names, unless all begin with 'Col'; else the first row, if its first three
    filled cells are no numbers; else there is none. Short rows are padded, long ones cut.
    """
    filled = F.slice(F.filter(F.get(rows, 0), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), 1, 3)
    is_text = (F.size(filled) > 0) & ~F.exists(filled, lambda x: F.regexp_replace(x, "[.,%\\s]", "").rlike(r"^-?\d+$"))
    none = F.array().cast("array<string>")
    given = F.lit(False) if names is None else F.coalesce(~F.forall(names, lambda x: x.startswith("Col")) & (F.size(names) > 0), F.lit(False))
    header = F.when(given, names if names is not None else none).when(is_text, F.get(rows, 0)).otherwise(none)
    body = F.when(~given & is_text, F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    width = F.size(header)
    fit = lambda r: F.when(width > 0, F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda i: F.get(r, i))).otherwise(r)
    cell = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\n|]", " "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    head = F.when(width > 0, F.array(line(header), rule)).otherwise(none)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(head, F.transform(body, lambda r: line(fit(r)))), "\n")).otherwise("")
