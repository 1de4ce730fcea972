"""Content rules: repetition, lengths, language, normalisation, outliers; headers and footers of pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.config import Config
from strataweave.functions import text as T
from strataweave.operators.graph import BUCKETS

FIELDS = ("title", "name", "description", "full_description")


def texts(entities: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """run_id, bucket, id, field, text: one row per field with text."""
    each = F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f) for f in fields)))).alias("field", "text")
    return entities.select("run_id", "bucket", "id", each).filter(T.strip(F.col("text")) != "")


def all_texts(entities: DataFrame) -> DataFrame:
    """run_id, bucket, id, field, text: one row per field of an entity's content that holds a string of some length."""
    each = entities.select("run_id", "bucket", "id", F.explode("content").alias("field", "text"))
    return each.filter(F.coalesce("text", F.lit("")) != "")


def entity_texts(entities: DataFrame) -> DataFrame:
    """run_id, text: title, name and description of each entity as one text, in lower case; missing ones are empty."""
    parts = (F.lower(F.coalesce(F.try_element_at("content", F.lit(f)), F.lit(""))) for f in FIELDS[:3])
    return entities.select("run_id", F.concat_ws(" ", *parts).alias("text"))


def detection_texts(entities: DataFrame) -> DataFrame:
    """run_id, text: the four text fields of each entity that have text, as one, for a language detector."""
    parts = F.filter(F.array(*(F.try_element_at("content", F.lit(f)) for f in FIELDS)), lambda x: T.strip(x) != "")
    return entities.select("run_id", F.array_join(parts, " ").alias("text"))


def exact_repetition(rows: DataFrame) -> DataFrame:
    """run_id, digest (MD5 of the compared form), n for compared forms that occur more than once; texts are grouped by their digests."""
    forms = rows.select("run_id", T.compare_form(F.col("text")).alias("norm"))
    # Lengths are compared after the count: a filter on forms would move below a shuffle of the texts, into the few tasks that read them.
    sized = forms.select("run_id", F.md5("norm").alias("digest"), F.length("norm").alias("size"))
    return sized.groupBy("run_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).filter("n > 1 and size > 10").drop("size")


def near_pairs(forms: DataFrame, above: float = 0.9) -> DataFrame:
    """Pairs of different texts (run_id, a, b) with a word Jaccard similarity above the limit; forms: run_id, norm.

    Words are ordered rare first, and only prefixes meet: sets of sizes n and m that pass share
    one of their first n - ceil(above n) + 1 words, so no pair is lost and no cross join is made.
    """
    # Grouped by the text itself, copies fall away where they are read; the first text of a digest would have every copy sorted there.
    sets = forms.filter("norm <> ''").select("run_id", "norm").distinct().select("run_id", F.md5("norm").alias("id"), "norm", F.array_distinct(F.split("norm", " ")).alias("words"))
    # Texts are named by digests while their words meet, and come back for the pairs that are left.
    each = sets.select("run_id", "id", F.size("words").alias("n"), F.explode("words").alias("word"))
    common = each.groupBy("run_id", "word").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(common, ["run_id", "word"])
    place = F.row_number().over(Window.partitionBy("run_id", "id").orderBy("df", "word"))
    prefix = ranked.withColumn("i", place).filter(F.col("i") <= F.col("n") - F.ceil(F.col("n") * above) + 1).select("run_id", "id", "n", "word")
    left, right = prefix.alias("l"), prefix.alias("r")
    fits = (F.col("l.id") < F.col("r.id")) & (F.least("l.n", "r.n") >= above * F.greatest("l.n", "r.n"))
    pairs = left.join(right, (F.col("l.run_id") == F.col("r.run_id")) & (F.col("l.word") == F.col("r.word")) & fits)
    found = pairs.select("l.run_id", F.col("l.id").alias("x"), F.col("r.id").alias("y")).distinct()
    side = lambda c: sets.select("run_id", F.col("id").alias(c), F.col("norm").alias(f"norm_{c}"), F.col("words").alias(f"words_{c}"))
    both = found.join(side("x"), ["run_id", "x"]).join(side("y"), ["run_id", "y"])
    similarity = F.size(F.array_intersect("words_x", "words_y")) / F.size(F.array_union("words_x", "words_y"))
    return both.select("run_id", F.least("norm_x", "norm_y").alias("a"), F.greatest("norm_x", "norm_y").alias("b"), similarity.alias("similarity")).filter(F.col("similarity") > above)


def repetition_rate(forms: DataFrame, above: float = 0.9) -> DataFrame:
    """Share of distinct texts that are repeated or nearly so. Texts are grouped and joined by their digests."""
    norm = forms.filter(F.length("norm") > 10)
    counts = norm.groupBy("run_id", F.md5("norm").alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    near = near_pairs(norm.select("run_id", "norm"), above)
    ends = near.select("run_id", F.md5("a").alias("digest")).union(near.select("run_id", F.md5("b"))).distinct().withColumn("near", F.lit(True))
    both = counts.join(ends, ["run_id", "digest"], "left")
    dup = (F.col("n") > 1) | F.coalesce("near", F.lit(False))
    return both.groupBy("run_id").agg(F.count_if(dup).alias("duplicated"), F.count(F.lit(1)).alias("distinct_texts"), F.round(F.avg(dup.cast("int")), 6).alias("rate"))


def length_distribution(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Lengths by bucket and field, all sixteen cells; population deviation."""
    spark = rows.sparkSession
    grid = F.broadcast(spark.createDataFrame([(b, f) for b in BUCKETS for f in fields], "bucket string, field string"))
    r = lambda c: F.round(c, 6)
    size = F.length("text")
    found = rows.groupBy("bucket", "field").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(size)).alias("mean"), r(F.median(size)).alias("median"), F.min(size).alias("least"), F.max(size).alias("most"), r(F.stddev_pop(size)).alias("std")
    )
    return grid.join(found, ["bucket", "field"], "left").fillna(0)


def detected_languages(rows: DataFrame, detect, least: int = 20) -> DataFrame:
    """Primary language, its distribution and the share of other ones, by a detector that the caller brings: a column function from text to a language or null.

    Texts of at most `least` characters are not asked about. rows: run_id, text. Of languages as frequent the first by name is primary.
    """
    found = rows.filter(F.length("text") > least).select("run_id", detect(F.col("text")).alias("lang")).filter("lang is not null")
    per = found.groupBy("run_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("run_id").agg(F.sum("n").alias("texts"), F.max("n").alias("most"), F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("primary_language"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("counts"))
    share = F.transform_values("counts", lambda _, n: F.round(n / F.col("texts"), 6))
    return out.select("run_id", "texts", "primary_language", share.alias("distribution"), F.round(1 - F.col("most") / F.col("texts"), 6).alias("inconsistency"))


def language_consistency(rows: DataFrame, detect=None) -> DataFrame:
    """Primary language of texts of more than 10 characters, and the share that is not it; rows: run_id, text. `detect`: see `detected_languages`."""
    if detect is not None:
        return detected_languages(rows, detect)
    guess = rows.filter(F.length("text") > 10).withColumn("lang", T.guess_language(F.col("text")))
    n, de, en = F.count(F.lit(1)), F.count_if(F.col("lang") == "de"), F.count_if(F.col("lang") == "en")
    primary = F.when(F.col("de") > F.col("en"), "de").when(F.col("en") > 0, "en").otherwise("unknown")
    out = guess.groupBy("run_id").agg(n.alias("texts"), de.alias("de"), en.alias("en"))
    return out.withColumn("primary_language", primary).withColumn("inconsistency", F.round(1 - F.greatest("de", "en") / F.col("texts"), 6))


def normalization_issues(rows: DataFrame) -> DataFrame:
    """run_id, id, field, issue."""
    x = F.col("text")
    long_lines = F.size(F.filter(F.split(x, "\n"), lambda line: F.length(line) > 200))
    found = F.array_compact(F.array(
        F.when(x.rlike(rf"[{T.SPACE}]{{2,}}"), "consecutive spaces"),
        F.when(x != T.strip(x), "outer white space"),
        F.when(x.rlike(rf"[^{T.WORD}{T.SPACE}\-.,;:!?()\[\]{{}}\"'/]"), "unusual characters"),
        F.when(F.col("field").isin("title", "name") & (F.lower(x) == x), "title in lower case"),
    ))
    return rows.select("run_id", "id", "field", F.explode(F.concat(found, F.array_repeat(F.lit("long line"), long_lines))).alias("issue"))


def outliers(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """run_id, id, field, rule for texts too short, too long, with placeholders or repeated characters."""
    x, n = F.col("text"), F.length("text")
    short, described = F.col("field").isin("title", "name"), F.col("field").isin("description", "full_description")
    found = F.array_compact(F.array(
        F.when((short & (n < 5)) | (described & (n < config.min_description)), "too short"),
        F.when((short & (n > 200)) | (described & (n > config.max_description)), "too long"),
        F.when(x.rlike(r"(?iU)\b(test|TODO|FIXME|placeholder)\b"), "placeholder"),
        F.when(x.rlike(r"(.)\1{5,}"), "repeated characters"),
    ))
    return rows.select("run_id", "id", "field", F.explode(found).alias("rule"))


def missing_required(entities: DataFrame) -> DataFrame:
    """Measures and indicators without a title or a description."""
    blank = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    gaps = F.array_compact(F.array(F.when(blank("title"), "title"), F.when(blank("description"), "description")))
    return entities.filter(F.col("bucket").isin("measures", "indicators")).select("run_id", "bucket", "id", F.explode(gaps).alias("field"))


# ---- pages ---------------------------------------------------------------------------------


def headers_footers(pages: DataFrame, share: float = 0.3, floor: int = 0) -> DataFrame:
    """source_id, place (header, footer), pattern, n: lines that recur among the first or last three of the pages.

    Sources of fewer than 3 pages have none. The threshold is int(pages * share), as published; `floor` raises it.
    """
    size = pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("pages")).filter("pages >= 3")
    # A page is split once; of its lines only the first and last three are compared.
    split = pages.select("source_id", T.strip(F.col("text")).alias("bare")).filter("bare <> ''").select("source_id", F.split("bare", r"\R").alias("ls"))
    n = F.size("ls")
    ends = F.concat(
        F.transform(F.slice("ls", 1, 3), lambda x: F.struct(F.lit("header").alias("place"), x.alias("line"))),
        F.transform(F.slice("ls", F.greatest(n - 2, F.lit(1)), F.lit(3)), lambda x: F.struct(F.lit("footer").alias("place"), x.alias("line"))),
    )
    lines = split.select("source_id", F.explode(ends).alias("e")).select("source_id", "e.place", T.page_line(F.col("e.line")).alias("pattern")).filter(F.length("pattern") > 10)
    found = lines.groupBy("source_id", "place", "pattern").agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.floor(F.col("pages") * share), F.lit(floor))
    return found.join(size, "source_id").filter(F.col("n") >= least).select("source_id", "place", "pattern", "n")


def _held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each page which of its lines hold a pattern of its source. A source's patterns come before its pages; one automaton finds all of them in one reading of a line."""
    import ahocorasick

    source, known, every = None, None, False
    for frame in frames:
        out = []
        for own, pattern, page, text, lines in frame[["source_id", "pattern", "page_number", "text", "lines"]].itertuples(index=False):
            if own != source:
                source, known, every = own, ahocorasick.Automaton(), False
            if pattern is not None:
                every = every or not pattern  # the empty one is in every line
                if pattern:
                    known.add_word(pattern, True)
                continue
            if known.kind == ahocorasick.TRIE:
                known.make_automaton()
            ready = known.kind == ahocorasick.AHOCORASICK
            out.append((own, page, text, [every or ready and next(known.iter(x), None) is not None for x in lines]))
        yield pd.DataFrame(out, columns=["source_id", "page_number", "text", "held"])


PAGES_A_TASK = 5000


def held_lines(pages: DataFrame, patterns: DataFrame, cell: int = PAGES_A_TASK) -> DataFrame:
    """Pages with `held`: for each line whether it holds a pattern of its source.

    A source's pages are dealt over as many parts as `cell` asks for, and its patterns go to each part, so a long source is not one task. Time is
    linear in the pages and, for each part, in the patterns.
    """
    size = pages.groupBy("source_id").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("parts"))
    mine = size.withColumnRenamed("source_id", "size_of")
    rows = pages.join(mine, F.col("source_id").eqNullSafe(F.col("size_of"))).select(
        "source_id", F.pmod(F.xxhash64("page_number", "text"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("pattern"), "page_number", "text",
        F.transform(F.split("text", r"\R"), T.page_line).alias("lines"),
    )
    page = pages.schema["page_number"].dataType
    known = patterns.select("source_id", "pattern").where("pattern is not null").distinct().join(size, "source_id").select(
        "source_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "pattern", F.lit(None).cast(page).alias("page_number"), F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("lines"),
    )
    keys = ["source_id", "part"]
    # Patterns come first in their part, and the next part begins anew.
    dealt = rows.unionByName(known).withColumn("own", F.concat_ws("\x01", F.coalesce("source_id", F.lit("\x02")), "part")).repartition(*keys).sortWithinPartitions(*keys, "kind")
    found = dealt.select(F.col("own").alias("source_id"), "pattern", F.struct("source_id", "page_number").alias("page_number"), "text", "lines")
    flat = found.select("source_id", "pattern", F.to_json("page_number").alias("page_number"), "text", "lines").mapInPandas(_held, "source_id string, page_number string, text string, held array<boolean>")
    at = F.from_json("page_number", f"source_id string, page_number {page.simpleString()}")
    return flat.select(at.getField("source_id").alias("source_id"), at.getField("page_number").alias("page_number"), "text", "held")


def without_noise(pages: DataFrame, patterns: DataFrame, least: int = 100) -> DataFrame:
    """Pages without the lines that hold a header or footer or are bare page numbers; a page that would keep less than `least` characters stays as it is. A null text stays null."""
    rows = held_lines(pages.where("text is not null"), patterns)
    number = lambda line: T.strip(line).rlike(r"^(Seite|Page|S\.)?\s*\d{1,4}(\s*(von|of|/)\s*\d{1,4})?$")
    kept = F.filter(F.split("text", r"\R"), lambda line, i: (T.strip(line) == "") | ~(F.get("held", i) | number(line)))
    bare = F.array_join(F.filter(kept, lambda line: T.strip(line) != ""), "\n")
    out = rows.select("source_id", "page_number", F.when(F.length(bare) >= least, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"))
    return out.unionByName(pages.where("text is null").select("source_id", "page_number", "text"))
