"""Entity resolution: rules, difflib, cosine and registry matching, star clustering, consolidation, imputation."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions import text as T
from strataweave.operators import stars
from strataweave.session import materialize


def rule_groups(names: DataFrame) -> DataFrame:
    """Groups of names with one canonical name, of two or more: run_id, canonical, names (in order), keep (the longest, first on ties). names: run_id, name, ord."""
    rows = names.withColumn("canonical", T.canonical_name(F.col("name")))
    first = rows.groupBy("run_id", "canonical", "name").agg(F.min("ord").alias("ord"))
    groups = first.groupBy("run_id", "canonical").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"), F.max_by("name", F.struct(F.length("name"), -F.col("ord"))).alias("keep")
    )
    return groups.filter(F.size("names") > 1)


def consolidate(projects: DataFrame) -> DataFrame:
    """Projects under canonical action fields and titles, with the details of all members.

    projects: run_id, action_field, title, measures, indicators, ord. Details are unseen ones in order.
    """
    rows = projects.withColumn("af", T.canonical_name(F.col("action_field"))).withColumn("key", T.canonical_name(F.col("title")))
    parts = F.array_sort(F.collect_list(F.struct("ord", "measures", "indicators")))
    merged = lambda c: F.array_distinct(F.flatten(F.transform("parts", lambda p: F.coalesce(p[c], F.array().cast("array<string>")))))
    groups = rows.groupBy("run_id", "af", "key").agg(F.max_by("title", F.struct(F.length("title"), -F.col("ord"))).alias("title"), parts.alias("parts"))
    return groups.select("run_id", F.col("af").alias("action_field"), "title", merged("measures").alias("measures"), merged("indicators").alias("indicators"))


def name_similarity(a: str, b: str) -> float:
    """1 for equal names, 0.9 for containment, else the ratio of the matcher; the order of the two counts."""
    a, b = (a or "").lower().strip(), (b or "").lower().strip()
    if a == b:
        return 1.0
    if a and b and (a in b or b in a):
        return 0.9
    return SequenceMatcher(None, a, b).ratio()


def _similar(a: str, b: str, least: float) -> float:
    """`name_similarity` of forms, with the matcher's bound first."""
    if a and b and a != b and (a in b or b in a):
        return 0.9
    return stars.ratio(a, b, least)


def star_groups(names: DataFrame, least: float = 0.85) -> DataFrame:
    """Greedy star clustering of names per run and bucket: run_id, bucket, name, ord, star (ord of the first similar one before it).

    A name joins the first earlier representative that is similar enough, else it represents itself. Equal names collapse before. Pairs that
    may be similar are found by grams, and the representatives by rounds of joins (see `stars`); no bucket is ever in one task.
    """
    rows = stars.numbered(names, F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), r"(?U)^\s+|\s+$", ""), ["run_id", "bucket"])
    pairs = stars.candidates(rows, least, contained=least <= 0.9)
    edges = materialize(stars.scored(pairs, _similar, least), "similar")
    star = stars.from_stars(edges).join(rows.select(F.col("id").alias("src"), F.col("at").alias("star_at")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("star_at").alias("star_at"))
    return rows.join(star, "id", "left").select("run_id", "bucket", "name", "ord", F.coalesce("star_at.ord", "ord").alias("star"))


def duplicate_rate(names: DataFrame, groups: DataFrame) -> DataFrame:
    """Share of entities that repeat an earlier one, per bucket; 0 for fewer than two."""
    n = names.groupBy("run_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    stars = groups.groupBy("run_id", "bucket").agg(F.count_distinct("star").alias("stars"))
    return n.join(stars, ["run_id", "bucket"]).withColumn("rate", F.when(F.col("n") < 2, 0.0).otherwise(F.round((F.col("n") - F.col("stars")) / F.col("n"), 6)))


def register(names: DataFrame, least: float = 0.8) -> DataFrame:
    """Ordered registration: each name takes the best canonical one before it of at least `least`, the earliest on ties, else becomes one.

    The canonical ones are the stars of the same kind of clustering, so they come from rounds of joins; a name then takes the best of its edges.
    """
    rows = stars.numbered(names, F.coalesce(T.registry_form(F.col("name")), F.lit("")), ["run_id", "kind"])
    pairs = stars.candidates(rows, least)
    # The matcher takes the new form first.
    edges = materialize(stars.scored(pairs, lambda a, b, t: stars.ratio(b, a, t), least), "similar")
    known = rows.select(F.col("id").alias("src"), F.col("at.ord").alias("known_ord"), F.col("name").alias("known"))
    best = stars.from_stars(edges).join(known, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((-F.col("score")).alias("s"), "known_ord", "known")).alias("best"))
    return rows.join(best, "id", "left").select("run_id", "kind", "name", "ord", F.coalesce("best.known", "name").alias("canonical"))


def registry_statistics(registered: DataFrame) -> DataFrame:
    """Names seen, canonical ones, merged ones with their share, and the last five merges as 'name -> canonical', per run and kind."""
    n, c = F.count(F.lit(1)), F.count_distinct("canonical")
    last = F.row_number().over(Window.partitionBy("run_id", "kind", "merged_name").orderBy(F.desc("ord")))
    rows = registered.withColumn("merged_name", F.col("name") != F.col("canonical")).withColumn("back", last)
    recent = F.array_sort(F.collect_list(F.when(F.col("merged_name") & (F.col("back") <= 5), F.struct("ord", F.concat("name", F.lit(" -> "), "canonical").alias("text")))))
    return rows.groupBy("run_id", "kind").agg(
        n.alias("seen"), c.alias("canonical"), (n - c).alias("merged"), F.round((n - c) / n, 6).alias("rate"), F.array_join(F.transform(recent, lambda x: x["text"]), "; ").alias("recent_merges")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one is zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


#: Blocks of `cosine_pairs`: while there are fewer than PARTS of the least size more are made, and beyond that they grow up to MOST vectors.
PARTS, MOST = 24, 16384


def cosine_parts(count: int, block: int) -> int:
    """In how many blocks so many vectors are dealt; a vector is sent to each block's pair with its own, so what is sent grows with this number."""
    return max(1, min(-(-count // block), max(PARTS, -(-count // max(block, MOST)))))


def cosine_pairs(vectors: DataFrame, least: float = 0.65, block: int = 2048) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of vectors at least so similar; vectors: id, v.

    Vectors are dealt over blocks, and each pair of blocks is one exact matrix product, by strips: every task
    holds two blocks of a bounded size. Only similar pairs leave it.
    """
    parts = cosine_parts(vectors.count(), block)
    dealt = vectors.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    # Row p of the upper triangle of block pairs meets column q.
    key = lambda p, q: (p * parts + q).alias("pair")
    left = dealt.select("id", "v", "p", F.explode(F.sequence(F.col("p"), F.lit(parts - 1))).alias("q"))
    left = left.select(key(F.col("p"), F.col("q")), "id", "v")
    right = dealt.select("id", "v", F.col("p").alias("q"), F.explode(F.sequence(F.lit(0), F.col("p"))).alias("o"))
    right = right.select(key(F.col("o"), F.col("q")), F.col("id").alias("other"), F.col("v").alias("w"))  # names of its own

    def unit(column: pd.Series) -> np.ndarray:
        x = np.stack(column.to_numpy()).astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "similarity": np.empty(0)})
        one, two = unit(a["v"]), unit(b["w"]).T
        found = []
        for at in range(0, len(one), 512):
            near = one[at : at + 512] @ two
            i, j = np.nonzero(near >= least)
            found.append((i + at, j, near[i, j]))
        i, j, score = map(np.concatenate, zip(*found, strict=True))
        x, y = a["id"].to_numpy()[i], b["other"].to_numpy()[j]
        p, q = divmod(int(a["pair"].iloc[0]), parts)
        keep = x < y if p == q else x != y
        return pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep], "similarity": score[keep]})

    return left.groupBy("pair").cogroup(right.groupBy("pair")).applyInPandas(run, "a bigint, b bigint, similarity double")


def merge_allowed(a: Column, b: Column, similarity: Column) -> Column:
    """Whether two names may merge: very similar, one in the other, or enough common words."""
    x, y = F.lower(T.squeeze(a)), F.lower(T.squeeze(b))
    p, q = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    overlap = F.size(F.array_intersect(p, q)) / F.greatest(F.size(p), F.size(q))
    return (similarity >= 0.9) | F.contains(x, y) | F.contains(y, x) | (overlap >= 0.6)


# ---- the resolution of nested extractions ------------------------------------------------------

#: Similarity from which names may merge, and from which they do without further checks.
SIMILAR, AUTOMATIC = 0.65, 0.9


def positions(tree: DataFrame, kind: str = "action_field") -> DataFrame:
    """run_id, name, ord: names of action fields or projects in the order in which they stand; blank ones are left out.

    tree: run_id, ord, action_field, projects (array of title, measures, indicators, sources).
    """
    if kind == "action_field":
        rows = tree.select("run_id", F.col("action_field").alias("name"), F.struct("ord", F.lit(0).alias("p_ord")).alias("at"))
    else:
        rows = tree.select("run_id", "ord", F.posexplode("projects").alias("p_ord", "p")).select("run_id", F.col("p.title").alias("name"), F.struct("ord", "p_ord").alias("at"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("at"))
    return rows.filter(F.coalesce("name", F.lit("")) != "").withColumn("ord", place.cast("bigint")).select("run_id", "name", "ord")


def _may_merge(a: str, b: str, similarity: float) -> bool:
    """As `merge_allowed`, for a pair in a worker."""
    x, y = a.lower(), b.lower()
    p, q = set(x.split()), set(y.split())
    return similarity >= AUTOMATIC or x in y or y in x or bool(p and q) and len(p & q) / max(len(p), len(q)) >= 0.6


def similarity_groups(names: DataFrame, vectors: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Greedy stars of names by cosine: run_id, canonical (the star), names, keep (the longest name, first on ties).

    In order, a name that no star has taken takes the later ones that are similar enough and may merge with it.
    names: run_id, name, ord; vectors: name, v (one a name). Blocks of vectors meet in tasks, and stars come from rounds of joins; no run is in one task but as its result.
    """
    rows = stars.numbered(names, F.col("name"), ["run_id"])
    placed = rows.join(vectors, "name").select("id", "at", "cluster", "v")
    near = stars.near_vectors(placed, least)
    name = lambda end, to: rows.select(F.col("id").alias(end), F.col("text").alias(to))
    pairs = near.join(name("src", "a"), "src").join(name("dst", "b"), "dst")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.loc[[_may_merge(a, b, s) for a, b, s in zip(frame["a"], frame["b"], frame["score"], strict=True)], ["src", "dst"]]

    edges = materialize(pairs.mapInPandas(run, "src bigint, dst bigint"), "similar")
    star = stars.from_stars(edges).join(rows.select(F.col("id").alias("src"), "at"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("at").alias("star_at"))
    member = star.join(rows, "id").select("run_id", F.col("star_at").alias("star"), "name", "ord")
    heads = member.select("run_id", "star").distinct().select("run_id", "star", F.col("star.name").alias("name"), F.col("star.ord").alias("ord"))
    each = member.unionByName(heads)
    return each.groupBy("run_id", "star").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"), F.max_by("name", F.struct(F.length("name"), -F.col("ord"))).alias("keep")
    ).select("run_id", F.col("star.name").alias("canonical"), "names", "keep")


def candidate_groups(names: DataFrame, vectors: DataFrame | None = None, least: float = SIMILAR) -> DataFrame:
    """Groups of names that are one: by rules first, then by similarity among the names that no rule has grouped. run_id, names, keep."""
    rules = rule_groups(names).select("run_id", "names", "keep")
    if vectors is None:
        return rules
    taken = rules.select("run_id", F.explode("names").alias("name"))
    return rules.unionByName(similarity_groups(names.join(taken, ["run_id", "name"], "left_anti"), vectors, least).select("run_id", "names", "keep"))


def _renamed(rows: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """Rows with `target`, the name kept for the group that `column` is in, else the name itself."""
    to = groups.select("run_id", F.explode("names").alias(column), F.col("keep").alias("kept_name")).groupBy("run_id", column).agg(F.min("kept_name").alias("kept_name"))
    return rows.join(to, ["run_id", column], "left").withColumn("target", F.coalesce("kept_name", column)).drop("kept_name")


PROJECT_LISTS = ("measures", "indicators", "sources")


def _merged(rows: DataFrame, keys: list[str], of: str = "own") -> DataFrame:
    """One project per key: unseen details of all rows with `own`, in order. `at` is its first place."""
    lists = F.array_sort(F.collect_list(F.when(F.col(of), F.struct("at", *PROJECT_LISTS))))
    whole = rows.groupBy(*keys).agg(F.min("at").alias("at"), lists.alias("parts"))
    merged = lambda c: F.array_distinct(F.flatten(F.filter(F.transform("parts", lambda p: p[c]), lambda x: x.isNotNull()))).alias(c)
    return whole.select(*keys, "at", *(merged(c) for c in PROJECT_LISTS))


def _exploded(tree: DataFrame) -> DataFrame:
    each = tree.select("run_id", "ord", "action_field", F.posexplode("projects").alias("p_ord", "p"))
    return each.select("run_id", "ord", "action_field", F.struct("ord", "p_ord").alias("at"), F.coalesce("p.title", F.lit("")).alias("title"), *(F.col(f"p.{c}").alias(c) for c in PROJECT_LISTS))


def _tree(fields: DataFrame, projects: DataFrame) -> DataFrame:
    """fields: run_id, ord, action_field; projects: run_id, ord, at, title and lists."""
    per = projects.groupBy("run_id", "ord").agg(F.array_sort(F.collect_list(F.struct("at", F.struct("title", *PROJECT_LISTS).alias("p")))).alias("ps"))
    both = fields.join(per, ["run_id", "ord"], "left")
    return both.select("run_id", "ord", "action_field", F.coalesce(F.transform("ps", lambda x: x["p"]), F.filter(F.array(F.struct(F.lit("").alias("title"), *(F.lit(None).cast(projects.schema[c].dataType).alias(c) for c in PROJECT_LISTS))), lambda x: F.lit(False))).alias("projects"))


def merge_action_fields(tree: DataFrame, groups: DataFrame) -> DataFrame:
    """Action fields under the names kept, at their first place; projects of one title are one, with the unseen details of all."""
    fields = _renamed(tree, groups, "action_field").groupBy("run_id", "target").agg(F.min("ord").alias("ord")).withColumnRenamed("target", "action_field")
    rows = _renamed(_exploded(tree), groups, "action_field").drop("ord", "action_field").withColumnRenamed("target", "action_field").withColumn("own", F.lit(True))
    projects = _merged(rows, ["run_id", "action_field", "title"]).join(fields, ["run_id", "action_field"])
    return _tree(fields, projects)


def merge_projects(tree: DataFrame, groups: DataFrame, all_details: bool = False) -> DataFrame:
    """Projects of an action field under the names kept, at their first place.

    As published, the first member's details stay and only those of members that have the kept name join them; with `all_details` those of all.
    """
    rows = _renamed(_exploded(tree), groups, "title")
    first = F.col("at") == F.min("at").over(Window.partitionBy("run_id", "ord", "target"))
    rows = rows.withColumn("own", F.lit(True) if all_details else first | (F.col("title") == F.col("target")))
    projects = _merged(rows.drop("title").withColumnRenamed("target", "title"), ["run_id", "ord", "title"])
    return _tree(tree.select("run_id", "ord", "action_field"), projects)


def resolve(tree: DataFrame, vectors: DataFrame | None = None, action_fields: bool = True, projects: bool = True, least: float = SIMILAR, all_details: bool = False) -> DataFrame:
    """Nested extractions with one name for what is one: action fields, then projects.

    `vectors` (name, v) are embeddings that the caller brings; without them only the rules group names. Runs with fewer than two names stay as they are.
    """
    if action_fields:
        tree = merge_action_fields(tree, candidate_groups(positions(tree), vectors, least))
    if projects:
        tree = merge_projects(tree, candidate_groups(positions(tree, "project"), vectors, least), all_details)
    return tree


def top_similar(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048) -> DataFrame:
    """The k most similar vectors of each query: q, id, similarity, rank; queries: q, v.

    Queries and vectors are dealt over blocks of about `block` rows, and each pair of blocks is one exact matrix product that
    leaves at most k vectors a query; the k best of these are the result.
    """
    parts = {name: max(1, -(-table.count() // block)) for name, table in (("q", queries), ("v", vectors))}
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("q", "v", deal("q", parts["q"]).alias("p"), every(parts["v"]).alias("o")).select((F.col("p") * parts["v"] + F.col("o")).alias("pair"), "q", "v")
    right = vectors.select("id", F.col("v").alias("w"), deal("id", parts["v"]).alias("o"), every(parts["q"]).alias("p")).select((F.col("p") * parts["v"] + F.col("o")).alias("pair"), "id", "w")

    def unit(column: pd.Series) -> np.ndarray:
        x = np.stack(column.to_numpy()).astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(a) and len(b):
            own = b["id"].to_numpy()
            for q, row in zip(a["q"], unit(a["v"]) @ unit(b["w"]).T, strict=True):
                best = np.flatnonzero(own != q)
                best = best[np.lexsort((own[best], -row[best]))[:k]]
                out.append((np.full(len(best), q), own[best], row[best]))
        return pd.DataFrame(dict(zip(("q", "id", "similarity"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInPandas(run, "q bigint, id bigint, similarity double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def consistency(projects: DataFrame) -> DataFrame:
    """Counts, projects without measures or indicators, their distributions, action fields without projects (rows without a title); projects: run_id, action_field, title, measures, indicators."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    m, i = (F.when(F.col("title").isNotNull(), F.greatest(size(c), F.lit(0))) for c in ("measures", "indicators"))
    return projects.groupBy("run_id").agg(
        F.count_distinct("action_field").alias("action_fields"), F.count("title").alias("projects"), F.count_if(F.col("title").isNotNull() & (m < 1)).alias("no_measures"),
        F.count_if(F.col("title").isNotNull() & (size("indicators") < 1)).alias("no_indicators"), F.round(F.avg(m), 6).alias("mean"), F.max(m).alias("most"), F.min(m).alias("least"), F.count_if(m > 10).alias("many"),
        F.count_distinct(F.when(F.col("title").isNull(), F.col("action_field"))).alias("without_projects"), F.round(F.avg(i), 6).alias("mean_indicators"), F.max(i).alias("most_indicators"), F.min(i).alias("least_indicators"),
    )


def impute(projects: DataFrame, rules: dict[str, tuple[str, ...]], default: tuple[str, ...], most: int = 3) -> DataFrame:
    """Projects without measures get those of the first rule whose word is in their title, at most `most`."""
    value = F.array(*map(F.lit, default))
    for word, measures in reversed(rules.items()):
        value = F.when(F.contains(F.lower("title"), F.lit(word)), F.array(*map(F.lit, measures))).otherwise(value)
    empty = F.coalesce(F.size("measures"), F.lit(0)) < 1
    return projects.withColumn("imputed", empty).withColumn("measures", F.when(empty, F.slice(value, 1, most)).otherwise(F.col("measures")))


def resolve_or_keep(tree: DataFrame, *args, **settings) -> DataFrame:
    """`resolve`, worked out; the tree as it came if that fails."""
    try:
        return materialize(resolve(tree, *args, **settings), "resolved")
    except PySparkException as error:
        logging.getLogger(__name__).warning("resolution failed, names stay as they are: %s", error)
        return tree


# Words of action fields, then for each of their projects' words what a project without measures or indicators is given. None: whatever its title.
MEASURE_RULES = (
    (("klima", "energie", "co2"), (
        (("solar", "photovoltaik"), ("Installation von Solaranlagen", "Förderung erneuerbarer Energien")),
        (("wärme", "heizung"), ("Energetische Sanierung von Gebäuden", "Umstellung auf nachhaltige Heizsysteme")),
        (("verkehr", "mobilität"), ("Förderung emissionsarmer Mobilität", "Ausbau der Ladeinfrastruktur")),
    )),
    (("mobilität", "verkehr"), (
        (("rad", "fahrrad"), ("Ausbau des Radwegenetzes", "Verbesserung der Fahrradinfrastruktur")),
        (("öpnv", "bus", "bahn"), ("Modernisierung des öffentlichen Nahverkehrs", "Verbesserung der Taktung")),
        (("elektro", "laden"), ("Aufbau von Ladeinfrastruktur", "Förderung der Elektromobilität")),
    )),
    (("wohnen", "siedlung", "stadtentwicklung"), (
        (None, ("Entwicklung nachhaltiger Wohnkonzepte", "Förderung des sozialen Wohnungsbaus", "Verbesserung der städtebaulichen Qualität")),
    )),
)
MEASURE_DEFAULT = ("Entwicklung von Konzepten für {title}", "Umsetzung von Maßnahmen im Bereich {field}", "Koordination und Monitoring des Projekts {title}")
# The same for indicators, where only the first rule that fits counts.
INDICATOR_RULES = (
    (("klima", "energie", "co2"), (
        (("solar", "photovoltaik"), ("Installierte Solarkapazität in MW", "Anteil erneuerbarer Energien am Gesamtverbrauch in %", "CO2-Einsparung durch Solarenergie in Tonnen/Jahr")),
        (("reduzierung", "reduktion"), ("CO2-Reduktion um 30% bis 2030", "Energieverbrauch-Reduktion um 20%")),
        (None, ("CO2-Emissionen in Tonnen pro Jahr", "Energieeffizienz-Steigerung in %")),
    )),
    (("mobilität", "verkehr"), (
        (("rad", "fahrrad"), ("Länge neuer Radwege in km", "Anzahl der Fahrradabstellplätze", "Steigerung des Radverkehrsanteils um 15%")),
        (("öpnv", "bus", "bahn"), ("Fahrgastzahlen im ÖPNV", "Verbesserung der Pünktlichkeit auf 95%", "Reduktion der Wartezeiten um 20%")),
        (("elektro", "laden"), ("Anzahl der Ladepunkte", "Anteil der Elektrofahrzeuge in %", "500 neue Ladepunkte bis 2025")),
        (None, ("Verkehrsaufkommen-Reduktion in %", "Modal Split Verbesserung")),
    )),
    (("wohnen", "siedlung", "stadtentwicklung"), ((None, ("Anzahl neuer Wohneinheiten", "Anteil bezahlbarer Wohnungen in %", "Bevölkerungsdichte pro km²")),)),
)
INDICATOR_DEFAULT = ("Fortschritt bei der Umsetzung von {title} in %", "Zielerreichungsgrad für {field}", "Projektabschluss bis Ende 2026")


def _any(text: Column, words: tuple[str, ...] | None) -> Column:
    return F.lit(True) if words is None else reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def inferred(rules: tuple, default: tuple[str, ...], title: Column, field: Column, several: bool, most: int = 3) -> Column:
    """What the rules give for a project: of the first group whose words the action field has, all rules that fit or (not `several`) the first; else the default."""
    title, field = F.coalesce(title, F.lit("")), F.coalesce(field, F.lit(""))
    low_title, low_field = F.lower(title), F.lower(field)
    none = F.array().cast("array<string>")
    value = none
    for words, inner in reversed(rules):
        given = [(_any(low_title, w), F.array(*map(F.lit, out))) for w, out in inner]
        if several:
            own = F.concat(*(F.when(fits, out).otherwise(none) for fits, out in given))
        else:
            own = reduce(lambda rest, g: F.when(g[0], g[1]).otherwise(rest), reversed(given), none)
        value = F.when(_any(low_field, words), own).otherwise(value)
    put = lambda text: F.replace(F.replace(F.lit(text), F.lit("{title}"), title), F.lit("{field}"), field)
    return F.slice(F.when(F.size(value) > 0, value).otherwise(F.array(*map(put, default))), 1, most)


def improve(projects: DataFrame, least_measures: int = 1, least_indicators: int = 1) -> DataFrame:
    """Projects with too few measures or indicators get what the published rules infer, behind what they have; projects: run_id, action_field, title, measures, indicators.

    Adds recovered_measures and recovered_indicators, the numbers that came in.
    """
    out = projects
    for column, rules, default, several, least in (("measures", MEASURE_RULES, MEASURE_DEFAULT, True, least_measures), ("indicators", INDICATOR_RULES, INDICATOR_DEFAULT, False, least_indicators)):
        own = F.coalesce(column, F.array().cast("array<string>"))
        short = F.size(own) < least
        new = F.array_except(inferred(rules, default, F.col("title"), F.col("action_field"), several), own)
        out = out.withColumn(f"recovered_{column}", F.when(short, F.size(new)).otherwise(0)).withColumn(column, F.when(short, F.concat(F.array_distinct(own), new)).otherwise(own))
    return out


def improvement_report(projects: DataFrame, improved: DataFrame) -> DataFrame:
    """Per run the consistency before and after `improve`, and what was recovered."""
    before = consistency(projects).select("run_id", *(F.col(c).alias(f"{c}_before") for c in ("no_measures", "no_indicators")))
    after = consistency(improved).select("run_id", "projects", "no_measures", "no_indicators")
    gained = improved.groupBy("run_id").agg(F.sum("recovered_measures").alias("recovered_measures"), F.sum("recovered_indicators").alias("recovered_indicators"))
    return before.join(after, "run_id").join(gained, "run_id")


def fuzzy_quote(quotes: DataFrame, pages: DataFrame, least: float = 0.9, key: tuple[str, ...] = ("page",)) -> DataFrame:
    """Outcome of each quote on its page: exact, fuzzy, no_match, page_not_found; quotes: q_id, key columns, quote; pages: key columns, text.

    Blank quotes have none and are left out. A quote that the page holds as it stands is exact, as is one of three words or more in the compared form;
    only the rest goes to the matcher, a sliding window as wide as the quote.
    """
    asked = pages.join(quotes.select(*key).distinct(), list(key), "left_semi")
    known = asked.select(*key, "text", T.quote_form(F.col("text")).alias("page_text"))
    rows = quotes.withColumn("bare", T.strip(F.col("quote"))).filter("bare <> ''").withColumn("form", T.quote_form(F.col("quote"))).join(known, list(key), "left")
    words = F.size(F.filter(F.split("form", " "), lambda w: w != ""))
    held = F.contains("text", "bare") | ((words >= 3) & F.contains("page_text", "form"))
    rows = rows.withColumn("outcome", F.when(F.col("text").isNull(), "page_not_found").when(held, "exact").when((F.trim("form") == "") | (F.trim("page_text") == ""), "no_match"))

    @F.pandas_udf("boolean")
    def near(quote: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([_near(q, p, least) for q, p in zip(quote, page, strict=True)])

    rest = rows.filter("outcome is null").withColumn("outcome", F.when(near("form", "page_text"), "fuzzy").otherwise("no_match"))
    return rows.filter("outcome is not null").unionByName(rest).select("q_id", *key, "outcome")


def _near(quote: str, page: str, least: float) -> bool:
    """Whether a window of the page, or of a quote of fewer than three words the whole page, is as similar as `least`."""
    if len(quote.split()) < 3:
        return SequenceMatcher(None, quote, page).ratio() >= least
    width = len(quote)
    sift = SequenceMatcher()  # its quick ratios do not depend on the order of the two, the ratio does
    sift.set_seq2(quote)
    for at in range(len(page) - width + 1):
        window = page[at : at + width]
        sift.set_seq1(window)
        if sift.quick_ratio() >= least and SequenceMatcher(None, quote, window).ratio() >= least:
            return True
    return False


def rebuild_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Action fields with their projects, and these with measures and indicators by title, from a flat graph: run_id, action_field, projects."""
    named = lambda t: nodes.filter(F.col("type") == t).select("run_id", F.col("node"), F.col("name"))

    def children(kind: str, parent: str) -> DataFrame:
        c = named(kind).select("run_id", F.col("node").alias("to_id"), F.col("name").alias("child"))
        return edges.join(c, ["run_id", "to_id"]).groupBy("run_id", F.col("from_id").alias(parent)).agg(F.array_sort(F.collect_set("child")).alias(f"{kind}s"))

    p = named("project").join(children("measure", "node"), ["run_id", "node"], "left").join(children("indicator", "node"), ["run_id", "node"], "left")
    p = p.select("run_id", F.col("node").alias("to_id"), F.struct(F.col("name").alias("title"), "measures", "indicators").alias("project"))
    per = edges.join(p, ["run_id", "to_id"]).groupBy("run_id", F.col("from_id").alias("node")).agg(F.array_sort(F.collect_list("project")).alias("projects"))
    return named("action_field").join(per, ["run_id", "node"], "left").select("run_id", F.col("name").alias("action_field"), "projects")


def flatten_tree(tree: DataFrame) -> DataFrame:
    """Edges by title from the nested layout: field-project 0.9, project-measure and project-indicator 0.8, measure-indicator 0.75 within a project."""
    p = tree.select("run_id", "action_field", F.explode("projects").alias("p")).filter(F.col("action_field") != T.NULL_MARKER)
    row = lambda a, b, c: F.struct(a.alias("from_name"), b.alias("to_name"), F.lit(c).alias("confidence"))
    title = F.col("p.title")
    measures, indicators = (F.filter(F.coalesce(F.col(f"p.{c}"), F.array().cast("array<string>")), lambda x: x != T.NULL_MARKER) for c in ("measures", "indicators"))
    cross = F.flatten(F.transform(measures, lambda m: F.transform(indicators, lambda i: row(m, i, 0.75))))
    every = F.concat(F.array(row(F.col("action_field"), title, 0.9)), F.transform(measures, lambda m: row(title, m, 0.8)), F.transform(indicators, lambda i: row(title, i, 0.8)), cross)
    return p.select("run_id", F.inline(every)).distinct()


def exact_merge(projects: DataFrame) -> DataFrame:
    """The fallback: action fields of one exact name, without English names, with the first project of each title."""
    rows = projects.filter(~T.is_english_name(F.col("action_field")))
    first = rows.groupBy("run_id", "action_field", "title").agg(F.min("ord").alias("ord"))
    return first.groupBy("run_id", "action_field").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("titles"))


def without_contained(names: DataFrame) -> DataFrame:
    """Names that no longer name of the run contains, whatever the case of letters; names: run_id, name, ord. A name meets its containers by its rarest gram; no run is one array."""
    rows = stars.numbered(names.where("name is not null"), F.lower("name"), ["run_id"])
    return rows.join(stars.contained(rows), "id", "left_anti").select("run_id", "name")


def collect_names(names: DataFrame) -> DataFrame:
    """All names of a run, once and sorted."""
    return names.groupBy("run_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
