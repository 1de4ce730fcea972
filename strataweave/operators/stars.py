"""Greedy clustering in order, as joins: which names are stars, and which star each other name takes.

The rule is sequential: in order, a name that is similar to no star before it becomes a star. The stars are the first maximal independent set of
the similarity graph in that order, and they are found in rounds: among the names that are undecided, those without an undecided earlier
neighbour are stars, and their later neighbours are taken. A round is three joins on numbers; the edges that are left shrink with each. No task sees a
group of names, only pairs of them.

Edges come from candidates that lose nothing. If the matcher's ratio of texts of m and n characters is at least t, they share t(m + n)/2
characters in blocks that m + n - 2M others separate, so also c(m + n) - (q - 1) of their q-grams, with c = t/2 - (q - 1)(1 - t). So of
each text's q-grams, rarest first, a prefix is enough to meet every partner (pairs of grams q = 2, single characters where texts are short or t is low). A text
that another one contains meets it by its rarest gram. Rarity is a bounded table of counts by hash, so a collision costs candidates and no pair. Lengths
and multisets of characters bound the ratio before the matcher runs.

Defined results: texts are compared as given; equal ones have ratio 1, also empty ones. Order is by `ord`, then text. Nulls are the caller's to replace. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.session import materialize

RARITY = 1 << 16  # counters of grams by hash
EPS = 1e-9


def taken(edges: DataFrame) -> DataFrame:
    """dst of the names that a star before them takes; edges: src, dst (numbers; src stands before dst). All others are stars.

    Ends because the first of the names that are left is a star with an edge, or has none. Rounds: the longest chain of names each of which decides the next one, at most.
    """
    edges = materialize(edges.select("src", "dst").distinct(), "edges")
    done: DataFrame | None = None
    while edges.take(1):
        heads = edges.select("src").join(edges.select(F.col("dst").alias("src")), "src", "left_anti").distinct()
        now = materialize(edges.join(heads, "src").select("dst").distinct(), "taken")
        done = now if done is None else done.unionByName(now)
        left = edges.join(now, "dst", "left_anti").join(now.select(F.col("dst").alias("src")), "src", "left_anti")
        edges = materialize(left.select("src", "dst"), "edges")
    return done if done is not None else edges.select("dst")


def from_stars(edges: DataFrame) -> DataFrame:
    """The edges (src, dst, ...) whose src is a star: each taken name's possible stars."""
    return edges.join(taken(edges).select(F.col("dst").alias("src")), "src", "left_anti")


# ---- candidates ------------------------------------------------------------------------------------


def _share(least: float, q: int) -> float:
    """Of the characters of both texts, the share that are common q-grams at least (but for q - 1)."""
    return least / 2 - (q - 1) * (1 - least)


def grams_of(least: float) -> int:
    return 2 if _share(least, 2) >= 0.1 else 1


def short_below(least: float) -> float:
    """Length below which pairs of characters may fail to meet."""
    return 2 / _share(least, 2) * (2 - least) / 2 if grams_of(least) == 2 else 0.0


def prefix_size(size: int, least: float, q: int) -> int:
    """How many of a text's q-grams, rarest first, hold one of any partner's."""
    grams = size - q + 1
    common = max(1, ceil(_share(least, q) * 2 * size / (2 - least) - (q - 1) - EPS))
    return grams - common + 1


def _slot(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram) % RARITY


def _rarity(texts: DataFrame) -> np.ndarray:
    """Counts of single characters and pairs, by hash."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(RARITY, np.int64)
        for frame in frames:
            for text in frame["text"]:
                for gram in {*text, *map("".join, zip(text, text[1:], strict=False))}:
                    counts[_slot(gram)] += 1
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": some, "n": counts[some]})

    out = np.zeros(RARITY, np.int64)
    for row in texts.select("text").mapInPandas(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most RARITY rows
        out[row["slot"]] = row["n"]
    return out


def tokens(text: str, least: float, counts: np.ndarray, contained: bool) -> list[str]:
    """What a text is met by: '=' (both empty), '1' and '2' grams with their number among equal ones, 'c' and 'p' for containing and contained ones."""
    if not text:
        return ["="]
    rare = lambda g: (counts[_slot(g)], g)
    out = []
    for q in (1, 2):
        grams = [text[i : i + q] for i in range(len(text) - q + 1)]
        if (q == grams_of(least) or len(text) < short_below(least)) and grams:
            seen: Counter[str] = Counter()
            numbered = []
            for g in grams:
                seen[g] += 1
                numbered.append((rare(g), seen[g]))
            out += [f"{q}{g}{n}" for (_, g), n in sorted(numbered)[: max(prefix_size(len(text), least, q), 0)]]
        if contained:
            out += [f"c{g}" for g in set(grams)]
            if grams and q == min(len(text), 2):
                out.append(f"p{min(grams, key=rare)}")
    return out


def _met(texts: DataFrame, least: float, contained: bool) -> DataFrame:
    """cluster, id, at, text, token, kind: what each text is met by."""
    counts = texts.sparkSession.sparkContext.broadcast(_rarity(texts))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(token=[tokens(t, least, counts.value, contained) for t in frame["text"]])

    met = texts.select("cluster", "id", "text").mapInPandas(run, "cluster string, id bigint, text string, token array<string>")
    each = met.join(texts.select("id", "at"), "id").select("cluster", "id", "at", "text", F.explode("token").alias("token"))
    return each.withColumn("kind", F.substring("token", 1, 1))


def _side(rows: DataFrame, name: str, ref: str) -> DataFrame:
    return rows.select("cluster", "token", F.col("id").alias(name), F.col("at").alias(f"{name}_at"), F.col("text").alias(ref), F.length("text").alias(f"{ref}_size"))


def _inside(each: DataFrame) -> DataFrame:
    """x, y, s, t: texts s (not empty) that a text t of the cluster contains, met by the rarest gram of s."""
    probe, holds = (each.where(F.col("kind") == kind).withColumn("token", F.expr("substring(token, 2)")) for kind in "pc")
    return _side(probe, "x", "s").join(_side(holds, "y", "t"), ["cluster", "token"]).where((F.col("x") != F.col("y")) & F.expr("contains(t, s)"))


def contained(texts: DataFrame) -> DataFrame:
    """id of the texts that a longer one of their cluster contains; texts: id, at, cluster, text. The empty text is in every other one."""
    inside = _inside(_met(texts, 1.0, True)).where("t_size > s_size").select(F.col("x").alias("id"))
    filled = texts.where("text <> ''").select("cluster").distinct()
    return inside.unionByName(texts.where("text = ''").join(filled, "cluster", "left_semi").select("id")).distinct()


def candidates(texts: DataFrame, least: float, contained: bool = False) -> DataFrame:
    """src, dst, a, b: pairs of texts of a group that may be similar, src before dst; texts: id, at (sortable), cluster, text."""
    each = _met(texts, least, contained)
    alike = each.where(F.col("kind").isin("=", "1", "2"))
    # 2 min / (m + n) bounds the ratio
    fits = 2 * F.least("a_size", "b_size") >= F.lit(least - EPS) * (F.col("a_size") + F.col("b_size"))
    pairs = _side(alike, "src", "a").join(_side(alike, "dst", "b"), ["cluster", "token"]).where((F.col("src_at") < F.col("dst_at")) & fits)
    if contained:
        inside = _inside(each)
        first = F.col("x_at") < F.col("y_at")
        pick = lambda p, q, name: F.when(first, F.col(p)).otherwise(F.col(q)).alias(name)
        pairs = pairs.select("src", "dst", "a", "b").unionByName(inside.select(pick("x", "y", "src"), pick("y", "x", "dst"), pick("s", "t", "a"), pick("t", "s", "b")))
    return pairs.select("src", "dst", "a", "b").dropDuplicates(["src", "dst"])


def scored(pairs: DataFrame, score: Callable[[str, str, float], float], least: float) -> DataFrame:
    """src, dst, score of the pairs (src, dst, a, b) whose score is at least `least`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.assign(score=[score(a, b, least) for a, b in zip(frame["a"], frame["b"], strict=True)])
            yield frame.loc[frame["score"] >= least, ["src", "dst", "score"]]

    return pairs.mapInPandas(run, "src bigint, dst bigint, score double")


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """The matcher's ratio, or 0 where its bound from the multisets of characters is below `least`; the order of the two counts."""
    if a == b:
        return 1.0
    matcher = SequenceMatcher(None, a, b)
    return matcher.ratio() if matcher.quick_ratio() >= least else 0.0


def numbered(names: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """Distinct names of each group with a number that stays: keys, name, ord, id, at, cluster, text."""
    distinct = names.groupBy(*keys, "name").agg(F.min("ord").alias("ord"))
    rows = distinct.withColumns({"text": text, "cluster": F.to_json(F.struct(*keys)), "at": F.struct("ord", "name"), "id": F.monotonically_increasing_id()})
    return materialize(rows, "names")


# ---- neighbours by cosine --------------------------------------------------------------------------


def near_vectors(rows: DataFrame, least: float, block: int = 1024) -> DataFrame:
    """src, dst, score: pairs of a cluster whose cosine is at least `least`; rows: id, at, cluster, v.

    The vectors of a cluster are put in order of their angle to its mean and dealt into blocks of that order. Angles obey the triangle inequality, so
    blocks whose ranges are further apart than the angle of `least` have no pair; the other pairs of blocks are one matrix product each.
    """

    def unit(column: pd.Series) -> np.ndarray:
        x = np.stack(column.to_numpy()).astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    flat = rows.withColumn("size", size).select("cluster", "id", "at", "v", F.transform("v", lambda x: F.when(F.col("size") > 0, x.cast("double") / F.col("size")).otherwise(0.0)).alias("u"))
    mean = flat.select("cluster", F.posexplode("u").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot, norm = total(F.zip_with("u", "m", lambda x, y: x * y)), F.sqrt(total(F.transform("m", lambda x: x * x)))
    angle = F.when(norm > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norm)))).otherwise(0.0)
    placed = materialize(flat.join(mean, "cluster").select("cluster", "id", "at", "v", angle.alias("angle")), "angles")
    # Blocks by quantiles of the angle: a cluster's cuts are as many as its blocks, and no task sorts a cluster.
    cuts = placed.groupBy("cluster").agg(F.percentile_approx("angle", [i / 256 for i in range(257)], 10_000).alias("q"), F.count(F.lit(1)).alias("n"))
    blocks = F.least(F.ceil(F.col("n") / block), F.lit(256)).cast("int")
    own = F.size(F.filter(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.col("blocks") - 1, F.lit(1))), lambda i: F.when(F.col("blocks") > 1, F.get("q", (i * 256 / F.col("blocks")).cast("int"))))), lambda c: c < F.col("angle")))
    salt = F.pmod(F.xxhash64("id"), F.greatest(F.ceil(F.col("n") / (256 * block)), F.lit(1)))  # of clusters with more than 256 blocks
    dealt = placed.join(cuts.withColumn("blocks", blocks), "cluster").select("cluster", "id", "at", "v", "angle", F.concat_ws("-", own, salt).alias("block"))
    dealt = materialize(dealt, "blocks")
    ranges = dealt.groupBy("cluster", "block").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
    other = ranges.select("cluster", F.col("block").alias("other"), F.col("low").alias("o_low"), F.col("high").alias("o_high"))
    reach = F.acos(F.lit(min(max(least, -1.0), 1.0))) + 1e-6
    close = ranges.join(other, "cluster").where((F.col("block") <= F.col("other")) & (F.col("low") - F.col("o_high") <= reach) & (F.col("o_low") - F.col("high") <= reach))
    close = materialize(close.select("cluster", "block", "other"), "close")
    mine = dealt.join(close, ["cluster", "block"]).select("cluster", "block", "other", "id", "at", "v")
    theirs = dealt.withColumnRenamed("block", "other").join(close, ["cluster", "other"]).select("cluster", "block", "other", "id", "at", "v")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            near = unit(a["v"]) @ unit(b["v_r"]).T
            ids, other = a["id"].to_numpy(), b["id_r"].to_numpy()
            same = a["block"].iat[0] == a["other"].iat[0]
            for i, j in zip(*np.nonzero(near >= least), strict=True):
                if ids[i] != other[j] and (not same or ids[i] < other[j]):
                    out.append((ids[i], other[j], near[i, j]))
        return pd.DataFrame(out, columns=["x", "y", "score"]).astype({"x": "int64", "y": "int64", "score": "float64"})

    keys = ["cluster", "block", "other"]
    right = theirs.select(*(F.col(c).alias(f"{c}_r") for c in keys), F.col("id").alias("id_r"), F.col("v").alias("v_r"))
    found = mine.drop("at").groupBy(*keys).cogroup(right.groupBy(*(f"{c}_r" for c in keys))).applyInPandas(run, "x bigint, y bigint, score double")
    at = rows.select("id", "at")
    both = found.join(at.select(F.col("id").alias("x"), F.col("at").alias("x_at")), "x").join(at.select(F.col("id").alias("y"), F.col("at").alias("y_at")), "y")
    first = F.col("x_at") < F.col("y_at")
    return both.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("src"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("dst"), "score")
