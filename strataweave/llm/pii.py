"""Personal data: fixed patterns, and contextual patterns bootstrapped from what they find.

Base: emails, IP addresses, card and phone numbers by regular expression, leftmost and
non-overlapping per kind, with checks that drop a match. Labelled secrets (token = "...") are a kind beside these four, reported
apart and never in the base.

Bootstrap: every word with a digit or an at sign, run on over words of a number's shape, is an instance with its place.
Instances that are wholly a base match are seeds. A lexical pattern is the words around a slot for such words: the word before
(a label keeps its colon), two words before, one on either side, two after, where a line's ends count as words and digits are alike. The graph of
patterns and instances is built once; then `rounds` times

1. patterns with at least `support` accepted distinct instances, `purity` of them of one kind, are induced for that kind;
2. a pattern's trust is the mean score of the distinct instances in its slots, times 1 - 1 / (1 + support);
3. another instance's score is the noisy-or of its patterns' trusts, for its best kind; it is accepted, and induces
   patterns in the next round, if that reaches `confidence`, a pattern reaches `trust`, and the value has the kind's shape.

Copies of a value in a pattern count once. Accepted instances in the slot of a trusted pattern of their kind become spans, where
they do not overlap a base span.

Everything is DataFrame functions. Possessive quantifiers and look-behinds keep the regular
expressions linear and free of recursion in very long texts; they match what the plain ones do. The graph's keys are 64-bit hashes.

Defined results: null and empty texts have no spans and the digest of the empty string. Places are code points, ends exclusive.
Repeated rows are each reported; rows with one id and different texts are told apart by the text's
hash. Of kinds that score alike the first listed is taken. An empty table gives an empty result. Very long texts are read
whole, in time in proportion. Columns beside doc_id and text never enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import table
from strataweave.session import materialize

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}  # a text without it has no match
SPAN = "struct<kind:int,start:int,stop:int>"
SECRET = len(KINDS)  # the number of the fifth kind
SECRET_LABEL = "(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)"
SECRET_VALUE = r"[A-Za-z0-9_+/=.-]{12,}+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
        return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255))
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _starts(sizes: Column) -> Column:
    """What stands before each entry of an array of sizes, added up; in blocks, so that long arrays are not copied entry by entry."""
    block = F.greatest(F.ceil(F.sqrt(F.size(sizes))), F.lit(1)).cast("int")
    blocks = F.ceil(F.size(sizes) / block).cast("int")
    begin = lambda at: F.struct(at.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda state, x: F.struct((state["at"] + x).cast("int").alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
    part = lambda j: F.slice(sizes, j * block + 1, block)
    whole = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.aggregate(part(j), F.lit(0), lambda a, x: a + x))
    firsts = F.aggregate(whole, begin(F.lit(0)), step, lambda s: s["out"])
    each = F.transform(firsts, lambda at, j: F.aggregate(part(j), begin(at), step, lambda s: s["out"]))
    return F.when(F.size(sizes) > 0, F.flatten(each)).otherwise(F.array().cast("array<int>"))


def _gaps(pattern: str, hits: Column) -> Column:
    """What stands before each hit of a pattern, since the hit before."""
    return F.slice(F.split("text", pattern, -1), F.lit(1), F.size(hits))


def _located(number: int, kind: str, pattern: str, valid) -> Column:
    """The spans of a kind, from `text` and the matches of its pattern in `<kind>_found`.

    The text is split at the matches; lengths of gaps and matches add up to places. Texts
    without a match that passes are not split.
    """
    hits = F.col(f"{kind}_found")
    sizes = F.transform(F.arrays_zip(_gaps(pattern, hits).alias("gap"), hits.alias("hit")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), x["hit"].alias("value")))
    places = F.transform(
        F.arrays_zip(sizes.alias("x"), _starts(F.transform(sizes, lambda x: x["gap"] + x["hit"])).alias("before")),
        lambda z: F.struct((z["before"] + z["x"]["gap"]).alias("start"), z["x"]["hit"].alias("long"), z["x"]["value"].alias("value")),
    )
    span = lambda x: F.struct(F.lit(number).alias("kind"), x["start"].alias("start"), (x["start"] + x["long"]).alias("stop"))
    spans = F.transform(F.filter(places, lambda x: valid(x["value"])), span)
    return F.when(F.exists(hits, valid), spans).otherwise(F.array()).cast(f"array<{SPAN}>")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), spans: the base matches that pass."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    found = [
        (F.when(F.contains("text", F.lit(NEEDS[k])), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) if k in NEEDS else F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).alias(f"{k}_found")
        for k in KINDS
    ]
    # Only texts with a match that can pass are split for the places of their matches.
    held = rows.select("doc_id", "text", F.xxhash64("text").alias("key"), *found)
    valid = lambda kind: lambda v: _valid(kind, v)
    each = [_located(i, kind, PATTERNS[kind], valid(kind)) for i, kind in enumerate(KINDS)]
    return held.select("doc_id", "key", F.concat(*each).alias("spans"))


#: An instance: a word with a digit or an at sign; one that ends in a digit or a bracket runs on over words of a number's shape.
INSTANCE = (
    r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
    r"(?:(?<=[0-9)])(?:\x20[+(]?[0-9][0-9().-]*+(?!\S))*+(?:(?<=[0-9)])\x20[0-9][0-9().-]*+[\p{P}&&[^(]]*+(?!\S))?+)?+"
)
LEAD = r"^(?:[^\pL\pN+@(]|\((?![0-9]+\)))*+"  # marks that are not part of a value
#: What a value must be like to be taken for a kind: an at sign; digits and dots or colons; digits enough.
SHAPES = {"email": r"@", "ip": r"^[0-9a-fA-F]*[.:][0-9a-fA-F.:]*[0-9]", "card": r"^[^A-Za-z]*(?:[0-9][^A-Za-z0-9]*){12}", "phone": r"^[^A-Za-z]*(?:[0-9][^A-Za-z0-9]*){7}", "secret": r"^(?=.*[0-9])\S{8,}$"}


def _fold(text: Column) -> Column:
    """Lower case, digits alike, line ends as a word: contexts are compared in this form."""
    return F.regexp_replace(F.translate(F.lower(text), "012345678", "999999999"), r"[^\S\n]*+\n\s*+", " ^ ")


def _words(text: Column) -> Column:
    """Words without the marks around them, but for a label's colon or equals sign."""
    bare = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\pL\pN+^=]+|[^\pL\pN:=^]+$", ""))
    return F.filter(bare, lambda w: w != "")


def _patterns(before: Column, after: Column) -> Column:
    """The names of the patterns of a slot, from the words on either side (nearest first)."""
    b = lambda i: F.get(before, i)
    a = lambda i: F.get(after, i)
    named = lambda tag, *w: F.when(w[-1].isNotNull() & w[0].isNotNull(), F.xxhash64(F.lit(tag), *w))
    return F.array_distinct(F.array_compact(F.array(named("L", b(0)), named("LL", b(0), b(1)), named("LR", b(0), a(0)), named("RR", a(0), a(1)))))


def _kind_of(value: Column, secret: Column) -> Column:
    """The kind that a value wholly is, null if none; -1 if it only holds an email, an address or a number of a kind."""
    whole = lambda k: value.rlike("^(?:" + PATTERNS[k].replace(r"(?:(?<![A-Za-z0-9._%+-])|\G)", "").replace("(?<![0-9])", "") + ")$")
    kind = F.when(secret, F.lit(SECRET))
    for i, k in enumerate(KINDS):
        kind = kind.when(whole(k) & _valid(k, value), F.lit(i))
    return kind.when(value.rlike(PATTERNS["email"]) | value.rlike(PATTERNS["ip"]) | value.rlike(PATTERNS["phone"]), F.lit(-1))


def instances(docs: DataFrame) -> DataFrame:
    """doc_id, key, start, stop, instance (hash of the value), kind (of a seed, else null), shapes, patterns: every place of every text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hits = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(INSTANCE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = rows.select("doc_id", "text", F.xxhash64("text").alias("key"), hits.alias("hits")).filter("size(hits) > 0")
    parts = found.select("doc_id", "key", "hits", F.split("text", INSTANCE, -1).alias("gaps"))
    sizes = F.zip_with(F.slice("gaps", F.lit(1), F.size("hits")), "hits", lambda g, h: F.length(g) + F.length(h))
    zipped = F.arrays_zip(
        F.col("hits").alias("hit"),
        _starts(sizes).alias("at"),
        F.slice("gaps", F.lit(1), F.size("hits")).alias("gap"),
        F.slice("gaps", F.lit(2), F.size("hits")).alias("next"),
        F.concat(F.array(F.lit("\n")), F.slice("hits", F.lit(1), F.size("hits") - 1)).alias("last"),
        F.concat(F.slice("hits", F.lit(2), F.size("hits") - 1), F.array(F.lit("\n"))).alias("follow"),
    )
    each = parts.select("doc_id", "key", F.explode(zipped).alias("x")).select("doc_id", "key", "x.*")
    each = each.select(
        "doc_id",
        "key",
        (F.col("at") + F.length("gap") + F.length(F.regexp_extract("hit", LEAD, 0))).alias("start"),
        F.regexp_replace(F.regexp_replace("hit", LEAD, ""), r"[^\pL\pN]+$", "").alias("value"),
        F.substring_index(F.rtrim(_fold(F.concat("last", "gap"))), " ", -4).alias("before"),
        F.substring_index(F.ltrim(_fold(F.concat("next", "follow"))), " ", 4).alias("after"),
    ).filter("value <> ''")
    secret = F.col("value").rlike(f"^{SECRET_LABEL}[:=]") | F.col("before").rlike(f"{SECRET_LABEL}[\"']?\\s*[:=]\\s*$")
    shapes = F.array_compact(F.array(*(F.when(F.col("value").rlike(SHAPES[k]), F.lit(i)) for i, k in enumerate((*KINDS, "secret")))))
    return each.select(
        "doc_id",
        "key",
        "start",
        (F.col("start") + F.length("value")).alias("stop"),
        F.xxhash64(F.lower("value")).alias("instance"),
        _kind_of(F.col("value"), secret & F.col("value").rlike(f"^{SECRET_VALUE}$") & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")).alias("kind"),
        shapes.alias("shapes"),
        _patterns(F.reverse(_words(F.col("before"))), _words(F.col("after"))).alias("patterns"),
    )


def bootstrap(edges: DataFrame, support: int = 4, rounds: int = 3, confidence: float = 0.75, trust: float = 0.5, purity: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(instance, kind, score) of accepted instances that are no seeds, and (pattern, kind, trust).

    edges: pattern, instance, kind (of a seed, else null), shapes; one row a (pattern, instance) pair.
    """
    total = edges.groupBy(F.col("pattern").alias("t_pattern")).agg(F.count(F.lit(1)).alias("total"))
    # A pattern with fewer instances is never induced.
    total = materialize(total.filter(F.col("total") >= support), "pattern-totals")
    graph = materialize(edges.join(total, F.col("pattern") == F.col("t_pattern")).select("pattern", "instance", "kind", "shapes", "total"), "pattern-graph")
    seeds = graph.filter("kind >= 0").select(F.col("instance").alias("n_instance"), F.col("kind").alias("n_kind")).distinct()
    nodes = materialize(seeds.withColumns({"score": F.lit(1.0), "accepted": F.lit(True)}), "instance-scores")
    seeds, trusts = nodes, None
    for _ in range(rounds):
        valued = graph.join(nodes, F.col("instance") == F.col("n_instance"))
        by_kind = valued.groupBy("pattern", "n_kind").agg(F.sum("score").alias("sum"), F.count_if("accepted").alias("support"), F.max("total").alias("total"))
        best = by_kind.groupBy("pattern").agg(F.max_by(F.struct("n_kind", "sum", "support", "total"), F.struct("support", "sum", -F.col("n_kind"))).alias("b"), F.sum("support").alias("all"))
        best = best.select("pattern", "b.*", "all").filter((F.col("support") >= support) & (F.col("support") >= purity * F.col("all")))
        weight = 1 - 1 / (1 + F.col("support"))
        trusts = materialize(best.select(F.col("pattern").alias("p_pattern"), F.col("n_kind").alias("p_kind"), (F.least(F.col("sum") / F.col("total"), F.lit(1.0)) * weight).alias("trust")), "pattern-scores")
        back = graph.filter("kind is null").join(trusts, F.col("pattern") == F.col("p_pattern"))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))
        each = back.groupBy("instance", "p_kind").agg((1 - doubt).alias("score"), F.max("trust").alias("best"), F.bool_or(F.array_contains("shapes", F.col("p_kind"))).alias("fits"))
        each = each.filter("fits").groupBy(F.col("instance").alias("n_instance")).agg(F.max_by(F.struct("p_kind", "score", "best"), F.struct("score", -F.col("p_kind"))).alias("b"))
        new = each.select("n_instance", F.col("b.p_kind").alias("n_kind"), F.col("b.score").alias("score"), ((F.col("b.score") >= confidence) & (F.col("b.best") >= trust)).alias("accepted"))
        new = materialize(new, "instance-scores")
        if not new.take(1):
            break
        nodes = seeds.union(new)
    found = nodes.filter("accepted").join(seeds.select(F.col("n_instance").alias("s_instance")), F.col("n_instance") == F.col("s_instance"), "left_anti")
    return found.select(F.col("n_instance").alias("instance"), F.col("n_kind").alias("kind"), "score"), trusts.select(F.col("p_pattern").alias("pattern"), F.col("p_kind").alias("kind"), "trust")


def discover(places: DataFrame, base: DataFrame, trust: float = 0.5, **settings) -> DataFrame:
    """doc_id, key, kind, start, stop of identifiers that contextual patterns find, and of the secrets that are seeds.

    places: as `instances` gives them; base: as `base_spans` does.
    """
    each = places.filter("kind is null or kind >= 0").select("instance", "kind", "shapes", F.explode("patterns").alias("pattern"))
    edges = materialize(each.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.first("shapes").alias("shapes")), "edges")
    accepted, trusts = bootstrap(edges, trust=trust, **settings)
    good = trusts.filter(F.col("trust") >= trust).select(F.col("pattern").alias("g_pattern"), F.col("kind").alias("g_kind"))
    open_ = places.filter("kind is null").join(accepted.select(F.col("instance").alias("a_instance"), F.col("kind").alias("a_kind")), F.col("instance") == F.col("a_instance"))
    slots = open_.select("doc_id", "key", "start", "stop", "a_kind", F.explode("patterns").alias("pattern"))
    held = slots.join(good, (F.col("pattern") == F.col("g_pattern")) & (F.col("a_kind") == F.col("g_kind")), "left_semi")
    new = held.select("doc_id", "key", F.col("a_kind").alias("kind"), "start", "stop").union(places.filter(f"kind = {SECRET}").select("doc_id", "key", "kind", "start", "stop")).distinct()
    taken = base.filter("size(spans) > 0").select(F.col("doc_id").alias("b_id"), F.col("key").alias("b_key"), "spans").distinct()
    joined = new.join(taken, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("key") == F.col("b_key")), "left")
    clash = F.exists("spans", lambda s: (s["start"] < F.col("stop")) & (s["stop"] > F.col("start")))
    return joined.filter(~F.coalesce(clash, F.lit(False))).select("doc_id", "key", "kind", "start", "stop")


def _text_of(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*(F.lit(k) for k in (*KINDS, "secret"))), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["stop"])), ",")


def find(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, base, spans, secrets (arrays of start, kind, stop) for every row of `docs` (doc_id, text); `settings` of `bootstrap`."""
    docs = docs.select("doc_id", "text")
    base = materialize(base_spans(docs), "base-spans")
    more = discover(materialize(instances(docs), "instances"), base, **settings)
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))
    own = F.array_sort(F.transform("spans", place))
    extra = more.groupBy(F.col("doc_id").alias("m_id"), F.col("key").alias("m_key")).agg(F.collect_list(F.struct("start", "kind", "stop")).alias("more"))
    joined = base.join(extra, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left")
    more = F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,stop:int>>"))
    every = F.array_sort(F.concat(own, F.filter(more, lambda s: s["kind"] < SECRET)))
    return joined.select("doc_id", own.alias("base"), every.alias("spans"), F.array_sort(F.filter(more, lambda s: s["kind"] == SECRET)).alias("secrets"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of `documents`; beside the contract's columns the labelled secrets, and the number of all finds."""
    found = find(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.col("spans")).alias("spans"),
        _text_of(F.col("secrets")).alias("secrets"),
        (F.size("spans") + F.size("secrets")).cast("bigint").alias("n_found"),
    )
