"""Queries of the resolution family."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions import text as T
from strataweave.operators import graph, resolve
from strataweave.plans import adapters
from strataweave.plans.adapters import GRAPH
from strataweave.plans.registry import query
from strataweave.session import materialize

#: Names with variants that the rules know.
NAMES = """SELECT CAST(n_regionkey AS STRING) AS run_id, CAST(n_nationkey AS BIGINT) AS ord, CASE n_nationkey % 8 WHEN 0 THEN 'Klimaschutz' WHEN 1 THEN 'klimaanpassung' WHEN 2 THEN 'Klimaschutz und Klimaanpassung' WHEN 3 THEN 'Mobilität'
 WHEN 4 THEN 'Mobilität und Verkehr' WHEN 5 THEN 'Verkehr und Mobilität' WHEN 6 THEN 'Erneuerbare Energien' ELSE 'Energie' END AS name FROM nation"""
RULED = f"""nm AS ({NAMES}), c AS (SELECT *, CASE WHEN regexp_matches(name, '(?i)^klimaschutz$|^klimaanpassung$|^klima(schutz)?\\s+(und|&)?\\s*(klimaanpassung|anpassung)?$') THEN 'Klimaschutz und Klimaanpassung' WHEN regexp_matches(name, '(?i)^(mobilität|verkehr)$') THEN name
 WHEN regexp_matches(name, '(?i)^(mobilität\\s+und\\s+verkehr|verkehr\\s+und\\s+mobilität)$') THEN 'Mobilität und Verkehr' WHEN regexp_matches(name, '(?i)^energie$') THEN name WHEN regexp_matches(name, '(?i)^erneuerbare\\s+energien?$') THEN 'Energie' ELSE name END AS canonical FROM nm)"""


@query(f"WITH {RULED} SELECT name, canonical, count(*) AS n FROM c GROUP BY ALL")
def name_rules_canonical(spark, sf_dir):
    names = adapters.sql(spark, sf_dir, NAMES)
    return names.groupBy("name", T.canonical_name(F.col("name")).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RULED}, d AS (SELECT run_id, canonical, name, min(ord) AS ord FROM c GROUP BY ALL) SELECT run_id, canonical, string_agg(name, '|' ORDER BY ord) AS names, arg_max(name, (length(name), -ord)) AS keep FROM d GROUP BY run_id, canonical HAVING count(*) > 1""")
def resolve_rule_groups(spark, sf_dir):
    return resolve.rule_groups(adapters.sql(spark, sf_dir, NAMES)).withColumn("names", F.concat_ws("|", "names"))


@query(f"""WITH {RULED}, m AS (SELECT run_id, c.canonical AS af, c.canonical AS key, name, ord, s FROM c LEFT JOIN (SELECT c_nationkey AS k, list(DISTINCT c_mktsegment) AS s FROM customer GROUP BY ALL) ON k = ord),
t AS (SELECT run_id, af, key, arg_max(name, (length(name), -ord)) AS title, list_sort(list_distinct(flatten(list(s)))) AS measures FROM m GROUP BY ALL) SELECT run_id, af AS action_field, title, array_to_string(measures, '|') AS measures FROM t""")
def consolidate_projects(spark, sf_dir):
    names = adapters.sql(spark, sf_dir, NAMES)
    s = adapters.sql(spark, sf_dir, "SELECT CAST(c_nationkey AS BIGINT) AS ord, array_sort(collect_set(c_mktsegment)) AS measures FROM customer GROUP BY c_nationkey")
    p = names.join(s, "ord", "left").select("run_id", F.col("name").alias("action_field"), F.col("name").alias("title"), "measures", F.lit(None).cast("array<string>").alias("indicators"), "ord")
    return resolve.consolidate(p).select("run_id", "action_field", "title", F.concat_ws("|", F.array_sort("measures")).alias("measures"))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.3""")
def cosine_pairs(spark, sf_dir):
    v = adapters.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return resolve.cosine_pairs(v, 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("""WITH s AS (SELECT q.vec_id AS q, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS x FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)
SELECT q, id, round(x, 6) AS similarity, CAST(row_number() OVER (PARTITION BY q ORDER BY x DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 5""")
def cosine_topk(spark, sf_dir):
    v = adapters.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return resolve.top_similar(v, v.filter("id % 50 = 0").select(F.col("id").alias("q"), "v")).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT a.vec_id AS a, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark, sf_dir):
    """Cosine of each vector and the next, as an expression."""
    e = adapters.read(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("a"), F.round(resolve.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query()
def difflib_dupes(spark, sf_dir):
    """Star groups of part names by brand; the matcher has no counterpart in SQL."""
    n = adapters.read(spark, sf_dir, "part").select(F.lit("run").alias("run_id"), F.col("p_brand").alias("bucket"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return resolve.duplicate_rate(n, resolve.star_groups(n)).drop("run_id")


@query()
def registry_canonical(spark, sf_dir):
    n = adapters.read(spark, sf_dir, "part").select(F.lit("run").alias("run_id"), F.col("p_brand").alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return resolve.registry_statistics(resolve.register(n)).drop("run_id")


QUOTE = r"trim(regexp_replace(regexp_replace({0}, '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s.,;:!?()\-]', ' ', 'g'))"
FORM = lambda x: f"lower(replace(replace(replace(replace(replace(replace(replace({QUOTE.format(x)}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss'))"


@query(f"""WITH q AS (SELECT item_id, {FORM('text')} AS f FROM benchmark), d AS (SELECT doc_id, {FORM('text')} AS f FROM documents) SELECT item_id, count(*) AS pages FROM q JOIN d ON contains(d.f, q.f) GROUP BY item_id""")
def quote_exact_match(spark, sf_dir):
    """Documents that hold a benchmark item word for word: each item is a quote, looked up in every document by its first words."""
    q = adapters.read(spark, sf_dir, "benchmark").select("item_id", T.quote_form(F.col("text")).alias("form"))
    texts = adapters.read(spark, sf_dir, "documents").select("doc_id", "text")
    page = T.quote_form(F.col("text")).alias("page")
    # The quote's second to fifth words are whole words of the page, too: an equi-join proposes, containment decides.
    key = F.concat_ws(" ", F.slice(F.split("form", " "), 2, 4))
    words = adapters.spread(texts, "doc_id").select("doc_id", page).withColumn("w", F.split("page", " "))
    grams = words.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1))), lambda i: F.concat_ws(" ", F.slice("w", i, F.lit(4)))))).alias("key"))
    # Runs of words meet without their pages; a page's text comes back for the pairs that are left.
    pairs = materialize(grams.join(q.select("item_id", key.alias("key")), "key").select("item_id", "doc_id").distinct(), "proposed")
    proposed = adapters.spread(texts.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id").select("doc_id", page)
    found = pairs.join(q, "item_id").join(proposed, "doc_id").filter(F.contains("page", "form"))
    return found.select("item_id", "doc_id").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("pages"))


@query()
def quote_fuzzy_match(spark, sf_dir):
    """Benchmark items with a changed word, each against the whole document that its number names."""
    b = adapters.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), (F.col("item_id") * 3).alias("page"), F.regexp_replace("text", " the ", " thee ").alias("quote"))
    pages = adapters.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text")
    return resolve.fuzzy_quote(b, pages)


PROJ = """SELECT 'run' AS run_id, r_name AS action_field, n_name AS title, m AS measures, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE m END AS indicators FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey AS k, {agg} AS m FROM customer WHERE c_custkey % 40 = 0 GROUP BY c_nationkey) ON k = n_nationkey"""
P_DUCK, P_SPARK = PROJ.format(agg="list_sort(list(DISTINCT c_mktsegment))"), PROJ.format(agg="array_sort(collect_set(c_mktsegment))")


@query(f"""WITH p AS ({P_DUCK}) SELECT count(DISTINCT action_field) AS action_fields, count(title) AS projects, count(*) FILTER (coalesce(len(measures), 0) < 1) AS no_measures, count(*) FILTER (coalesce(len(indicators), 0) < 1) AS no_indicators,
round(avg(coalesce(len(measures), 0)), 6) AS mean, CAST(max(coalesce(len(measures), 0)) AS INT) AS most, CAST(min(coalesce(len(measures), 0)) AS INT) AS least, count(*) FILTER (coalesce(len(measures), 0) > 10) AS many,
count(DISTINCT action_field) FILTER (title IS NULL) AS without_projects, round(avg(coalesce(len(indicators), 0)), 6) AS mean_indicators, CAST(max(coalesce(len(indicators), 0)) AS INT) AS most_indicators, CAST(min(coalesce(len(indicators), 0)) AS INT) AS least_indicators FROM p""")
def consistency_report(spark, sf_dir):
    return resolve.consistency(adapters.sql(spark, sf_dir, P_SPARK)).drop("run_id")


@query(f"""WITH p AS ({P_DUCK}) SELECT title, array_to_string(CASE WHEN coalesce(len(measures), 0) < 1 THEN CASE WHEN contains(lower(title), '_1') THEN ['a', 'b', 'c'] WHEN contains(lower(title), '2') THEN ['d'] ELSE ['x', 'y'] END ELSE measures END, '|') AS measures, coalesce(len(measures), 0) < 1 AS imputed FROM p""")
def impute_measures(spark, sf_dir):
    out = resolve.impute(adapters.sql(spark, sf_dir, P_SPARK), {"_1": ("a", "b", "c", "d"), "2": ("d",)}, ("x", "y"))
    return out.select("title", F.concat_ws("|", "measures").alias("measures"), "imputed")


@query(f"""WITH {GRAPH} SELECT r_name AS action_field, count(DISTINCT n_nationkey) AS projects, count(DISTINCT c_custkey) AS measures FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON c_nationkey = n_nationkey GROUP BY r_name""")
def tree_rebuild(spark, sf_dir):
    nodes = graph.build_nodes(adapters.entities(spark, sf_dir))
    edges = adapters.connections(spark, sf_dir).select("run_id", F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"))
    t = resolve.rebuild_tree(nodes, edges)
    return t.select("action_field", F.size("projects").cast("bigint").alias("projects"), F.aggregate("projects", F.lit(0), lambda a, p: a + F.coalesce(F.size(p["measures"]), F.lit(0))).cast("bigint").alias("measures"))


@query(f"""WITH p AS ({P_DUCK}), x AS (SELECT action_field AS a, title AS b, 0.9 AS c FROM p UNION SELECT title, unnest(measures), 0.8 FROM p UNION SELECT title, unnest(indicators), 0.8 FROM p
UNION SELECT m, i, 0.75 FROM (SELECT unnest(measures) AS m, indicators FROM p) t, LATERAL (SELECT unnest(indicators) AS i)) SELECT a AS from_name, b AS to_name, CAST(c AS DOUBLE) AS confidence FROM x""")
def tree_flatten(spark, sf_dir):
    p = adapters.sql(spark, sf_dir, P_SPARK)
    tree = p.groupBy("run_id", "action_field").agg(F.collect_list(F.struct("title", "measures", "indicators")).alias("projects"))
    return resolve.flatten_tree(tree).drop("run_id").withColumn("confidence", F.col("confidence").cast("double"))


@query("""SELECT p_partkey, contains(lower(p_name), 'x') AS temporary, p_name IN ('small ring') AS english FROM part""".replace("contains(lower(p_name), 'x')", "regexp_matches(lower(concat('TEMP_', p_name)), '^(temp|placeholder|new|created|temporary|tmp)_')").replace("p_name IN ('small ring')", "regexp_matches(concat(p_name, ' Overview'), '(?i)\\b(current|future|enhanced|new findings|overview|summary|background|framework|implementation|assessment|review)\\b')"))
def name_predicates(spark, sf_dir):
    part = adapters.read(spark, sf_dir, "part")
    return part.select("p_partkey", T.is_temporary_id(F.concat(F.lit("TEMP_"), "p_name")).alias("temporary"), T.is_english_name(F.concat("p_name", F.lit(" Overview"))).alias("english"))


@query(f"""WITH nm AS ({NAMES}), f AS (SELECT run_id, name, min(ord) AS ord FROM nm GROUP BY ALL) SELECT run_id, concat(run_id, ' field') AS action_field, string_agg(name, '|' ORDER BY ord) AS titles FROM f WHERE run_id <> '3' GROUP BY run_id""")
def exact_merge(spark, sf_dir):
    """The fallback merge: exact names, English ones left out."""
    n = adapters.sql(spark, sf_dir, NAMES).withColumn("action_field", F.when(F.col("run_id") == "3", "An overview of all").otherwise(F.concat("run_id", F.lit(" field")))).withColumnRenamed("name", "title")
    return resolve.exact_merge(n).withColumn("titles", F.concat_ws("|", "titles"))


@query("""WITH n AS (SELECT DISTINCT p_brand AS run_id, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS name FROM part) SELECT run_id, name FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.run_id = a.run_id AND length(b.name) > length(a.name) AND contains(lower(b.name), lower(a.name)))""")
def containment_merge(spark, sf_dir):
    n = adapters.sql(spark, sf_dir, "SELECT p_brand AS run_id, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS name, p_partkey AS ord FROM part")
    return resolve.without_contained(n)


@query("SELECT p_brand AS run_id, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS names FROM part GROUP BY p_brand")
def collected_names(spark, sf_dir):
    n = adapters.sql(spark, sf_dir, "SELECT p_brand AS run_id, p_name AS name FROM part")
    return resolve.collect_names(n).withColumn("names", F.concat_ws("|", "names"))
