"""Queries of the content and text families, over whole documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataweave.functions import text as T
from strataweave.operators import content
from strataweave.plans import adapters
from strataweave.plans.registry import query
from strataweave.session import materialize

#: Parts as entities: names as titles, brand and type as descriptions, with some faults.
PARTS = """
  SELECT CASE p_partkey % 4 WHEN 0 THEN 'action_fields' WHEN 1 THEN 'projects' WHEN 2 THEN 'measures' ELSE 'indicators' END AS bucket, CAST(p_partkey AS STRING) AS id,
    CASE WHEN p_partkey % 11 = 0 THEN concat(' ', p_name, '  x') WHEN p_partkey % 17 = 0 THEN 'abc' WHEN p_partkey % 19 = 0 THEN upper(p_name) ELSE p_name END AS title,
    CASE WHEN p_partkey % 23 = 0 THEN 'A TODO entry' ELSE p_brand END AS name,
    CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 29 = 0 THEN concat(p_type, ' aaaaaaaa') WHEN p_partkey % 31 = 0 THEN repeat(p_type, 200) ELSE concat(p_name, ' of ', p_brand, ' and the ', p_type) END AS description
  FROM part
"""
FIELDS = ("title", "name", "description")
ROWS = f"p AS ({PARTS}), r AS (SELECT bucket, id, 'title' AS field, title AS text FROM p WHERE trim(title) <> '' UNION ALL SELECT bucket, id, 'name', name FROM p WHERE trim(name) <> '' UNION ALL SELECT bucket, id, 'description', description FROM p WHERE trim(description) <> '')"
SP = r"[\s\x{85}\x{A0}\x{1C}-\x{1F}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]"
NORM = lambda x: rf"trim(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(trim(regexp_replace(lower({x}), '{SP}+', ' ', 'g')), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('der','die','das','und','oder','in','zu','von','mit','für')), ' '))"


def _parts(spark, sf_dir):
    """The rows of PARTS, made where the table's rows have been dealt to, not in the few tasks that read them."""
    adapters.spread(adapters.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey").createOrReplaceTempView("part")
    return spark.sql(f"SELECT 'run' AS run_id, * FROM ({PARTS})")


def _rows(spark, sf_dir):
    return content.texts(_parts(spark, sf_dir), FIELDS)


def _documents(spark, sf_dir):
    return adapters.spread(adapters.read(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")


def _docs(spark, sf_dir):
    return _documents(spark, sf_dir).select(F.lit("run").alias("run_id"), "doc_id", "text", "source")


@query(f"WITH d AS (SELECT {NORM('text')} AS norm FROM documents) SELECT md5(norm) AS digest, n FROM (SELECT norm, count(*) AS n FROM d WHERE length(norm) > 10 GROUP BY norm) WHERE n > 1")
def repetition_exact(spark, sf_dir):
    return content.exact_repetition(_docs(spark, sf_dir)).select("digest", "n")


@query(rf"""WITH {ROWS}, f AS (SELECT DISTINCT {NORM('text')} AS norm FROM r WHERE field = 'description'), w AS (SELECT norm, list_distinct(string_split(norm, ' ')) AS ws FROM f WHERE norm <> '')
SELECT a.norm AS a, b.norm AS b, round(len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))), 6) AS similarity FROM w a JOIN w b ON a.norm < b.norm
WHERE len(list_intersect(a.ws, b.ws)) > 0.6 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))""")
def near_duplicates_jaccard(spark, sf_dir):
    """Word Jaccard above 0.6 among the parts' descriptions."""
    forms = _rows(spark, sf_dir).filter("field = 'description'").select("run_id", T.compare_form(F.col("text")).alias("norm"))
    return content.near_pairs(forms, 0.6).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(rf"""WITH {ROWS}, f AS (SELECT {NORM('text')} AS norm FROM r), c AS (SELECT norm, count(*) AS n, list_distinct(string_split(norm, ' ')) AS ws FROM f WHERE length(norm) > 10 GROUP BY norm),
near AS (SELECT unnest([a.norm, b.norm]) AS norm FROM c a JOIN c b ON a.norm < b.norm WHERE len(list_intersect(a.ws, b.ws)) > 0.9 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))))
SELECT count(*) FILTER (n > 1 OR norm IN (SELECT norm FROM near)) AS duplicated, count(*) AS distinct_texts, round(avg(CASE WHEN n > 1 OR norm IN (SELECT norm FROM near) THEN 1 ELSE 0 END), 6) AS rate FROM c""")
def repetition_rate(spark, sf_dir):
    forms = _rows(spark, sf_dir).select("run_id", T.compare_form(F.col("text")).alias("norm"))
    return content.repetition_rate(forms).drop("run_id")


@query(f"""WITH {ROWS}, g AS (SELECT b AS bucket, f AS field FROM (VALUES ('action_fields'), ('projects'), ('measures'), ('indicators')) x(b), (VALUES ('title'), ('name'), ('description'), ('full_description')) y(f))
SELECT g.bucket, g.field, count(text) AS n, coalesce(round(avg(length(text)), 6), 0) AS mean, coalesce(round(CAST(median(length(text)) AS DOUBLE), 6), 0) AS median, CAST(coalesce(min(length(text)), 0) AS INT) AS least,
 CAST(coalesce(max(length(text)), 0) AS INT) AS most, coalesce(round(stddev_pop(length(text)), 6), 0) AS std FROM g LEFT JOIN r ON r.bucket = g.bucket AND r.field = g.field GROUP BY g.bucket, g.field""")
def length_distribution(spark, sf_dir):
    return content.length_distribution(_rows(spark, sf_dir))


HITS = lambda ws: " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ws)
LANG = f"l AS (SELECT doc_id, lang, {HITS(T.GERMAN)} AS de, {HITS(T.ENGLISH)} AS en FROM documents WHERE length(text) > 10)"


@query(f"WITH {LANG} SELECT lang, CASE WHEN de > en THEN 'de' WHEN en > de THEN 'en' ELSE 'tie' END AS guess, count(*) AS n FROM l GROUP BY ALL")
def language_heuristic(spark, sf_dir):
    docs = adapters.read(spark, sf_dir, "documents").filter(F.length("text") > 10)
    return docs.groupBy("lang", F.coalesce(T.guess_language(F.col("text")), F.lit("tie")).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LANG}, c AS (SELECT count(*) AS texts, count(*) FILTER (de > en) AS de, count(*) FILTER (en > de) AS en FROM l)
SELECT texts, de, en, CASE WHEN de > en THEN 'de' WHEN en > 0 THEN 'en' ELSE 'unknown' END AS primary_language, round(1 - greatest(de, en) / texts, 6) AS inconsistency FROM c""")
def language_consistency(spark, sf_dir):
    return content.language_consistency(_docs(spark, sf_dir)).drop("run_id")


@query(rf"""WITH {ROWS} SELECT id, field, 'consecutive spaces' AS issue FROM r WHERE regexp_matches(text, '{SP}{{2,}}')
UNION ALL SELECT id, field, 'outer white space' FROM r WHERE text <> trim(text)
UNION ALL SELECT id, field, 'unusual characters' FROM r WHERE regexp_matches(text, '[^\p{{L}}\p{{N}}_\s\-.,;:!?()\[\]{{}}"''/]')
UNION ALL SELECT id, field, 'title in lower case' FROM r WHERE field IN ('title', 'name') AND lower(text) = text
UNION ALL SELECT id, field, 'long line' FROM (SELECT id, field, unnest(string_split(text, chr(10))) AS line FROM r) WHERE length(line) > 200""")
def normalization_issues(spark, sf_dir):
    return content.normalization_issues(_rows(spark, sf_dir)).drop("run_id")


@query(rf"""WITH {ROWS} SELECT id, field, 'too short' AS rule FROM r WHERE (field IN ('title', 'name') AND length(text) < 5) OR (field = 'description' AND length(text) < 10)
UNION ALL SELECT id, field, 'too long' FROM r WHERE (field IN ('title', 'name') AND length(text) > 200) OR (field = 'description' AND length(text) > 1000)
UNION ALL SELECT id, field, 'placeholder' FROM r WHERE regexp_matches(text, '(?i)\b(test|TODO|FIXME|placeholder)\b')
UNION ALL SELECT id, field, 'repeated characters' FROM r WHERE list_bool_or([contains(text, repeat(c, 6)) FOR c IN list_distinct(string_split(text, ''))])""")
def outliers(spark, sf_dir):
    return content.outliers(_rows(spark, sf_dir)).drop("run_id")


@query(f"WITH p AS ({PARTS}) SELECT bucket, id, 'description' AS field FROM p WHERE bucket IN ('measures', 'indicators') AND trim(description) = ''")
def missing_required(spark, sf_dir):
    return content.missing_required(_parts(spark, sf_dir)).drop("run_id")


@query("SELECT source, CAST(sum(floor(length(text) / 3.5)) AS BIGINT) AS tokens, CAST(min(floor(length(text) / 3.5)) AS BIGINT) AS least, CAST(max(floor(length(text) / 3.5)) AS BIGINT) AS most FROM documents GROUP BY source")
def token_estimates(spark, sf_dir):
    n = T.estimate_tokens(F.col("text"))
    return adapters.read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(n).alias("tokens"), F.min(n).alias("least"), F.max(n).alias("most"))


#: Documents of a source are its pages, by doc_id.
PAGES = "SELECT source AS source_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page_number, text FROM documents"
LINES = r"""pg AS (SELECT source AS source_id, text FROM documents), tot AS (SELECT source_id, count(*) AS pages FROM pg GROUP BY source_id), ls AS (SELECT source_id, regexp_split_to_array(trim(text), '\r\n|[\n\x{0B}\x{0C}\r\x{85}\x{2028}\x{2029}]') AS l FROM pg WHERE trim(text) <> ''),
ex AS (SELECT source_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i, len(l) AS n FROM ls),
pt AS (SELECT source_id, i, n, trim(regexp_replace(regexp_replace(line, '\b\d{1,4}\b', '', 'g'), '\s+', ' ', 'g')) AS pattern FROM ex)"""


def _pages(spark, sf_dir):
    """The rows of PAGES. Only keys are put in order source by source; texts meet their numbers by key, in as many tasks as there are."""
    rows = adapters.spread(adapters.read(spark, sf_dir, "documents").select(F.struct("source", "doc_id").alias("key"), "text"), "key")
    keys = adapters.read(spark, sf_dir, "documents").groupBy(F.struct("source", "doc_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key.source").orderBy("key.doc_id")) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("key").orderBy("text"))
    numbered = rows.join(keys.select("key", before.alias("before")), "key")
    return numbered.select(F.col("key.source").alias("source_id"), (F.col("before") + inside).cast("int").alias("page_number"), "text")


@query(rf"""WITH {LINES}, f AS (SELECT source_id, 'header' AS place, pattern FROM pt WHERE i < 3 AND length(pattern) > 10 UNION ALL SELECT source_id, 'footer', pattern FROM pt WHERE i >= n - 3 AND length(pattern) > 10)
SELECT source_id, place, md5(pattern) AS pattern, count(*) AS n FROM f JOIN tot USING (source_id) WHERE pages >= 3 GROUP BY source_id, place, f.pattern, pages HAVING count(*) >= greatest(floor(pages * 0.05), 2)""")
def header_footer_lines(spark, sf_dir):
    pages = _documents(spark, sf_dir).select(F.col("source").alias("source_id"), "text")
    found = content.headers_footers(pages, share=0.05, floor=2)
    return found.select("source_id", "place", F.md5("pattern").alias("pattern"), "n")


@query(r"""SELECT source, count(*) AS headings FROM (SELECT source, unnest(string_split(text, chr(10))) AS raw FROM documents) t, LATERAL (SELECT trim(raw) AS x, list_filter(string_split(trim(regexp_replace(raw, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws)
WHERE length(x) >= 3 AND (regexp_matches(x, '^(\d+(\.\d+)*\.?|[IVXLCDM]+\.|[A-Za-z]\))\s+') OR regexp_matches(x, '^(Kapitel|Abschnitt|Teil|Artikel|Paragraph|Handlungsfeld|Maßnahme|Projekt|Ziel|Indikator|Anhang|Anlage|Übersicht|Zusammenfassung)')
 OR (upper(x) = x AND lower(x) <> x AND length(x) > 3) OR (len(ws) >= 2 AND len(list_filter(ws, lambda w: regexp_full_match(left(w, 1), '\p{Lu}'))) / len(ws) > 0.7) OR (x LIKE '%:' AND length(x) < 100)) GROUP BY source""")
def heading_lines(spark, sf_dir):
    lines = _documents(spark, sf_dir).select("source", F.explode(F.transform(F.split("text", "\n"), T.strip)).alias("line"))
    return lines.filter(T.is_bare_heading(F.col("line"))).groupBy("source").agg(F.count(F.lit(1)).alias("headings"))


@query()
def noise_removed(spark, sf_dir):
    """Pages without their headers and footers."""
    pages = materialize(_pages(spark, sf_dir), "pages")
    out = content.without_noise(pages, content.headers_footers(pages, share=0.05, floor=2))
    return out.select("source_id", "page_number", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query()
def clean_text_full(spark, sf_dir):
    """Cleaned documents; look-around has no counterpart in the oracle's expressions."""
    return _documents(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("text")).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query(r"SELECT p_partkey, CASE WHEN length(p_name) > 10 THEN concat(left(p_name, 7), '...') ELSE p_name END AS short, CASE WHEN p_size * 100 < 1024 THEN concat(p_size * 100, ' B') ELSE printf('%.1f KB', p_size * 100 / 1024) END AS size FROM part")
def text_helpers(spark, sf_dir):
    part = adapters.read(spark, sf_dir, "part")
    return part.select("p_partkey", T.truncate(F.col("p_name"), 10).alias("short"), T.file_size(F.col("p_size") * 100).alias("size"))
