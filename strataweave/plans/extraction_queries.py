"""Queries of the chunking, operation-log and extraction families."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions import text as T
from strataweave.operators import chunking, extract, halves, oplog
from strataweave.plans import adapters
from strataweave.plans.content_queries import PAGES, _pages
from strataweave.plans.registry import query

STRIP = r"regexp_replace(text, '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')"
PACK = f"""WITH RECURSIVE p0 AS (SELECT source_id, page_number, {STRIP} AS text FROM ({PAGES})), p AS (SELECT source_id, page_number, text, length(text) AS n, row_number() OVER (PARTITION BY source_id ORDER BY page_number) AS i FROM p0 WHERE text <> ''),
f AS (SELECT source_id, i, n AS cur, 0 AS chunk, 0 AS own, false AS alone FROM p WHERE i = 1
  UNION ALL SELECT p.source_id, p.i,
    CASE WHEN f.cur = 0 THEN p.n WHEN p.n > 8000 THEN 0 WHEN f.cur + p.n + 2 <= 8000 THEN f.cur + p.n + 2 ELSE p.n END,
    CASE WHEN f.cur = 0 THEN f.chunk WHEN p.n > 8000 THEN f.chunk + 2 WHEN f.cur + p.n + 2 <= 8000 THEN f.chunk ELSE f.chunk + 1 END,
    CASE WHEN f.cur > 0 AND p.n > 8000 THEN f.chunk + 1 WHEN f.cur = 0 THEN f.chunk WHEN f.cur + p.n + 2 <= 8000 THEN f.chunk ELSE f.chunk + 1 END, false
  FROM f JOIN p ON p.source_id = f.source_id AND p.i = f.i + 1),
c AS (SELECT p.source_id, own, sum(n) + 2 * (count(*) - 1) AS n, min(page_number) AS first, max(page_number) AS last, count(*) AS pages FROM p JOIN f ON p.source_id = f.source_id AND p.i = f.i GROUP BY p.source_id, own),
o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY own) AS k FROM c),
m AS (SELECT source_id, k, n AS size, 0 AS chunk FROM o WHERE k = 1
  UNION ALL SELECT o.source_id, o.k, CASE WHEN o.n < 1500 AND m.size + o.n + 2 <= 8000 THEN m.size + o.n + 2 ELSE o.n END, CASE WHEN o.n < 1500 AND m.size + o.n + 2 <= 8000 THEN m.chunk ELSE m.chunk + 1 END
  FROM m JOIN o ON o.source_id = m.source_id AND o.k = m.k + 1),
chunks AS (SELECT o.source_id, m.chunk AS chunk_index, sum(o.n) + 2 * (count(*) - 1) AS n_chars, min(first) AS first_page, max(last) AS last_page, sum(pages) AS n_pages FROM o JOIN m ON m.source_id = o.source_id AND m.k = o.k GROUP BY o.source_id, m.chunk)"""


def _chunks(spark, sf_dir):
    return chunking.pack_pages(_pages(spark, sf_dir))


@query(f"{PACK} SELECT source_id, CAST(chunk_index AS INT) AS chunk_index, CAST(n_chars AS BIGINT) AS n_chars, first_page, last_page, CAST(n_pages AS BIGINT) AS n_pages FROM chunks")
def chunks_greedy(spark, sf_dir):
    return _chunks(spark, sf_dir).select("source_id", "chunk_index", F.length("text").cast("bigint").alias("n_chars"), F.array_min("pages").alias("first_page"), F.array_max("pages").alias("last_page"), F.size("pages").cast("bigint").alias("n_pages"))


@query(f"{PACK} SELECT source_id, count(*) AS chunks, CAST(sum(floor(n_chars / 3.5)) AS BIGINT) AS tokens, round(avg(floor(n_chars / 3.5)), 6) AS mean, CAST(min(floor(n_chars / 3.5)) AS BIGINT) AS least, CAST(max(floor(n_chars / 3.5)) AS BIGINT) AS most FROM chunks GROUP BY source_id")
def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(_chunks(spark, sf_dir))


STRIPPED = lambda x: STRIP.replace("regexp_replace(text,", f"regexp_replace({x},")
_WS = lambda x: rf"list_filter(string_split(trim(regexp_replace({x}, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"
HEADING = lambda x: rf"""(length({x}) >= 3 AND (regexp_matches({x}, '^(\d+(\.\d+)*\.?|[IVXLCDM]+\.|[A-Za-z]\))\s+') OR regexp_matches({x}, '^({'|'.join(T.HEADING_WORDS)})')
 OR (upper({x}) = {x} AND lower({x}) <> {x} AND length({x}) > 3) OR (len({_WS(x)}) >= 2 AND len(list_filter({_WS(x)}, lambda w: regexp_full_match(left(w, 1), '\p{{Lu}}'))) / len({_WS(x)}) > 0.7) OR ({x} LIKE '%:' AND length({x}) < 100)))"""  # noqa: E731
_RFIND = lambda m: f"(CASE WHEN contains(piece, {m}) THEN length(piece) - strpos(reverse(piece), reverse({m})) - length({m}) + 1 ELSE -1 END)"
_MARKS = ["'. '", "'.' || chr(10)", "'! '", "'!' || chr(10)", "'? '", "'?' || chr(10)"]
_CUT = " ".join(f"WHEN {_RFIND(f'({m})')} > size * 0.5 THEN {_RFIND(f'({m})')} + 2" for m in _MARKS)
HEADED = rf"""{PACK}, ct AS (SELECT p.source_id, m.chunk AS chunk_index, string_agg(p.text, chr(10) || chr(10) ORDER BY p.i) AS text, min(p.page_number) AS lo, max(p.page_number) AS hi, count(*) AS np
  FROM p JOIN f ON f.source_id = p.source_id AND f.i = p.i JOIN o ON o.source_id = f.source_id AND o.own = f.own JOIN m ON m.source_id = o.source_id AND m.k = o.k GROUP BY p.source_id, m.chunk),
hl AS (SELECT *, list_transform(list_slice(regexp_split_to_array(text, '\r\n|[\n\x{{0B}}\x{{0C}}\r\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]'), 1, 5), lambda l: {STRIPPED('l')}) AS ls FROM ct),
hh AS (SELECT *, list_filter(ls, lambda l: {HEADING('l')})[1] AS heading FROM hl),
headed AS (SELECT source_id, chunk_index, concat(repeat('=', 80), chr(10), 'DOKUMENT: Dokument', chr(10), 'SEITEN: ', CASE WHEN np > 1 THEN concat(lo, '-', hi) ELSE CAST(lo AS VARCHAR) END, chr(10),
  CASE WHEN heading IS NOT NULL THEN concat('ABSCHNITT: ', left(heading, 100), chr(10)) ELSE '' END, repeat('=', 80), chr(10), text) AS text FROM hh)"""


@query(f"{HEADED} SELECT source_id, CAST(chunk_index AS INT) AS chunk_index, CAST(length(text) AS INT) AS n_chars, md5(text) AS digest FROM headed")
def chunk_headers(spark, sf_dir):
    return chunking.with_header(_chunks(spark, sf_dir)).select("source_id", "chunk_index", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"""{HEADED}, nx AS (SELECT *, CAST(floor(length(text) * 0.15) AS INT) AS size, lead(text) OVER (PARTITION BY source_id ORDER BY chunk_index) AS follow FROM headed),
pc AS (SELECT *, CASE WHEN size > 0 AND length(follow) > size THEN left(follow, size) END AS piece FROM nx),
cu AS (SELECT *, CASE {_CUT} WHEN {_RFIND("(chr(10) || chr(10))")} > size * 0.3 THEN {_RFIND("(chr(10) || chr(10))")} + 2 ELSE size END AS cut FROM pc),
tl AS (SELECT *, {STRIPPED('left(piece, cut)')} AS tail FROM cu),
ov AS (SELECT source_id, chunk_index, CASE WHEN coalesce(tail, '') <> '' THEN concat(text, chr(10), chr(10), '[OVERLAP_START]', chr(10), tail, chr(10), '[OVERLAP_END]') ELSE text END AS text FROM tl)
SELECT source_id, CAST(chunk_index AS INT) AS chunk_index, CAST(length(text) AS INT) AS n_chars, md5(text) AS digest FROM ov""")
def chunk_overlap(spark, sf_dir):
    out = chunking.with_overlap(chunking.with_header(_chunks(spark, sf_dir)))
    return out.select("source_id", "chunk_index", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


#: Events as an operation log: sign-ups create, purchases update, clicks connect, others are no operation.
FLAT = """
SELECT concat('s', CAST(user_id % 40 AS STRING)) AS source_id, CAST(event_id / 700 AS INT) AS chunk_index, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'purchase' THEN 'UPDATE' WHEN 'click' THEN 'CONNECT' ELSE upper(event_type) END AS operation,
  CASE event_id % 4 WHEN 0 THEN 'action_field' WHEN 1 THEN 'project' WHEN 2 THEN 'measure' ELSE 'indicator' END AS entity_type,
  CASE WHEN event_type <> 'purchase' THEN NULL WHEN event_id % 9 = 0 THEN '' ELSE concat('proj_', CAST(event_id % 9 AS STRING)) END AS entity_id,
  CASE WHEN event_id % 13 = 0 OR event_type = 'click' THEN NULL ELSE concat('Title ', regexp_extract(props, '[0-9]+', 0)) END AS title,
  CASE WHEN event_id % 13 = 0 OR event_id % 3 = 0 OR event_type = 'click' THEN NULL ELSE concat(event_type, '.') END AS description,
  CASE WHEN event_id % 17 = 0 THEN 'temp_1' WHEN event_id % 19 = 0 THEN '' ELSE concat('af_', CAST(event_id % 5 + 1 AS STRING)) END AS from_id,
  CASE WHEN event_id % 23 = 0 THEN 'NEW_2' ELSE concat('proj_', CAST(event_id % 11 + 1 AS STRING)) END AS to_id, value / 100 AS confidence
FROM events
"""
PRI = "CASE operation WHEN 'CREATE' THEN 0 WHEN 'UPDATE' THEN 1 WHEN 'CONNECT' THEN 2 ELSE 3 END"
LOG = f"""flat AS ({FLAT.replace('CAST(event_id / 700 AS INT)', 'CAST(event_id // 700 AS INT)')}), ordered AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY chunk_index, {PRI}, seq) AS pos FROM flat),
made AS (SELECT *, concat(CASE entity_type WHEN 'action_field' THEN 'af' WHEN 'project' THEN 'proj' WHEN 'measure' THEN 'msr' ELSE 'ind' END, '_', row_number() OVER (PARTITION BY source_id, entity_type ORDER BY pos)) AS id
  FROM ordered WHERE operation = 'CREATE' AND coalesce(title, description, '') <> '')"""


def _ops(spark, sf_dir):
    flat = adapters.sql(spark, sf_dir, FLAT.replace("CAST(event_id / 700 AS INT)", "CAST(event_id div 700 AS INT)"))
    link = F.array(F.struct("from_id", "to_id", F.lit(None).cast("double").alias("confidence")))
    return flat.select(
        "source_id", "chunk_index", "seq", "operation", "entity_type", "entity_id", "title", "description", F.array(F.col("description")).alias("tags"),
        F.when(F.col("operation") == "CONNECT", link).alias("connections"), "confidence", F.array((F.col("seq") % 7).cast("int")).alias("source_pages"), F.col("title").alias("source_quote"),
    )


#: Before the batch every source knows the first eight projects.
KNOWN = "known AS (SELECT source_id, concat('proj_', i) AS id FROM (SELECT DISTINCT source_id FROM flat), generate_series(1, 8) t(i))"


def _known(ops):
    return ops.select("source_id").distinct().select("source_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("i")).select("source_id", F.concat(F.lit("proj_"), F.col("i").cast("string")).alias("id"))


@query(f"""WITH {LOG}, {KNOWN}, v AS (SELECT f.*, CASE WHEN operation NOT IN ('CREATE','UPDATE','CONNECT') THEN 'unknown operation' WHEN operation = 'CREATE' AND coalesce(title, description, '') = '' THEN 'no content'
 WHEN operation = 'UPDATE' AND coalesce(entity_id, '') = '' THEN 'no entity id' WHEN operation = 'CONNECT' AND (from_id = '' OR to_id = '') THEN 'connection without an end'
 WHEN operation <> 'CREATE' AND coalesce(entity_id, '') <> '' AND k.id IS NULL THEN 'unknown entity' END AS error FROM flat f LEFT JOIN known k ON k.source_id = f.source_id AND k.id = f.entity_id)
SELECT operation, coalesce(error, 'valid') AS error, count(*) AS n FROM v GROUP BY ALL""")
def ops_validate(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return oplog.validate(ops, _known(ops)).groupBy("operation", F.coalesce("error", F.lit("valid")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LOG}, {KNOWN}, v AS (SELECT f.*, NOT (operation NOT IN ('CREATE','UPDATE','CONNECT') OR (operation = 'CREATE' AND coalesce(title, description, '') = '') OR (operation = 'UPDATE' AND coalesce(entity_id, '') = '')
 OR (operation = 'CONNECT' AND (from_id = '' OR to_id = '')) OR (operation <> 'CREATE' AND coalesce(entity_id, '') <> '' AND k.id IS NULL)) AS ok FROM flat f LEFT JOIN known k ON k.source_id = f.source_id AND k.id = f.entity_id)
SELECT source_id, count(DISTINCT chunk_index) AS chunks, count(*) AS operations, count(*) FILTER (operation = 'CREATE') AS "create", count(*) FILTER (operation = 'UPDATE') AS "update", count(*) FILTER (operation = 'CONNECT') AS connect,
 round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS success_rate FROM v GROUP BY source_id""")
def ops_summary(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return oplog.summary(oplog.validate(ops, _known(ops)))


@query(f"WITH {LOG} SELECT source_id, seq, CAST(pos AS INT) AS pos FROM ordered")
def ops_reorder(spark, sf_dir):
    return oplog.in_order(_ops(spark, sf_dir)).select("source_id", "seq", "pos")


@query(f"WITH {LOG} SELECT source_id, seq, operation FROM flat WHERE operation IN ('CREATE', 'UPDATE')")
def ops_nodes_pass(spark, sf_dir):
    return oplog.by_mode(_ops(spark, sf_dir), "nodes").select("source_id", "seq", "operation")


@query(f"WITH {LOG} SELECT source_id, id, entity_type, title, description FROM made")
def ops_create_ids(spark, sf_dir):
    return oplog.create_ids(_ops(spark, sf_dir)).select("source_id", "id", "entity_type", "title", "description")


@query(f"WITH {LOG} SELECT source_id, id, CAST(seq % 7 AS INT) AS page_number, title AS quote FROM made WHERE entity_type IN ('measure', 'indicator') AND coalesce(title, '') <> ''")
def ops_sources(spark, sf_dir):
    return oplog.source_rows(_ops(spark, sf_dir))


@query(f"""WITH {LOG}, x AS (SELECT o.source_id, o.pos, o.from_id, o.to_id, CASE WHEN o.from_id = '' OR o.to_id = '' THEN 'missing id' WHEN regexp_matches(lower(o.from_id), '^(temp|placeholder|new|created|temporary|tmp)_') THEN 'temporary source'
 WHEN regexp_matches(lower(o.to_id), '^(temp|placeholder|new|created|temporary|tmp)_') THEN 'temporary target' WHEN a.pos IS NULL OR a.pos >= o.pos THEN 'source not found' WHEN b.pos IS NULL OR b.pos >= o.pos THEN 'target not found' END AS reason
 FROM ordered o LEFT JOIN made a ON a.source_id = o.source_id AND a.id = o.from_id LEFT JOIN made b ON b.source_id = o.source_id AND b.id = o.to_id WHERE o.operation = 'CONNECT')
SELECT source_id, CAST(pos AS INT) AS pos, from_id, to_id, CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY source_id, from_id, to_id, reason IS NULL ORDER BY pos) > 1 THEN 'duplicate' ELSE 'created' END AS outcome FROM x""")
def ops_connect_outcome(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return oplog.connect_outcomes(ops, oplog.create_ids(ops)).select("source_id", "pos", "from_id", "to_id", "outcome")


@query(f"""WITH RECURSIVE {LOG}, ups AS (SELECT m.source_id, m.id, u.title, u.description, row_number() OVER (PARTITION BY m.source_id, m.id ORDER BY u.pos) AS k FROM made m JOIN ordered u ON u.source_id = m.source_id AND u.operation = 'UPDATE' AND u.entity_id = m.id AND u.pos > m.pos),
f AS (SELECT source_id, id, title, description, 0 AS k FROM made UNION ALL
 SELECT f.source_id, f.id, CASE WHEN u.title IS NULL THEN f.title WHEN f.title IS NULL THEN u.title WHEN contains(f.title, u.title) THEN f.title WHEN regexp_matches(f.title, '[.!?:;]$') THEN concat(f.title, ' ', u.title) ELSE concat(f.title, '. ', u.title) END,
  CASE WHEN u.description IS NULL THEN f.description WHEN f.description IS NULL THEN u.description WHEN contains(f.description, u.description) THEN f.description WHEN regexp_matches(f.description, '[.!?:;]$') THEN concat(f.description, ' ', u.description) ELSE concat(f.description, '. ', u.description) END, u.k
 FROM f JOIN ups u ON u.source_id = f.source_id AND u.id = f.id AND u.k = f.k + 1)
SELECT source_id, id, title, description, CAST(k AS INT) AS updates FROM f QUALIFY row_number() OVER (PARTITION BY source_id, id ORDER BY k DESC) = 1""")
def ops_merge_fields(spark, sf_dir):
    return oplog.entities(_ops(spark, sf_dir)).select("source_id", "id", "title", "description", "updates")


@query(f"""WITH {LOG} SELECT source_id, chunk_index, seq, CASE operation WHEN 'CREATE' THEN concat('CREATE ', entity_type, ': ', coalesce(title, '')) WHEN 'UPDATE' THEN concat('UPDATE ', coalesce(entity_id, ''))
 ELSE concat('CONNECT ', CASE WHEN operation = 'CONNECT' THEN concat(from_id, '->', to_id) ELSE '' END) END AS text FROM flat""")
def ops_text(spark, sf_dir):
    return oplog.describe(_ops(spark, sf_dir))


CHUNKED = "made2 AS (SELECT source_id, chunk_index, concat(CASE entity_type WHEN 'action_field' THEN 'af' WHEN 'project' THEN 'proj' WHEN 'measure' THEN 'msr' ELSE 'ind' END, '_', row_number() OVER (PARTITION BY source_id, chunk_index, entity_type ORDER BY seq)) AS id, seq AS ord FROM flat WHERE operation = 'CREATE')"


@query(f"""WITH {LOG}, {CHUNKED}, n AS (SELECT *, concat(split_part(id, '_', 1), '_', row_number() OVER (PARTITION BY source_id, split_part(id, '_', 1) ORDER BY chunk_index, ord)) AS new_id FROM made2),
e AS (SELECT source_id, chunk_index, from_id, to_id, confidence FROM flat WHERE operation = 'CONNECT')
SELECT e.source_id, e.chunk_index, a.new_id AS from_id, b.new_id AS to_id, e.confidence FROM e JOIN n a ON a.source_id = e.source_id AND a.chunk_index = e.chunk_index AND a.id = e.from_id JOIN n b ON b.source_id = e.source_id AND b.chunk_index = e.chunk_index AND b.id = e.to_id""")
def ops_merge_chunks(spark, sf_dir):
    """Entities numbered per chunk, renumbered per source, with their connections."""
    ops = _ops(spark, sf_dir)
    per_chunk = oplog.create_ids(ops.filter("operation = 'CREATE'").select("*").withColumn("title", F.lit("x")).withColumn("source_id", F.concat_ws("|", "source_id", "chunk_index")).withColumn("source_quote", F.col("seq").cast("string")))
    found = per_chunk.select(F.split_part("source_id", F.lit("|"), F.lit(1)).alias("source_id"), F.split_part("source_id", F.lit("|"), F.lit(2)).cast("int").alias("chunk_index"), "id", F.col("source_quote").cast("bigint").alias("ord"))
    edges = ops.filter("operation = 'CONNECT'").select("source_id", "chunk_index", F.col("connections")[0]["from_id"].alias("from_id"), F.col("connections")[0]["to_id"].alias("to_id"), "confidence")
    return oplog.merge_chunks(found, edges)[1]


@query("""WITH n AS (SELECT 'r' AS s, concat('af_', r_regionkey) AS id, 'action_field' AS t, CASE WHEN r_regionkey > 2 THEN concat('af_', r_regionkey - 3) END AS parent FROM region UNION ALL SELECT 'r', concat('proj_', n_nationkey), 'project', concat('af_', n_regionkey) FROM nation
 UNION ALL SELECT 'r', concat('msr_', c_custkey), 'measure', CASE WHEN c_custkey % 4 = 0 THEN concat('af_', c_nationkey % 5) ELSE concat('proj_', c_nationkey) END FROM customer)
SELECT parent AS from_id, id AS to_id, CAST(0.8 AS DOUBLE) AS confidence FROM n WHERE parent IS NOT NULL AND NOT (t = 'project' AND EXISTS (SELECT 1 FROM nation WHERE concat('proj_', n_nationkey) = n.id AND n_nationkey % 3 = 0))""")
def parent_edges(spark, sf_dir):
    nodes = adapters.sql(spark, sf_dir, """SELECT 'r' AS source_id, concat('af_', r_regionkey) AS id, 'action_field' AS entity_type, CASE WHEN r_regionkey > 2 THEN concat('af_', r_regionkey - 3) END AS parent_id FROM region
      UNION ALL SELECT 'r', concat('proj_', n_nationkey), 'project', concat('af_', n_regionkey) FROM nation
      UNION ALL SELECT 'r', concat('msr_', c_custkey), 'measure', CASE WHEN c_custkey % 4 = 0 THEN concat('af_', c_nationkey % 5) ELSE concat('proj_', c_nationkey) END FROM customer""")
    edges = adapters.sql(spark, sf_dir, "SELECT 'r' AS source_id, concat('af_', n_regionkey) AS from_id, concat('proj_', n_nationkey) AS to_id FROM nation WHERE n_nationkey % 3 = 0")
    return oplog.parent_edges(nodes, edges).drop("source_id")


#: Keywords that occur in the test documents, for the same rules.
DEMO_RULES = ((("erin", "then"), "action_field", "A", 0.9), (("keit", "lich"), "action_field", "B", 0.88), (("ciónl", "lado"), "project", "C", 0.85), (("eauou", "anst"), "project", "D", 0.82), (("ungen",), "measure", "E", 0.8), (("tionre", "elleou"), "indicator", "F", 0.87))


def _keyword_sql() -> str:
    made = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)} THEN {{'operation': 'CREATE', 'entity_type': '{e}', 'title': '{t}', 'confidence': {c}::DOUBLE}} END" for words, e, t, c in DEMO_RULES)
    return f"""WITH m AS (SELECT source, doc_id, text, list_filter([{made}], lambda x: x IS NOT NULL) AS made FROM documents),
w AS (SELECT source, list_concat(made, list_filter([CASE WHEN len(made) = 0 THEN {{'operation': 'CREATE', 'entity_type': 'action_field', 'title': 'Allgemeine Nachhaltigkeitsmaßnahmen', 'confidence': 0.7::DOUBLE}} END,
 CASE WHEN list_contains([x.entity_type FOR x IN made], 'action_field') AND list_contains([x.entity_type FOR x IN made], 'project') THEN {{'operation': 'CONNECT', 'entity_type': 'action_field', 'title': NULL::VARCHAR, 'confidence': 0.75::DOUBLE}} END], lambda x: x IS NOT NULL)) AS ops FROM m)
SELECT source, o.operation AS operation, o.entity_type AS entity_type, coalesce(o.title, '') AS title, count(*) AS n FROM (SELECT source, unnest(ops) AS o FROM w) GROUP BY ALL"""


@query(_keyword_sql())
def keyword_extractor(spark, sf_dir):
    docs = adapters.read(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("chunk_index"), "text")
    found = extract.keyword_operations(docs, DEMO_RULES)
    return found.groupBy(F.col("source_id").alias("source"), "operation", "entity_type", F.coalesce("title", F.lit("")).alias("title")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_regionkey AS region, string_agg(concat('- proj_', n_nationkey, ': ', n_name), chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey""")
def registry_text(spark, sf_dir):
    """The list of known entities that a model is given."""
    e = adapters.read(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("string").alias("source_id"), F.lit("project").alias("entity_type"), F.concat(F.lit("proj_"), F.col("n_nationkey").cast("string")).alias("id"),
        F.col("n_nationkey").alias("ord"), F.col("n_name").alias("title"), F.lit(None).cast("string").alias("description"))
    return extract.registry_text(e, detailed=True).select(F.col("source_id").cast("int").alias("region"), "text")


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS number FROM conversations")
def dialog_numbering(spark, sf_dir):
    c = adapters.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("log"), F.col("turn").alias("ts"))
    return extract.dialog_numbers(c).select(F.col("log").alias("conv_id"), F.col("ts").alias("turn"), "number")


@query("""SELECT conv_id, CAST(sum(floor(length(text) / 3.5)) AS BIGINT) AS tokens, CAST(coalesce(sum(floor(length(text) / 3.5)) FILTER (role = 'user'), 0) AS BIGINT) AS asked,
CAST(coalesce(sum(floor(length(text) / 3.5)) FILTER (role <> 'user'), 0) AS BIGINT) AS answered FROM conversations GROUP BY conv_id""")
def token_accounting(spark, sf_dir):
    c = adapters.read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "log")
    return extract.token_accounting(c, T.estimate_tokens(F.col("text"))).withColumnRenamed("log", "conv_id")


@query("""WITH e AS (SELECT concat('s', user_id % 40) AS source_id, CASE WHEN event_id % 2 = 0 THEN 'parse' ELSE 'fold' END AS stage, ts, CASE WHEN event_type IN ('signup', 'click') THEN 'start' ELSE 'end' END AS kind FROM events),
w AS (SELECT *, lead(kind) OVER x AS nk, lead(ts) OVER x AS nt FROM e WINDOW x AS (PARTITION BY source_id, stage ORDER BY ts, kind))
SELECT source_id, stage, count(*) AS starts, count(*) FILTER (nk = 'end') AS ended, round(sum(CASE WHEN nk = 'end' THEN (epoch_us(nt) - epoch_us(ts)) / 1e6 END), 3) AS seconds FROM w WHERE kind = 'start' GROUP BY source_id, stage""")
def stage_durations(spark, sf_dir):
    e = adapters.sql(spark, sf_dir, "SELECT concat('s', CAST(user_id % 40 AS STRING)) AS source_id, CASE WHEN event_id % 2 = 0 THEN 'parse' ELSE 'fold' END AS stage, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_type IN ('signup', 'click') THEN 'start' ELSE 'end' END AS kind FROM events")
    d = extract.stage_durations(e)
    return d.groupBy("source_id", "stage").agg(F.count(F.lit(1)).alias("starts"), F.count("seconds").alias("ended"), F.round(F.sum("seconds"), 3).alias("seconds"))


@query("""WITH s AS (SELECT conv_id, turn, length(concat('{"n":', turn, ',"role":"', role, '"}')) AS chars FROM conversations) SELECT conv_id, turn, CAST(chars AS INT) AS chars, CAST(floor(chars / 3.5) AS BIGINT) AS tokens, CAST(chars - coalesce(lag(chars) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS INT) AS change FROM s""")
def json_state_change(spark, sf_dir):
    c = adapters.read(spark, sf_dir, "conversations")
    s = c.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("step"), F.struct(F.col("turn").alias("n"), "role").alias("state"))
    return oplog.state_changes(s).withColumnRenamed("source_id", "conv_id").withColumnRenamed("step", "turn")


@query("""WITH w AS (SELECT s_nationkey % 5 AS r, s_suppkey AS ord, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey) AS k FROM supplier), t AS (SELECT DISTINCT c_nationkey % 5 AS r, 2 * c_custkey AS number FROM customer),
f AS (SELECT r, i AS number, row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT DISTINCT r FROM w), generate_series(1, (SELECT 2 * max(k) FROM w)) g(i) WHERE (r, i) NOT IN (SELECT r, number FROM t))
SELECT w.r AS region, w.ord AS supplier, concat('proj_', f.number) AS id FROM w JOIN f ON f.r = w.r AND f.k = w.k""")
def free_ids(spark, sf_dir):
    """An id for every supplier among those that the customers of its group have left."""
    wanted = adapters.sql(spark, sf_dir, "SELECT CAST(s_nationkey % 5 AS STRING) AS source_id, 'proj' AS prefix, s_suppkey AS ord FROM supplier")
    taken = adapters.sql(spark, sf_dir, "SELECT CAST(c_nationkey % 5 AS STRING) AS source_id, 'proj' AS prefix, 2 * c_custkey AS number FROM customer")
    return oplog.free_ids(wanted, taken).select(F.col("source_id").cast("int").alias("region"), F.col("ord").alias("supplier"), "id")


@query(f"""WITH {LOG} SELECT source_id, chunk_index, seq, operation, confidence, CASE operation WHEN 'CREATE' THEN 0.7 WHEN 'UPDATE' THEN 0.8 ELSE 0.6 END::DOUBLE AS floor FROM flat
WHERE confidence < CASE operation WHEN 'CREATE' THEN 0.7 WHEN 'UPDATE' THEN 0.8 WHEN 'CONNECT' THEN 0.6 END""")
def ops_below_floor(spark, sf_dir):
    return oplog.below_floor(_ops(spark, sf_dir)).select("source_id", "chunk_index", "seq", "operation", "confidence", "floor")


#: Customers as action fields in runs of 64, with more or fewer names a run.
FIELDS = "SELECT CAST(floor(c_custkey / 64) AS BIGINT) AS run_id, c_custkey AS ord, concat('Feld ', CAST(c_custkey * 7 % (5 + floor(c_custkey / 64) * 13 % 40) AS INT)) AS name, concat('P', c_custkey % 3) AS one, concat('Q', c_nationkey % 2) AS two FROM customer"


def _halves_sql(levels: int = 3, target: int = 20) -> str:
    seen = "min(ord) OVER (PARTITION BY run_id, half, name) AS first, min(ord) OVER (PARTITION BY run_id, half, name, title) AS seen"
    steps = [f"l0 AS (SELECT run_id, ord, name, unnest([0, 1]) AS p, unnest([one, two]) AS title FROM ({FIELDS}))", f"r0 AS (SELECT run_id, count(DISTINCT ord) AS n, CASE WHEN count(DISTINCT ord) <= {target} THEN 'small' ELSE 'open' END AS outcome FROM l0 GROUP BY 1)"]
    for k in range(levels):
        steps += [
            f"h{k} AS (SELECT l.*, dense_rank() OVER (PARTITION BY run_id ORDER BY ord) <= n // 2 AS half FROM l{k} l JOIN r{k} USING (run_id) WHERE outcome = 'open')",
            f"l{k + 1} AS (SELECT run_id, first AS ord, name, row_number() OVER (PARTITION BY run_id, first ORDER BY ord, p) AS p, title FROM (SELECT *, {seen} FROM h{k}) WHERE seen = ord)",
            f"r{k + 1} AS (SELECT run_id, m.n, CASE WHEN m.n <= {target} THEN 'done' WHEN m.n >= r{k}.n THEN 'stalled' WHEN {k + 1} = {levels} THEN 'depth' ELSE 'open' END AS outcome FROM (SELECT run_id, count(DISTINCT ord) AS n FROM l{k + 1} GROUP BY 1) m JOIN r{k} USING (run_id))",
        ]
    ends = " UNION ALL ".join(f"SELECT run_id, dense_rank() OVER (PARTITION BY run_id ORDER BY ord) - 1 AS ord, name, p, title, outcome, outcome IN ('small', 'done') AS fit FROM l{k} JOIN r{k} USING (run_id) WHERE outcome <> 'open'" for k in range(levels + 1))
    return f"""WITH {', '.join(steps)}, e AS ({ends}), f AS (SELECT *, CASE WHEN fit THEN ord ELSE min(ord) OVER (PARTITION BY run_id, name) END AS first, CASE WHEN fit THEN ord ELSE min(ord) OVER (PARTITION BY run_id, name, title) END AS seen FROM e)
SELECT run_id, CAST(first AS INT) AS ord, name AS action_field, outcome, string_agg(title, ',' ORDER BY ord, p) AS titles FROM f WHERE seen = ord GROUP BY run_id, first, name, outcome"""


@query(_halves_sql())
def aggregate_halves(spark, sf_dir):
    """Action fields joined in halves, with a model that joins equal names."""
    lists = F.array().cast("array<string>")
    project = lambda c: F.struct(F.col(c).alias("title"), lists.alias("measures"), lists.alias("indicators"))
    tree = adapters.sql(spark, sf_dir, FIELDS).select("run_id", "ord", F.col("name").alias("action_field"), F.array(project("one"), project("two")).alias("projects"))
    left, _ = halves.aggregate_halves(tree, halves.name_model)
    return left.select("run_id", "ord", "action_field", "outcome", F.array_join(F.transform("projects", lambda p: p["title"]), ",").alias("titles"))
