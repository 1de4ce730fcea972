"""String functions against plain Python, and pages, graphs, reports end to end."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataweave.config import Config
from strataweave.functions import text as T
from strataweave.operators import chunking, content, graph, oplog, resolve
from strataweave.plans import analyze, resolution_queries
from strataweave.sources import graphs, pages, sinks
from strataweave.streaming import fold


def values(spark, column, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[1] for r in df.select("i", column(F.col("x"))).orderBy("i").collect()]


def test_strip_and_squeeze_are_unicode(spark):
    items = ["  a b \n", "", None, "\x1fx"]
    assert values(spark, T.strip, items) == ["a b", "", None, "x"]
    assert values(spark, T.squeeze, items) == ["a b", "", None, "x"]


def test_tokens_and_comparison_form(spark):
    assert values(spark, T.estimate_tokens, ["", None, "a" * 7, "a" * 8]) == [0, 0, 2, 2]
    assert values(spark, T.compare_form, ["Die  Straße, und die Häuser!", "a a b"]) == ["straße häuser", "a a b"]


def test_headings(spark):
    items = ["1.2 Ziele", "IV. Teil", "a) Punkt", "Kapitel eins", "ÜBERSICHT", "Große Ziele", "so etwas:", "ein satz ohne alles", "ab", "Ab"]
    assert values(spark, T.is_heading, items) == [True] * 7 + [False, False, False]


def test_canonical_names(spark):
    items = ["klimaschutz", "Klima und Anpassung", "Verkehr", "Verkehr und Mobilität", "Wirtschaft & Wissenschaft", "Erneuerbare Energie", "Anderes"]
    want = ["Klimaschutz und Klimaanpassung", "Klimaschutz und Klimaanpassung", "Verkehr", "Mobilität und Verkehr", "Wirtschaft und Wissenschaft", "Energie", "Anderes"]
    assert values(spark, T.canonical_name, items) == want


def test_clean_text(spark):
    raw = "* Punkt\nSeite 3 von 9\n12\n1) https://x.y/z\nVer-\nkehr und\nweiter.\n\nNeu  hier"
    assert values(spark, T.clean, [raw])[0].endswith("Verkehr und weiter.\nNeu hier")
    assert values(spark, T.clean, ["a.\n\nB"]) == ["a.\nB"]


def test_sizes_and_durations(spark):
    df = spark.range(1)
    assert df.select(T.file_size(F.lit(512)), T.file_size(F.lit(2048)), T.file_size(F.lit(3 << 20))).first()[:] == ("512 B", "2.0 KB", "3.0 MB")
    assert df.select(T.duration(F.lit(0.5)), T.duration(F.lit(5.25)), T.duration(F.lit(65.0))).first()[:] == ("500ms", "5.3s", "1m 5.0s")


def test_merge_rules(spark):
    df = spark.createDataFrame([("a", "b"), ("a.", "b"), ("abc", "b"), (None, "b"), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(oplog.merge_text(F.col("x"), F.col("y"))).collect()] == ["a. b", "a. b", "abc", "b", "a"]
    one = spark.range(1)
    assert one.select(oplog.merge_list(F.array(F.lit("a"), F.lit("a")), F.array(F.lit("b"), F.lit("a"), F.lit("b")))).first()[0] == ["a", "a", "b"]


def test_pages_in_both_formats(spark):
    files = spark.createDataFrame([("s", "\n\n[Page 1]\n\nEins\n\n[Page 2]\n\n \n\n[Page 3]\n\nDrei"), ("t", "=== Page 7 ===\nx\ny\n=== Page 7 ===\nz")], "source_id string, value string")
    got = {(r.source_id, r.page_number): r.text for r in pages.split_pages(files).collect()}
    assert got == {("s", 1): "Eins", ("s", 3): "Drei", ("t", 7): "z"}


def test_page_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("doc", 1, "one"), ("doc", 2, "two")], "source_id string, page_number int, text string")
    sinks.write_pages(rows, str(tmp_path / "out"))
    text = next((tmp_path / "out").rglob("*.txt")).read_text()
    (tmp_path / "doc_pages.txt").write_text(text)
    got = pages.read_pages(spark, str(tmp_path / "doc_pages.txt"))
    assert [(r.source_id, r.page_number, r.text) for r in got.orderBy("page_number").collect()] == [("doc", 1, "one"), ("doc", 2, "two")]


def test_table_markdown(spark):
    df = spark.range(1)
    cell = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    text = df.select(pages.table_markdown(cell([["A", "B"], ["1", "2"]]))).first()[0]
    assert text == "| A | B |\n| --- | --- |\n| 1 | 2 |"
    assert df.select(pages.table_markdown(cell([["1", "2"], ["3", "4"]]))).first()[0] == "| 1 | 2 |\n| 3 | 4 |"
    named = df.select(pages.table_markdown(cell([["1", "2"], ["3", "4"]]), F.array(F.lit("X"), F.lit("Y"), F.lit("Z")))).first()[0]
    assert named.splitlines()[2] == "| 1 | 2 |  |"


GRAPH = {
    "action_fields": [{"id": "af_1", "content": {"title": "Mobilität"}, "connections": [{"target_id": "proj_1", "confidence_score": 0.9}]}],
    "projects": [{"id": "proj_1", "content": {"title": "Stadtbahn"}, "connections": [{"target_id": "af_1", "confidence_score": 0.9}, {"target_id": "msr_1", "confidence_score": 0.8}]}],
    "measures": [{"id": "msr_1", "content": {"title": "Ausbau", "description": "Ausbau der Bahn"}, "connections": [{"target_id": "proj_1", "confidence_score": 0.8}], "sources": [{"page_number": 1, "quote": "Bahn"}]}],
    "indicators": [{"id": "ind_1", "content": {"title": "Fahrgäste", "description": "Zahl der Fahrgäste"}, "connections": [{"target_id": "proj_1", "confidence_score": 0.7}, {"target_id": "gone", "confidence_score": 0.5}]}],
}
TREE = {"action_fields": [{"action_field": "A", "projects": [{"title": "P", "measures": ["M"], "indicators": ["I"]}]}]}


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(GRAPH), encoding="utf-8")
    (tmp_path / "t.json").write_text(json.dumps(TREE))
    (tmp_path / "e.json").write_text('{"action_fields": []}')
    g = graphs.read_graphs(spark, str(tmp_path))
    assert {r.run_id.rsplit("/", 1)[1]: r.layout for r in g.collect()} == {"g.json": "EnrichedReviewJSON", "t.json": "ExtractionResult", "e.json": "empty"}
    nodes = graph.build_nodes(graphs.entities(g))
    edges = graph.build_edges(nodes, graphs.connections(g))
    assert nodes.count() == 4 and edges.count() == 3
    n, e = graph.hierarchical_nodes_edges(graphs.trees(g))
    assert n.count() == 4 and e.count() == 3
    scores = {r.run_id.rsplit("/", 1)[1]: r for r in analyze.analyze(spark, str(tmp_path / "g.json")).collect()}
    assert scores["g.json"].penalty == 2.0 and 0 <= scores["g.json"].score <= 100
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        graphs.read_graphs(spark, str(tmp_path), strict=True)
    assert graphs.read_graphs(spark, str(tmp_path / "none")).count() == 0


def test_reports(spark):
    s = spark.createDataFrame([("r1", 91.0, "A", 90.0), ("<r2>", 50.0, "F", 40.0)], "run_id string, score double, grade string, integrity double")
    assert "r1: 91.0 (A)" in sinks.terminal_report(s, verbose=True)
    assert "&lt;r2&gt;" in sinks.html_report(s)
    assert json.loads(sinks.render('{"a": 1}', "json")) == {"a": 1}
    with pytest.raises(NotImplementedError):
        sinks.render("{}", "markdown")


def test_config_round_trip():
    assert Config.from_json(Config().to_json()) == Config()
    assert abs(sum(Config(weights={"a": 1.0, "b": 3.0}).shares().values()) - 1) < 1e-9


def test_chunks_keep_all_text_in_order(spark):
    texts = ["x" * n for n in (100, 3000, 5200, 9000, 50, 7000, 900, 8200)]
    df = spark.createDataFrame([("s", i + 1, t) for i, t in enumerate(texts)], "source_id string, page_number int, text string")
    got = chunking.pack_pages(df).orderBy("chunk_index").collect()
    assert "".join(r.text.replace("\n", "") for r in got) == "".join(texts)
    assert sorted(p for r in got for p in r.pages) == list(range(1, 9))
    headed = chunking.with_header(chunking.pack_pages(df)).orderBy("chunk_index").collect()
    assert all(r.text.startswith("=" * 80 + "\nDOKUMENT: Dokument\nSEITEN: ") for r in headed)


def plain_pack(sizes, most=8000, least=1500):
    """Chunks of page numbers, by lists."""
    out, now, size = [], [], 0
    for i, n in enumerate(sizes):
        if now and n > most:
            out += [(now, size), ([i], n)]
            now, size = [], 0
        elif now and size + n + 2 <= most:
            now, size = [*now, i], size + n + 2
        else:
            out += [(now, size)] if now else []
            now, size = [i], n
    out += [(now, size)] if now else []
    final = []
    for own, n in out:
        if n < least and final and final[-1][1] + n + 2 <= most:
            final[-1] = (final[-1][0] + own, final[-1][1] + n + 2)
        else:
            final.append((own, n))
    return [own for own, _ in final]


@pytest.mark.parametrize("seed", range(3))
def test_packing_equals_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": [rng.choice([5, 300, 1200, 4000, 7990, 8000, 8001, 20000]) for _ in range(rng.randint(1, 60))] for k in range(4)}
    rows = [(k, i, "y" * n) for k, own in sizes.items() for i, n in enumerate(own)]
    df = spark.createDataFrame(rows, "source_id string, page_number int, text string").repartition(5)
    got = {k: [] for k in sizes}
    for r in chunking.pack_pages(df).orderBy("source_id", "chunk_index").collect():
        assert r.chunk_index == len(got[r.source_id])
        got[r.source_id].append(r.pages)
    assert got == {k: plain_pack(own) for k, own in sizes.items()}


@pytest.mark.parametrize(
    ("own", "follow", "tail"),
    [
        ("a" * 100, "One twos. Three four five six", "One twos."),  # 15 characters: the sentence end is past the half
        ("a" * 100, "Only. words without an end here", "Only. words wit"),  # the end is before the half
        ("a" * 100, "One tw\n\nmore words that follow", "One tw"),  # a paragraph past the 30 %
        ("a" * 100, "One two! X. Yes and so on", "One two! X."),  # full stops are tried first
        ("a" * 100, "short", None),
        ("a" * 6, "One two. Three", None),
    ],
)
def test_overlap(spark, own, follow, tail):
    df = spark.createDataFrame([("s", 0, own, [1]), ("s", 1, follow, [2])], "source_id string, chunk_index int, text string, pages array<int>")
    got = [r.text for r in chunking.with_overlap(df).orderBy("chunk_index").collect()]
    assert got == [own if tail is None else f"{own}\n\n[OVERLAP_START]\n{tail}\n[OVERLAP_END]", follow]


def test_first_chunks(spark):
    df = spark.range(5).select(F.col("id").alias("chunk_index"))
    assert chunking.first_chunks(df, 2).count() == 2 and chunking.first_chunks(df, 0).count() == 5


def test_noise_lines_go(spark):
    body = lambda i: "\n".join(f"Inhalt {chr(97 + i)}{chr(97 + j)} {'abc ' * 20}" for j in range(6))
    df = spark.createDataFrame([("s", i, f"Stadt Musterhausen Bericht\n{body(i)}\nSeite {i}") for i in range(1, 9)], "source_id string, page_number int, text string")
    out = content.without_noise(df, content.headers_footers(df, floor=2)).collect()
    assert all("Musterhausen" not in r.text and "Seite" not in r.text and "Inhalt" in r.text for r in out)


def test_star_groups_and_registry(spark):
    names = spark.createDataFrame([("r", "b", n, i) for i, n in enumerate(["Radweg", "Radwege", "Bahn", "radweg", "Radwegnetz"])], "run_id string, bucket string, name string, ord bigint")
    stars = {r.name: r.star for r in resolve.star_groups(names).collect()}
    assert stars == {"Radweg": 0, "Radwege": 0, "Bahn": 2, "radweg": 0, "Radwegnetz": 0}
    reg = {r.name: r.canonical for r in resolve.register(names.withColumnRenamed("bucket", "kind")).collect()}
    assert reg["radweg"] == "Radweg" and reg["Bahn"] == "Bahn"
    stats = resolve.registry_statistics(resolve.register(names.withColumnRenamed("bucket", "kind"))).first()
    assert stats.seen - stats.canonical == stats.merged and stats.recent_merges.startswith("Radwege -> Radweg; radweg -> Radweg")


def test_fuzzy_quotes(spark):
    q = spark.createDataFrame([(1, 1, "der Ausbau der Bahn"), (2, 1, "der Ausbau der Bann"), (3, 1, "ganz andere Worte hier"), (4, 9, "x")], "q_id int, page int, quote string")
    p = spark.createDataFrame([(1, "Text. Der Ausbau der Bahn beginnt.")], "page int, text string")
    assert {r.q_id: r.outcome for r in resolve.fuzzy_quote(q, p).collect()} == {1: "exact", 2: "fuzzy", 3: "no_match", 4: "page_not_found"}


def test_stream_equals_batch(spark, tmp_path):
    kinds = list(oplog.PREFIX)
    ops = [(f"s{i % 3}", i // 20, i, "CREATE" if i % 3 else "UPDATE", kinds[i % 4], f"t{i}" if i % 7 else None, None, i) for i in range(120)]
    schema = "source_id string, chunk_index int, seq bigint, operation string, entity_type string, title string, description string, t bigint"
    df = spark.createDataFrame(ops, schema).withColumn("arrived", F.timestamp_seconds("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = fold.created_stream(stream).writeStream.format("memory").queryName("made").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.source_id, r.id, r.seq) for r in spark.table("made").collect()}
    batch = oplog.create_ids(df.withColumns({"tags": F.array().cast("array<string>"), "confidence": F.lit(1.0), "source_pages": F.array().cast("array<int>"), "source_quote": F.lit(None).cast("string")}))
    want = {(r.source_id, r.id) for r in batch.collect()}
    assert {(a, b) for a, b, _ in got} == want and len(got) == len(want)


def test_models_are_asked_again_and_answers_parsed(spark):
    from strataweave.operators import extract

    chunks = spark.createDataFrame([("s", i) for i in range(4)], "source_id string, chunk_index int")
    chunks = extract.prompts(chunks, 'Read {what}: {"year": 1}', what=F.col("chunk_index").cast("string"))

    def client():
        tries = {}

        def send(prompt):
            tries[prompt] = tries.get(prompt, 0) + 1
            assert '{"year": 1}' in prompt
            if "Read 0" in prompt:
                return None
            if "Read 1" in prompt and tries[prompt] < 3:
                raise OSError
            if "Read 3" in prompt:
                return "no json"
            return '<think>hm</think>```json\n{"operations": [{"operation": "CREATE", "entity_type": "project", "content": {"title": "T"}}, {"page": 3}]}\n```'

        return send

    ops, bad = extract.answered_operations(extract.ask(chunks.coalesce(1), client))
    assert [(r.chunk_index, r.operation, r.content["title"]) for r in ops.orderBy("chunk_index").collect()] == [(1, "CREATE", "T"), (2, "CREATE", "T")]
    assert {r.chunk_index for r in bad.collect()} == {0, 3}


def test_prompt_files(tmp_path):
    from strataweave.sources import prompts

    (tmp_path / "ops.json").write_text('{"nodes": {"user": "Use {x} and {\\"y\\": 1}"}}')
    assert prompts.lookup(str(tmp_path), "ops.nodes.user", x="1") == 'Use 1 and {"y": 1}'
    assert prompts.names(str(tmp_path)) == ["ops"]
    for bad, error in (("ops.nodes", ValueError), ("ops.nodes.none", KeyError)):
        with pytest.raises(error):
            prompts.lookup(str(tmp_path), bad)
    (tmp_path / "core.yaml").write_text("thinking_modes:\n  analytical: Think first.\n")
    assert prompts.names(str(tmp_path)) == ["core", "ops"]
    assert prompts.thinking(str(tmp_path), "Ask") == "Think first.\n\nAsk"
    with pytest.raises(ValueError):
        prompts.thinking(str(tmp_path), "Ask", "none")
    with pytest.raises(FileNotFoundError):
        prompts.lookup(str(tmp_path), "none.a.b")
    prompts.clear()


def test_triage(spark):
    from strataweave.operators import quality

    m = spark.createDataFrame([("r", 1, 60, 0.6, 6, 2, 1, 3), ("t", 0, 5, 0.1, 1, 0, 0, 0)], "run_id string, dangling int, duplicate_texts int, repetition double, components int, missing_sources int, ambiguous int, isolated int")
    got = {(r.run_id, r.rule): r.severity for r in quality.severity(m).collect()}
    assert got == {("r", k): s for k, s in (("dangling", "critical"), ("duplicate_texts", "critical"), ("repetition", "critical"), ("components", "critical"), ("missing_sources", "minor"), ("ambiguous", "minor"), ("isolated", "minor"))} | {("t", "duplicate_texts"): "minor"}
    assert {r.rule for r in quality.severity(m, verbose=False).collect()} & {"missing_sources", "isolated"} == set()


def test_flat_columns_and_attribution(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.struct(F.lit(2).alias("b")).alias("c")).alias("r"), F.lit(3).alias("z"))
    assert T.flat_columns(df).columns == ["r.a", "r.c.b", "z"]
    m = spark.range(1).select(T.with_pages(F.create_map(F.lit("t"), F.lit("x")), F.array(F.lit(3), F.lit(1)))).first()[0]
    assert m == {"t": "x", "page_attribution": "Seiten 1, 3"}


def test_top_similar_of_more_than_ten_thousand_queries(spark):
    v = spark.range(40).select("id", F.array(F.cos(F.col("id") / 7), F.sin(F.col("id") / 7)).alias("v"))
    q = spark.range(10_050).select(F.col("id").alias("q"), F.array(F.cos(F.col("id") % 40 / 7), F.sin(F.col("id") % 40 / 7)).alias("v"))
    got = {(r.q, r.rank): r.id for r in resolve.top_similar(v, q, 2).collect()}
    assert len(got) == 2 * 10_050
    assert got[10_040, 1] == 0 and got[10_040, 2] == 1  # the same angle as 10,040 % 40, then the next
    assert got[0, 1] == 1 and got[0, 2] == 2  # a query is not its own neighbour


def test_quotes_are_sought_in_whole_documents(spark, tmp_path):
    long = "Viele andere Worte stehen davor. " * 40
    items = [(0, "take all the words of one quote"), (1, "words that stand in none"), (2, "words as they are"), (3, "a quote without document")]
    texts = [(0, f"{long} Take all the words of one quote. {long}"), (3, long), (6, f"{long} Words as they are."), (7, "else")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.q_id: r.outcome for r in resolution_queries.quote_fuzzy_match(spark, str(tmp_path)).collect()}
    assert got == {0: "fuzzy", 1: "no_match", 2: "exact", 3: "page_not_found"}
