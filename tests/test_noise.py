"""Lines that hold one of many patterns, against each line and each pattern."""

import random

from pyspark.sql import functions as F

from strataweave.functions import text as T
from strataweave.operators import content


def test_held_lines_equal_all_patterns_on_all_lines(spark):
    rng = random.Random(1)
    words = ["Stadt", "Plan 2030", "Seite", "Anhang", "Über", "Klima", "x"]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(0, 5)))
    pages = [(s, n, "\n".join(line() for _ in range(rng.randint(0, 12)))) for s in ("a", "b", "c", None) for n in range(40)] + [("a", 99, None), ("a", 5, "Stadt Klima"), ("a", 5, "Stadt Klima")]
    patterns = [(s, line() or "Plan") for s in ("a", "b", None) for _ in range(60)] + [("b", "Klima Klima"), ("z", "Stadt"), ("a", None)]
    df = spark.createDataFrame(pages, "source_id string, page_number int, text string")
    known = spark.createDataFrame(patterns, "source_id string, pattern string")
    own = {s: {p for x, p in patterns if x == s and p is not None} for s in ("a", "b", "c")}
    forms = df.where("text is not null and source_id is not null").select("source_id", "page_number", "text", F.transform(F.split("text", r"\R"), T.page_line).alias("lines")).collect()
    want = sorted((r.source_id, r.page_number, r.text, [any(p in x for p in own[r.source_id]) for x in r.lines]) for r in forms)
    for cell in (5000, 7):
        got = content.held_lines(df.where("text is not null and source_id is not null"), known, cell).collect()
        assert sorted(map(tuple, got)) == want


def test_noise_goes_and_short_pages_stay(spark):
    body = "Eine Zeile mit genug Text, damit die Seite auch ohne Kopf lang genug bleibt, und noch etwas mehr davon hier."
    pages = [("s", 1, f"Kopfzeile der Stadt\n{body}\n\nSeite 3 von 9\nFuß"), ("s", 2, "Kopfzeile der Stadt\nkurz"), ("t", 1, f"Kopfzeile der Stadt\n{body}"), ("s", 3, None), (None, 1, f"Seite 4\n{body}")]
    df = spark.createDataFrame(pages, "source_id string, page_number int, text string")
    pattern = df.limit(1).select(T.page_line(F.lit("Kopfzeile der Stadt")).alias("p")).head()["p"]
    got = {(r.source_id, r.page_number): r.text for r in content.without_noise(df, spark.createDataFrame([("s", pattern)], "source_id string, pattern string")).collect()}
    assert got == {("s", 1): f"{body}\n\nFuß", ("s", 2): pages[1][2], ("t", 1): pages[2][2], ("s", 3): None, (None, 1): body}


def test_texts_are_dealt_over_tasks_and_not_ordered_by_source(spark, tmp_path):
    """One file of one row group: texts leave the task that reads it before they are worked on, and only keys are numbered source by source."""
    from strataweave.operators import chunking, content
    from strataweave.plans import content_queries

    rows = [(i // 2 if i % 5 == 0 else i, f"text {i} " + "der Hund " * (i % 4), None if i % 7 == 0 else f"s{i % 3}") for i in range(60)] + [(None, None, "s1")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    pages = content_queries._pages(spark, str(tmp_path))
    assert "row_number() windowspecdefinition(source" not in plan(pages)
    numbers = {}
    for r in pages.collect():
        numbers.setdefault(r.source_id, []).append((r.page_number, r.text))
    for source, got in numbers.items():
        own = sorted(((d is not None, d or 0, t or "") for d, t, s in rows if s == source))
        assert [n for n, _ in sorted(got, key=lambda x: x[0])] == list(range(1, len(own) + 1))
        ids = {t: d for d, t, s in rows if s == source}
        in_order = [ids[t] for _, t in sorted(got, key=lambda x: x[0]) if t is not None]
        assert in_order == sorted(in_order)
    docs = content_queries._docs(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() >= 64
    assert not any("Filter" in line and "regexp_replace" in line for line in plan(content.exact_repetition(docs)).splitlines())
    chunks = spark.createDataFrame([(s, i, f"{i}. Satz. " * 20, [i]) for s in ("a", None) for i in (0, 2, 5)], "source_id string, chunk_index int, text string, pages array<int>")
    lapped = {(r.source_id, r.chunk_index): r.text for r in chunking.with_overlap(chunks).collect()}
    for s in ("a", None):
        assert lapped[s, 0].endswith("[OVERLAP_START]\n" + ("2. Satz. " * 3).strip() + "\n[OVERLAP_END]") and lapped[s, 5] == "5. Satz. " * 20
