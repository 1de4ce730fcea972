"""Resolution of nested extractions, published imputation, ids."""

import hashlib

from pyspark.sql import functions as F

from strataweave.operators import oplog, resolve

PROJECT = "struct<title:string,measures:array<string>,indicators:array<string>,sources:array<struct<page_number:int,quote:string>>>"
TREE = f"run_id string, ord bigint, action_field string, projects array<{PROJECT}>"


def project(title, measures=(), indicators=(), sources=()):
    return title, list(measures), list(indicators), list(sources)


def rows(tree):
    return [(r.action_field, [(p.title, p.measures, p.indicators, [tuple(s) for s in p.sources]) for p in r.projects]) for r in tree.orderBy("run_id", "ord").collect()]


def test_rules_merge_fields_and_their_projects(spark):
    tree = spark.createDataFrame([
        ("r", 0, "Klimaschutz", [project("Solar", ["a"], ["x"], [(1, "q")])]),
        ("r", 1, "Bildung", [project("Schule")]),
        ("r", 2, "Klimaanpassung", [project("Solar", ["b", "a"], [], [(1, "q"), (2, "q")]), project("Wald", ["c"])]),
        ("t", 0, "Klimaschutz", []),
    ], TREE)
    got = rows(resolve.resolve(tree, projects=False))
    assert got == [
        ("Klimaanpassung", [("Solar", ["a", "b"], ["x"], [(1, "q"), (2, "q")]), ("Wald", ["c"], [], [])]), ("Bildung", [("Schule", [], [], [])]), ("Klimaschutz", []),
    ]


def test_similar_names_merge_if_they_may(spark):
    names = [("Radverkehr", [1.0, 0.0]), ("Radverkehr Stadt", [0.9, 0.3]), ("Hafen", [0.95, 0.2]), ("Fernweh", [0.7, 0.7]), ("Kultur", [0.0, 1.0])]
    vectors = spark.createDataFrame(names, "name string, v array<double>")
    tree = spark.createDataFrame([("r", i, n, []) for i, (n, _) in enumerate(names)], TREE)
    got = resolve.candidate_groups(resolve.positions(tree), vectors).collect()
    # Hafen is over 0.9 and merges at once; Fernweh is similar, but shares no word; the longest name stays.
    assert [(r.names, r.keep) for r in got] == [(["Radverkehr", "Radverkehr Stadt", "Hafen"], "Radverkehr Stadt")]
    assert [f for f, _ in rows(resolve.resolve(tree, vectors))] == ["Radverkehr Stadt", "Fernweh", "Kultur"]


def test_projects_merge_as_published_or_whole(spark):
    tree = spark.createDataFrame([("r", 0, "A", [project("Rad", ["a"]), project("Radweg", ["b"]), project("Rad", ["c"]), project("Bus", ["d"])])], TREE)
    groups = spark.createDataFrame([("r", ["Rad", "Radweg"], "Radweg")], "run_id string, names array<string>, keep string")
    assert rows(resolve.merge_projects(tree, groups)) == [("A", [("Radweg", ["a", "b"], [], []), ("Bus", ["d"], [], [])])]
    assert rows(resolve.merge_projects(tree, groups, all_details=True)) == [("A", [("Radweg", ["a", "b", "c"], [], []), ("Bus", ["d"], [], [])])]


def test_published_imputation(spark):
    df = spark.createDataFrame([
        ("r", "Klima und Energie", "Solar für Verkehr", [], []), ("r", "Klima", "Reduktion", ["m"], []), ("r", "Mobilität", "Radbahn", [], ["i"]),
        ("r", "Wohnen", "Haus", [], []), ("r", "Kultur", "Oper", [], None), ("r", "Klima", "Anderes", [], []),
    ], "run_id string, action_field string, title string, measures array<string>, indicators array<string>")
    improved = resolve.improve(df)
    got = {r.title: r for r in improved.collect()}
    assert got["Solar für Verkehr"].measures == ["Installation von Solaranlagen", "Förderung erneuerbarer Energien", "Förderung emissionsarmer Mobilität"]
    assert got["Solar für Verkehr"].indicators[0] == "Installierte Solarkapazität in MW"
    assert got["Reduktion"].measures == ["m"] and got["Reduktion"].indicators == ["CO2-Reduktion um 30% bis 2030", "Energieverbrauch-Reduktion um 20%"]
    assert got["Radbahn"].measures == ["Ausbau des Radwegenetzes", "Verbesserung der Fahrradinfrastruktur", "Modernisierung des öffentlichen Nahverkehrs"]
    assert got["Radbahn"].indicators == ["i"] and got["Haus"].measures[0] == "Entwicklung nachhaltiger Wohnkonzepte"
    assert got["Oper"].measures == ["Entwicklung von Konzepten für Oper", "Umsetzung von Maßnahmen im Bereich Kultur", "Koordination und Monitoring des Projekts Oper"]
    assert got["Oper"].indicators[-1] == "Projektabschluss bis Ende 2026" and got["Anderes"].measures[0] == "Entwicklung von Konzepten für Anderes"
    r = resolve.improvement_report(df, improved).first()
    assert (r.no_measures_before, r.no_indicators_before, r.no_measures, r.no_indicators) == (5, 5, 0, 0) and r.recovered_measures == 3 + 3 + 3 + 3 + 3


def test_ids_beyond_the_last_number_are_hashes(spark, monkeypatch):
    monkeypatch.setattr(oplog, "LAST_NUMBER", 3)
    wanted = spark.createDataFrame([("s", "af", i, t) for i, t in enumerate(["a", "b", "c", "c", "d"])], "source_id string, prefix string, ord int, title string")
    taken = spark.createDataFrame([("s", "af", 2)], "source_id string, prefix string, number int")
    mark = {t: hashlib.md5(t.encode()).hexdigest()[:4] for t in "cd"}
    got = [r.id for r in oplog.free_ids(wanted, taken).orderBy("ord").collect()]
    assert got == ["af_1", "af_3", f"af_{mark['c']}", f"af_{mark['c']}_1", f"af_{mark['d']}"]
    assert [r.id for r in oplog.free_ids(wanted.drop("title"), taken).orderBy("ord").collect()] == ["af_1", "af_3", "af_4", "af_5", "af_6"]


def test_merge_rule_in_both_forms(spark):
    pairs = [("Rad", "Radweg", 0.7), ("Rad", "Bahn", 0.7), ("Rad", "Bahn", 0.95), ("Bau der Bahn", "Bau der Tram", 0.7), ("x", "y z", 0.1)]
    df = spark.createDataFrame(pairs, "a string, b string, s double")
    got = [r[0] for r in df.select(resolve.merge_allowed(F.col("a"), F.col("b"), F.col("s"))).collect()]
    assert got == [resolve._may_merge(*p) for p in pairs] == [True, False, True, True, False]


def test_a_failed_resolution_keeps_the_names(spark):
    tree = spark.createDataFrame([("r", 0, "Klimaschutz", []), ("r", 1, "Klimaanpassung", [])], TREE)
    broken = spark.createDataFrame([("Klimaschutz", "x")], "name string, v string")
    assert resolve.resolve_or_keep(tree).count() == 1
    assert resolve.resolve_or_keep(tree.withColumn("action_field", F.concat("action_field", F.lit("!"))), broken.withColumn("name", F.lit("Klimaschutz!"))).count() == 2


def test_consistency_counts_fields_without_projects(spark):
    df = spark.createDataFrame([("r", "A", "P", ["m"], []), ("r", "B", None, None, None)], "run_id string, action_field string, title string, measures array<string>, indicators array<string>")
    c = resolve.consistency(df).first()
    assert (c.projects, c.without_projects, c.no_measures, c.no_indicators, c["mean"], c.mean_indicators) == (1, 1, 0, 1, 1.0, 0.0)


def test_quotes_are_looked_up_in_texts_that_left_the_task_that_read_them(spark, tmp_path, monkeypatch):
    from strataweave.plans import resolution_queries

    spark.createDataFrame([(i, f"One  two three four five six {i % 2}") for i in range(9)], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "two three four five six 1"), (2, "two three four five six 7")], "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    plans = []
    real = resolution_queries.materialize
    monkeypatch.setattr(resolution_queries, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    found = resolution_queries.quote_exact_match(spark, str(tmp_path))
    assert len(plans) == 1 and "Repartition" in plans[0] and "explode" in plans[0].split("Repartition")[0]
    assert [tuple(r) for r in found.collect()] == [(1, 4)]
