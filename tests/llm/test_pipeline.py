"""The pipeline: its rows follow from its stages' decisions, each held against a plain version."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from strataweave.llm import decontaminate, quality
from tests.llm.test_small_ops import near_brute, prose


def build(spark, path):
    rng = random.Random(21)
    rare = [f"zq{i}x" for i in range(200)]
    items = [(i, " ".join(rng.choice(rare) for _ in range(30))) for i in range(6)]
    rows = [(i, prose(rng, rng.randint(60, 150))) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(10)]  # copies
    rows += [(300 + i, rows[20 + i][1] + " tail") for i in range(10)]  # near copies
    rows += [(400 + i, prose(rng, 40) + " " + items[i % 6][1] + " " + prose(rng, 20)) for i in range(12)]
    rows += [(500 + i, " ".join(rng.choice(["BUY!!", "$$$", "|", "x%%%"]) for _ in range(80))) for i in range(60)]
    rows += [(600, None), (601, "")]
    labels = [(d, int(d < 500), 0) for d, _ in rows if d is not None]
    spark.createDataFrame([(d, t, "en", "src", 1) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    path = str(tmp_path)
    rows = build(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    # Quality, by its own scores.
    scores = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{path}/labels.parquet")))
    good = {r.doc_id for r in scores.filter("predicted = 1").collect()}
    assert not any(500 <= d < 600 for d in good) and set(range(120)) <= good
    kept = [(d, t) for d, t in rows if d in good]
    # Exact copies: the largest id stays.
    last = {}
    for d, t in kept:
        last[t or ""] = max(d, last.get(t or "", -1))
    kept = [(d, t) for d, t in kept if last[t or ""] == d]
    # Near copies: the least id stays.
    least = {d: c for (d, n, c), _ in near_brute(kept).items() if n}
    kept = [(d, t) for d, t in kept if least.get(d, d) == d]
    bench = spark.read.parquet(f"{path}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(kept, "doc_id bigint, text string"), bench).collect()}
    assert bad == {d for d, _ in kept if 400 <= d < 500} and bad
    want = {d for d, _ in kept} - bad
    got = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in got.select("doc_id").collect()} == want
    per = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n <= 4096 for r in per)


def test_stages_keep_columns(spark, tmp_path):
    path = str(tmp_path)
    build(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
    empty = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0, name
    twice = docs.union(docs.limit(5))
    assert Counter(r.doc_id for r in corpus_pipeline.drop_copies(spark, twice, path).collect()).most_common(1)[0][1] == 1
