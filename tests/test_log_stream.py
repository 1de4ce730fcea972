"""The streamed log against the batch fold, on random logs and splits into triggers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataweave.operators import state
from strataweave.streaming import log
from tests.test_state import OPS, op

KINDS = ("action_field", "project", "measure", "indicator")


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, log.PROVIDER)
    yield spark
    spark.conf.set(key, old)


def random_log(seed, sources=3, chunks=4, size=5):
    """Operations with seconds of arrival: a chunk's come within 50 s, chunks 100 s apart."""
    r = random.Random(seed)
    out = []
    for s in range(sources):
        ids = [f"{p}_{n}" for p in ("af", "proj", "msr", "ind") for n in (1, 2)]
        for c in range(chunks):
            for n in range(size):
                kind = r.choice(("CREATE", "CREATE", "UPDATE", "CONNECT", "DROP"))
                row = dict(chunk=c, source=f"s{s}", pages=r.choice([None, [1], [1, 2]]), quote=r.choice([None, "q", " q "]))
                if kind == "CONNECT":
                    o = op(n, kind, "project", links=[(r.choice(ids), r.choice(ids), r.choice([None, 0.5, 2.0])) for _ in range(2)], **row)
                else:
                    o = op(n, kind, r.choice(KINDS), r.choice([None, {"title": f"t{r.randrange(9)}"}, {"title": "T.", "tags": [r.randrange(3)]}]), r.choice(ids) if kind == "UPDATE" else None, **row)
                out.append((*o, c * 100 + r.randrange(50)))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, f"{OPS}, t bigint").withColumn("arrived", F.timestamp_seconds("t")).drop("t")


def streamed(spark, folder, triggers, wait="60 seconds", before=None):
    """Each list of rows is one file, and one trigger; a row of another source at the end moves the watermark on."""
    end = (*op(0, "CREATE", "project", {"title": "x"}, source="~"), 10_000)
    for i, rows in enumerate([*triggers, [end], [(*end[:-1], 20_000)]]):
        table(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in/n={i:04d}")
    schema = table(spark, [end]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/n=*")
    out = f"{folder}/out"
    q = log.state_stream(stream, wait, before).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.read.parquet(out).filter("source_id <> '~'")


def rows(df):
    return sorted((r.source_id, r.kind, r.id or "", r.ord, json.dumps(json.loads(r.payload), sort_keys=True)) for r in df.collect())


@pytest.mark.parametrize(("seed", "split"), [(1, "whole"), (2, "by time"), (3, "shuffled in time")])
def test_stream_equals_fold(rocks, tmp_path, seed, split):
    some = random_log(seed)
    if split == "whole":
        triggers = [random.Random(seed).sample(some, len(some))]
    else:
        by_time = sorted(some, key=lambda o: o[-1] + (random.Random(str(o)).randrange(40) if split != "by time" else 0))
        triggers = [by_time[i : i + 13] for i in range(0, len(by_time), 13)]
    got = streamed(rocks, str(tmp_path), triggers)
    assert log.late(got).count() == 0
    assert rows(log.latest(got)) == rows(state.apply_log(table(rocks, some).drop("arrived")))


def test_late_repeated_and_earlier_state(rocks, tmp_path):
    first = state.apply_log(rocks.createDataFrame([op(0, "CREATE", "project", {"title": "A"}), op(1, "CREATE", "measure", {"title": "M"}, pages=[1], quote="q")], OPS))
    first = rocks.createDataFrame(first.collect(), first.schema)
    later = [(*op(0, "UPDATE", "project", {"title": "B"}, "proj_1", chunk=1), 10), (*op(1, "CONNECT", "project", links=[("proj_1", "msr_1", 0.7)], chunk=1), 12)]
    # chunk 1 is closed by another source's row, then an operation of chunk 0 comes, in time for the watermark but late for its chunk
    moved = (*op(0, "CREATE", "project", {"title": "x"}, source="~"), 200)
    behind = (*op(7, "CREATE", "project", {"title": "late"}, chunk=0), 250)
    got = streamed(rocks, str(tmp_path), [[*later, later[0]], [moved], [(*moved[:-1], 210)], [behind]], before=first)
    assert [(r.chunk_index, r.seq) for r in log.late(got).collect()] == [(0, 7)]
    want = state.apply_log(rocks.createDataFrame([o[:-1] for o in later], OPS), first)
    assert rows(log.latest(got, first)) == rows(want)
