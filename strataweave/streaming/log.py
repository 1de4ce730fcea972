"""The whole operation log as a stream: CREATE, UPDATE and CONNECT on a state that Spark keeps between triggers.

A chunk's operations are one batch (`operators.state`), so they wait, in map state, until the chunk is complete: a timer of event time fires when the
watermark has passed the chunk's last arrival by `wait`. Chunks of a source close in order; a chunk that is due waits for earlier ones that still
get operations. What comes for a chunk that is behind a closed one is not applied, but given out as a row of kind 'late'. So however the log
is split into triggers, and in whatever order its rows come within `wait`, `latest` of the stream equals `apply_log` of the whole log.

State by source: waiting operations, one row per entity, connection and source (only changed rows are written), three numbers. A task holds one
source's state while one of its chunks closes, as the batch fold does. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strataweave.operators.state import ROWS, Fold, operation_json, parse_operation

OUT = f"{ROWS}, version bigint"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
RANK = {"entity": 0, "connection": 1, "source": 2}
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LogFold(StatefulProcessor):
    """One source's log; `wait` in milliseconds."""

    def __init__(self, wait: int, validated: bool):
        self.wait, self.validated = wait, validated

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "chunk bigint, seq bigint", "payload string, arrived bigint")
        self.kept = handle.getMapState("kept", "kind string, id string, ord bigint", "payload string")
        self.numbers = handle.getValueState("numbers", "closed bigint, results bigint, version bigint")  # the last chunk that closed

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for r in initialState.itertuples(index=False):
            self.kept.updateValue((r.kind, r.id, int(r.ord)), (r.payload,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        closed, _, version = self._numbers()
        late, due = [], set()
        for frame in rows:
            for r in frame.itertuples(index=False):
                at = int(r.chunk_index), int(r.seq)
                if closed is not None and at[0] <= closed:
                    late.append((key[0], "late", str(at[0]), at[1], r.payload, version))
                elif not self.waiting.containsKey(at):  # a repeated operation counts once
                    self.waiting.updateValue(at, (r.payload, int(r.ms)))
                    due.add(int(r.ms) + self.wait)
        for t in due:
            self.handle.registerTimer(t)
        yield pd.DataFrame(late, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted((int(k[0]), int(k[1]), v[0], int(v[1])) for k, v in self.waiting.iterator())
        ready = []
        for chunk, own in groupby(waiting, key=lambda w: w[0]):
            ops = list(own)
            if max(w[3] for w in ops) + self.wait > now:
                break
            ready.append((chunk, ops))
        yield pd.DataFrame(self._close(key[0], ready) if ready else [], columns=COLUMNS)

    def _numbers(self) -> tuple[int | None, int, int]:
        return tuple(self.numbers.get()) if self.numbers.exists() else (None, 0, 0)

    def _close(self, source: str, ready: list) -> list[tuple]:
        _, results, version = self._numbers()
        fold = Fold(source)
        before = {(k[0], k[1], int(k[2])): v[0] for k, v in self.kept.iterator()}
        for kind, id_, ord_ in sorted(before, key=lambda k: (RANK[k[0]], k[2], k[1])):
            fold.load(kind, id_, json.loads(before[kind, id_, ord_]))
        for chunk, ops in ready:
            (fold.apply_valid if self.validated else fold.apply)([parse_operation(w[2]) for w in ops], chunk)
            for w in ops:
                self.waiting.removeKey((w[0], w[1]))
        out, done = [], 0
        for _, kind, id_, ord_, payload in fold.rows():
            if kind == "result":
                out.append((source, kind, id_, results + ord_, payload, version + 1))
                done += 1
            elif before.get((kind, id_, ord_)) != payload:
                self.kept.updateValue((kind, id_, ord_), (payload,))
                out.append((source, kind, id_, ord_, payload, version + 1))
        self.numbers.update((ready[-1][0], results + done, version + 1))
        return out

    def close(self) -> None:
        pass


def state_stream(ops: DataFrame, wait: str = "1 hour", before: DataFrame | None = None, validated: bool = True) -> DataFrame:
    """Changes of the state as a stream: source_id, kind, id, ord, payload, version; a row replaces that with its source_id, kind, id and ord.

    ops: a stream with the columns of `apply_log` and `arrived`, a timestamp. `wait`, in the words of an interval, is how long after its last
    operation a chunk stays open, and the watermark's delay. Rows behind the watermark are left out by Spark, which counts them in its
    progress. `before`: a state to go on from, as `apply_log` returns it. Rows without source, chunk, number or arrival cannot be placed and are left out.
    """
    spark = ops.sparkSession
    length = spark.sql(f"SELECT CAST(unix_millis(TIMESTAMP '1970-01-01 00:00:00 UTC' + INTERVAL {wait}) AS BIGINT) AS ms").first().ms
    rows = ops.filter("source_id IS NOT NULL AND chunk_index IS NOT NULL AND seq IS NOT NULL AND arrived IS NOT NULL").withWatermark("arrived", wait)
    rows = rows.select("source_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("seq").cast("bigint").alias("seq"), operation_json().alias("payload"), "arrived", F.unix_millis("arrived").alias("ms"))
    known = None if before is None else before.filter(F.col("kind").isin(*RANK)).select("source_id", "kind", "id", "ord", "payload").groupBy("source_id")
    return rows.groupBy("source_id").transformWithStateInPandas(LogFold(length, validated), OUT, "Update", "EventTime", known)


def latest(changes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The state that a table of changes amounts to, as `apply_log` returns it; late operations are not in it. `before`: where the stream went on from."""
    rows = changes.filter("kind <> 'late'")
    if before is not None:
        rows = rows.unionByName(before.filter(F.col("kind").isin(*RANK)).withColumn("version", F.lit(-1).cast("bigint")))
    key = F.when(F.col("kind") == "result", F.lit(None).cast("string")).otherwise(F.col("id"))
    w = Window.partitionBy("source_id", "kind", key, "ord").orderBy(F.desc("version"))
    return rows.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k", "version")


def late(changes: DataFrame) -> DataFrame:
    """Operations that came after their chunk had closed: source_id, chunk_index, seq, payload."""
    return changes.filter("kind = 'late'").select("source_id", F.col("id").cast("bigint").alias("chunk_index"), F.col("ord").alias("seq"), "payload")
