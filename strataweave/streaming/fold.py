"""The operation log as a stream: an incremental fold with the batch fold's results.

State per source: counters per type and the created ids. Late and repeated operations are kept out by a watermark on
arrival and by the operation's key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataweave.operators.oplog import ORDER, PREFIX

OUT = "source_id string, id string, entity_type string, title string, chunk_index int, seq bigint"
STATE = "action_field bigint, project bigint, measure bigint, indicator bigint"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    counters = dict(zip(PREFIX, state.get, strict=True)) if state.exists else dict.fromkeys(PREFIX, 0)
    rows = pd.concat(list(frames))
    rows = rows.assign(rank=rows["operation"].map(ORDER).fillna(3)).sort_values(["chunk_index", "rank", "seq"], kind="stable")
    out = []
    for r in rows.itertuples(index=False):
        if r.operation == "CREATE" and r.entity_type in counters and (r.title or r.description):
            counters[r.entity_type] += 1
            out.append((key[0], f"{PREFIX[r.entity_type]}_{counters[r.entity_type]}", r.entity_type, r.title, r.chunk_index, r.seq))
    state.update(tuple(counters.values()))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def created_stream(operations: DataFrame, watermark: str | None = "1 hour") -> DataFrame:
    """Created entities with their ids from a stream of operations (source_id, chunk_index, seq, operation, entity_type, title, description, arrived).

    Within a trigger operations are ordered as in the batch fold; chunks are expected to arrive in order.
    """
    rows = operations
    if watermark:
        rows = rows.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["source_id", "chunk_index", "seq"])
    rows = rows.select("source_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("seq").cast("bigint").alias("seq"), "operation", "entity_type", "title", "description")
    return rows.groupBy("source_id").applyInPandasWithState(_fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
