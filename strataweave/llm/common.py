"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that one vectorised step holds at once (a longer text is one step of its own).
BLOCK_CHARS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns never enter an operator."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def fresh(names: list[str], name: str) -> str:
    """A column name like `name` that none of `names` is, in any case of letters."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


@functools.cache
def _trim():
    """glibc's malloc_trim, where there is one."""
    name = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None


def release() -> None:
    """Give freed memory back, so that workers that wait for their next task stay small."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `chars` bytes of text each; at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // chars
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
    release()


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of a column of texts, A-Z lower-cased.

    Returns the code of each word, the row where each row's words begin (one more entry
    than rows), and the distinct words by code. Null counts as empty.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    vocabulary = encoded.dictionary
    blank = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
    if blank >= 0:  # the split leaves empty strings at the ends of a text
        keep = codes != blank
        before = np.concatenate([[0], np.cumsum(keep)])
        offsets, codes = before[offsets], codes[keep]
    return codes, offsets, vocabulary


def hashes(vocabulary: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of strings."""
    digest = xxhash.xxh3_64_digest
    raw = b"".join([digest(w, seed) for w in strings(vocabulary)])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def strings(texts: pa.Array) -> list[str]:
    """A column of strings as a list (faster than to_pylist; a null is None)."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FAN_IN = 32  # partial results that one task adds up
PART_BYTES = 4 << 20  # of an array that one row holds


def add_up(rows: DataFrame, keys: list[str], add, schema: str, segments: int = 1) -> DataFrame:
    """Partial results of tasks, added up in a tree of FAN_IN per task, whatever their number.

    `add` takes the rows of a group and returns one row of `schema`, which begins with `idx bigint`. `segments`: how many
    different `keys` there are; every group of a level has a partition of its own, as far as LEAVES go.
    """
    parts = max(rows.rdd.getNumPartitions(), 1)
    rows = rows.withColumn("idx", F.spark_partition_id().cast("bigint"))
    while True:
        parts = -(-parts // FAN_IN)
        rows = rows.withColumn("idx", F.floor(F.col("idx") / FAN_IN)).repartition(min(max(parts * segments, 1), LEAVES), *keys, "idx")
        rows = rows.groupBy(*keys, "idx").applyInArrow(add, schema)
        if parts <= 1:
            return rows


LEAVES = 4096  # partitions of one level of the tree at most


def parts_of(array: np.ndarray) -> pa.RecordBatch:
    """An array's raw bytes as rows (segment, part) of at most PART_BYTES, without those that are all zero."""
    flat = array.ravel()
    step = max(1, PART_BYTES // flat.itemsize)
    some = [(i // step, flat[i : i + step].tobytes()) for i in range(0, len(flat), step) if flat[i : i + step].any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], ["segment", "part"])


def sum_arrays(parts: DataFrame, dtype: str, size: int) -> np.ndarray:
    """The sum of arrays of one fixed size that tasks report by `parts_of`; the driver gets one array."""

    def add(group: pa.Table) -> pa.Table:
        total = None
        for raw in group["part"]:
            one = np.frombuffer(raw.as_buffer(), dtype)
            total = one.copy() if total is None else np.add(total, one, out=total)
        return pa.table({"idx": group["idx"][:1], "segment": group["segment"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    step = max(1, PART_BYTES // np.dtype(dtype).itemsize)
    total = np.zeros(size, dtype)
    for row in add_up(parts.select("segment", "part"), ["segment"], add, "idx bigint, segment int, part binary", -(-size // step)).collect():
        total[row["segment"] * step : (row["segment"] + 1) * step] = np.frombuffer(row["part"], dtype)
    return total


def deal(bucket: np.ndarray, *arrays: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """The arrays' raw bytes by bucket: (buckets, one list of bytes per array)."""
    order = np.argsort(bucket, kind="stable")
    which = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else np.empty(0, np.int64)
    edges = np.append(cuts, len(which)).tolist()
    sorted_ = [a[order] for a in arrays]
    return which[cuts].tolist(), [[a[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)] for a in sorted_]


def total_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)
