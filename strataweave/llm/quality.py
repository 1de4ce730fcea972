"""Quality by nearest-neighbour voting in a latent-semantic space.

Fit: labelled rows outside the held-out third, at most `sample` of them (those with the smallest
hash of their id; the bound is a parameter), become rows of term counts. Terms are hashed words, hashed word shapes
(case, digits, symbols) and binned statistics of the text, so that layout and noise are terms
as words are. TF-IDF and a truncated SVD of these rows give a latent space. The labelled
vectors, of fixed size, are broadcast.

Score: every document's terms are projected into the space, the cosines with all labelled
vectors are computed in exact blocked products, and the `neighbours` nearest vote with their
similarity as weight.

Defined results: null, empty and term-free texts get the labelled rows' mean label. Labels
that are null, rows without a document and repeated labels of other values are ignored or averaged:
a document's label is the mean of its labels. Without labelled rows every score is 0.5. All neighbours as near as the last one
vote, and cosines are compared to five digits, so ties and the block that a row is in do not matter and repeated rows get equal
scores. Very long texts are read whole, as one block. An empty table gives no rows. Labels, lang, source and doc_id are never inputs of a score. Columns beside those
named never enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import blocks, hashes, table, words

WORD_TERMS, SHAPE_TERMS, BINS, STATS = 1024, 256, 12, 10
TERMS = WORD_TERMS + SHAPE_TERMS + BINS * STATS
DIGITS = np.float32(1e5)  # cosines are compared in units of one by this
STAT_WEIGHT = 2.0  # of a binned statistic against one word that fills the text


def _shapes(vocabulary: pa.Array) -> pa.Array:
    """Words with letters, digits and runs folded: 'Aa', 'A!', 'a%', '9'."""
    shape = pc.replace_substring_regex(vocabulary, r"\pN+", "9")
    shape = pc.replace_substring_regex(shape, r"\p{Lu}+", "A")
    return pc.replace_substring_regex(shape, r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "a")


def _bin(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bin of a value between two bounds, in equal steps."""
    return np.clip(((x - low) / (high - low) * BINS), 0, BINS - 1e-6).astype(np.int64)


def terms_of(texts: pa.Array) -> np.ndarray:
    """Weighted term counts [text, TERMS]; a row of zeros for a text without words."""
    texts = pc.fill_null(texts, "")
    codes, offsets, vocabulary = words(texts, lower=False)
    rows = len(texts)
    count = np.diff(offsets)
    owner = np.repeat(np.arange(rows), count)
    out = np.zeros((rows, TERMS), np.float32)
    if not len(codes):
        return out
    lower = pc.utf8_lower(vocabulary)
    word = (hashes(lower) % np.uint64(WORD_TERMS)).astype(np.int64)
    shaped = _shapes(vocabulary).dictionary_encode()
    shape = (hashes(shaped.dictionary, 1) % np.uint64(SHAPE_TERMS)).astype(np.int64)[shaped.indices.to_numpy(zero_copy_only=False)]
    # Counts over whole texts, dampened by the logarithm and by the length.
    for start, width, term in ((0, WORD_TERMS, word), (WORD_TERMS, SHAPE_TERMS, shape)):
        flat = np.bincount(owner * width + term[codes], minlength=rows * width).reshape(rows, width)
        part = np.log1p(flat).astype(np.float32)
        norm = np.sqrt((part * part).sum(axis=1, keepdims=True))
        out[:, start : start + width] = part / np.maximum(norm, 1e-9)
    pairs = np.unique(owner * len(vocabulary) + codes, return_counts=True)
    distinct = np.bincount(pairs[0] // len(vocabulary), minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, pairs[0] // len(vocabulary), pairs[1])
    size = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.float64)
    chars = np.bincount(owner, weights=size[codes], minlength=rows)
    n, c = np.maximum(count, 1), np.maximum(chars, 1)

    def share(pattern: str) -> np.ndarray:
        hits = pc.count_substring_regex(vocabulary, pattern).to_numpy(zero_copy_only=False).astype(np.float64)
        return np.bincount(owner, weights=hits[codes], minlength=rows) / c

    same = np.concatenate([[0], (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])])
    lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False) + 1
    repeats = np.array([1 - len(set(x)) / len(x) if len(x) > 1 else 0 for x in (t.split("\n") for t in texts.to_pylist())])
    stats = (
        _bin(np.log2(n), 0, 12),
        _bin(np.log2(np.maximum(distinct, 1)) / np.maximum(np.log2(n), 1), 0, 1),
        _bin(np.log2(top / n + 1e-9), -8, 0),
        _bin(share(r"\p{Lu}"), 0, 0.6),
        _bin(share(r"[\p{P}\p{S}]"), 0, 0.5),
        _bin(share(r"\pN"), 0, 0.3),
        _bin(chars / n, 0, 12),
        _bin(np.bincount(owner, weights=same, minlength=rows) / n, 0, 0.5),
        _bin(repeats, 0, 1),
        _bin(np.log2(n / lines), 0, 8),
    )
    some = np.flatnonzero(count)
    for k, at in enumerate(stats):
        out[some, WORD_TERMS + SHAPE_TERMS + k * BINS + at[some]] = STAT_WEIGHT / np.sqrt(STATS)
    return out


class Model:
    """IDF weights, projection and labelled unit vectors."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, rank: int = 96, seed: int = 7):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        some = np.flatnonzero(terms.any(axis=1)) if len(terms) else np.empty(0, np.int64)
        self.labels = labels[some].astype(np.float32)
        if not len(some):
            self.vectors = np.zeros((0, 1), np.float32)
            return
        terms = terms[some]
        df = (terms > 0).sum(axis=0)
        self.idf = (np.log((1 + len(terms)) / (1 + df)) + 1).astype(np.float32)
        weighted = terms * self.idf
        rank = min(rank, *weighted.shape)
        # Randomised range finder with two power steps; the rows are few and the bound is fixed.
        sketch = weighted @ np.random.default_rng(seed).standard_normal((TERMS, min(rank + 16, TERMS))).astype(np.float32)
        for _ in range(2):
            sketch = weighted @ (weighted.T @ np.linalg.qr(sketch)[0])
        base = np.linalg.qr(sketch)[0]
        self.axes = np.linalg.svd(base.T @ weighted, full_matrices=False)[2][:rank].T.astype(np.float32)
        self.vectors = self._unit(weighted @ self.axes)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, terms: np.ndarray, neighbours: int, block: int = 512) -> np.ndarray:
        out = np.full(len(terms), self.prior)
        if not len(self.vectors):
            return out
        k = min(neighbours, len(self.vectors))
        for a in range(0, len(terms), block):
            part = terms[a : a + block]
            some = np.flatnonzero(part.any(axis=1))
            if not len(some):
                continue
            near = self._unit((part[some] * self.idf) @ self.axes) @ self.vectors.T
            near = np.rint(near * DIGITS)  # a block's rounding is below this
            last = np.partition(near, len(self.vectors) - k, axis=1)[:, len(self.vectors) - k, None]
            for i, row in enumerate(near):
                at = np.flatnonzero(row >= last[i])
                weight = np.maximum(row[at] / DIGITS, 0).astype(np.float64) ** 4 + 1e-9
                out[a + some[i]] = (weight * self.labels[at]).sum() / weight.sum()
        return out


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def _term_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = [r.tobytes() for r in terms_of(block.column("text"))]
            yield pa.RecordBatch.from_arrays([block.column("label"), pa.array(rows, pa.binary())], ["label", "terms"])

    return docs.mapInArrow(run, "label double, terms binary")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Model:
    """A model from at most `sample` labelled rows of `docs` (doc_id, text), `labels` (doc_id, quality).

    An id with several rows gives one of them, that with the least hash; one with several labels their mean.
    """
    known = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null").filter(~held_out())
    known = known.groupBy(F.col("doc_id").alias("l_id")).agg(F.avg(F.col("quality").cast("double")).alias("label"))
    order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    there = known.withColumnRenamed("l_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")  # an id once, however many rows have it
    ids = there.orderBy(order, "doc_id").limit(sample)
    # At most `sample` ids and labels: broadcast, so that no text is shuffled but those of these ids.
    picked = F.broadcast(ids.select(F.col("doc_id").alias("p_id"), "label"))
    rows = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("p_id"))
    one = rows.groupBy("p_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("row"), F.first("label").alias("label")).select("row.text", "label")
    found = sorted((r["terms"], r["label"]) for r in _term_rows(one).collect())
    terms = np.array([np.frombuffer(x, np.float32) for x, _ in found], np.float32).reshape(-1, TERMS)
    return Model(terms, np.array([y for _, y in found], np.float64))


def score(docs: DataFrame, model: Model, neighbours: int = 24) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            scores = np.clip(shared.value.score(terms_of(block.column("text")), neighbours), 0, 1)
            columns = [block.column("doc_id"), block.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, neighbours: int = 24) -> DataFrame:
    """The rows of `docs`, with their columns, whose predicted label is 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield block.filter(pa.array(shared.value.score(terms_of(block.column("text")), neighbours) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from `labels` outside the held-out third."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))
