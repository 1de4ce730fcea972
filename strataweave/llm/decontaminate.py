"""Benchmark decontamination by latent semantic retrieval.

1. Documents become arrays of codes of the words that benchmark items use, once for all items. Words are
   lower-cased and stripped of marks at their ends.
2. Passages (PASSAGE words each) over all documents give document frequencies, and TF-IDF weights (the idf counted in both the
   item and the passage, so squared).
3. A randomised SVD of the passages' TF-IDF matrix A: every task multiplies its rows into
   A'(A Z), where Z holds the items' own vectors (random mixtures of them where there are more than `rank`) and random ones; the sums, in
   64-bit numbers, give the latent axes by the Nystrom formula in one pass.
4. Windows of documents are projected on the axes. Those whose cosine with an item reaches
   `cosine` are candidates, all of them.
5. A candidate stays if `answer` of the item's answer terms (the third of its words that tell most) are in the window with
   a block more on either side, and the longest common subsequence of words there covers `lcs` of the item.

A window that has not itself the number of answer terms that any item needs is not projected: windows begin at every block, so
a passage that has them lies whole in one. Items are handled together as far as their words number at most `terms`, which bounds
what is broadcast (terms x (rank + EXTRA) numbers) and what a task adds up; more go in further groups over the same codes. A benchmark of more than
BENCHMARK_BYTES is read in parts. Items longer than SEGMENT words go in segments, any of which convicts.

Defined results: null and empty texts and items match nothing. Items of fewer than
LEAST words must be there whole. Very long texts are searched whole. Repeated rows and repeated ids give one row per document id and item
id, for the window with the largest shares, then cosine; of equal ones the first. Null ids are not reported. Empty tables give an empty result. Columns beside doc_id, text, item_id never enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import blocks, parts_of, sum_arrays, table, words
from strataweave.session import materialize

PASSAGE, BLOCK, SEGMENT, LEAST = 48, 16, 60, 8
WINDOWS = (3, 5)  # in blocks: any SEGMENT words lie inside a window of the last
EXTRA = 24  # random directions beside the items' own
BENCHMARK_BYTES = 256 << 20
COMMON = 0.05  # share of passages above which a term has no weight
FOUND = "doc_id {}, item_id bigint, start bigint, cosine double, lcs_share double, answer_share double"


def normal(vocabulary: pa.Array) -> pa.Array:
    """Lower case, without marks at the ends."""
    return pc.replace_substring_regex(pc.utf8_lower(vocabulary), r"^[^\pL\pN]+|[^\pL\pN]+$", "")


def _coded(texts: pa.Array, value_set: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes, offsets, vocabulary = words(texts, lower=False)
    place = pc.fill_null(pc.index_in(normal(vocabulary), value_set=value_set), -1).to_numpy(zero_copy_only=False)
    return place.astype(np.int32)[codes], offsets


class Items:
    """Item segments as arrays of codes, and the vocabulary."""

    def __init__(self, rows: list[tuple[int, str]]):
        texts = [normal(pa.array((t or "").split(), pa.large_string())).to_pylist() for _, t in rows]
        texts = [[w for w in ws if w] for ws in texts]
        self.vocabulary = pa.array(sorted({w for ws in texts for w in ws}), pa.large_string())
        of = {w: i for i, w in enumerate(self.vocabulary.to_pylist())}
        self.segments: list[tuple[int, np.ndarray]] = []
        for (item, _), ws in zip(rows, texts, strict=True):
            codes = np.array([of[w] for w in ws], np.int32)
            cuts = max(1, -(-len(codes) // SEGMENT))
            for part in np.array_split(codes, cuts):
                if len(part):
                    self.segments.append((item, part))

    def groups(self, terms: int) -> list[list[tuple[int, np.ndarray]]]:
        """The segments, in groups of at most `terms` different words (or of one segment)."""
        out: list[list[tuple[int, np.ndarray]]] = []
        seen = np.full(len(self.vocabulary), -1)
        size = 0
        for segment in self.segments:
            new = np.count_nonzero(seen[np.unique(segment[1])] != len(out) - 1)
            if not out or size + new > terms:
                out.append([])
                size = len(np.unique(segment[1]))
            else:
                size += new
            seen[segment[1]] = len(out) - 1
            out[-1].append(segment)
        return out


class Group:
    """Segments with codes of their own words, weights and answer terms."""

    def __init__(self, segments: list[tuple[int, np.ndarray]], vocabulary: int, df: np.ndarray, passages: int):
        own = np.unique(np.concatenate([codes for _, codes in segments]))
        self.local = np.full(vocabulary + 1, -1, np.int32)  # by the vocabulary's codes; -1, the last, is no word
        self.local[own] = np.arange(len(own))
        self.size = len(own)
        self.segments = [(item, self.local[codes]) for item, codes in segments]
        idf = np.log((1 + passages) / (1 + df[own]))
        square = np.maximum(idf, 1e-3) ** 2
        self.weight = np.where(df[own] > COMMON * passages, 0, square).astype(np.float32)
        for _, codes in self.segments:  # a segment of common words only keeps their weights
            some = np.unique(codes)
            if np.count_nonzero(self.weight[some]) < 4:
                self.weight[some] = square[some]
        self.answers = []
        for _, codes in self.segments:
            some = np.unique(codes)
            self.answers.append(np.sort(some[np.lexsort((some, -square[some]))][: max(1, -(-len(some) // 3))]))

    def vectors(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Terms and weights of each segment, of length one."""
        for _, codes in self.segments:
            some, many = np.unique(codes, return_counts=True)
            value = self.weight[some] * many
            yield some, (value / max(float(np.linalg.norm(value)), 1e-9)).astype(np.float32)

    def start(self, rank: int, seed: int = 11) -> np.ndarray:
        """The orthonormal block that the range finder begins with."""
        rng = np.random.default_rng(seed)
        mixed = len(self.segments) > rank
        begin = np.zeros((self.size, min(rank, len(self.segments))), np.float32)
        for k, (terms, value) in enumerate(self.vectors()):
            if mixed:
                begin[terms] += value[:, None] * rng.standard_normal(begin.shape[1]).astype(np.float32)
            else:
                begin[terms, k] = value
        drawn = rng.standard_normal((self.size, EXTRA)).astype(np.float32)
        return np.linalg.qr(np.concatenate([begin, drawn], axis=1)[:, : max(1, self.size)])[0].astype(np.float32)

    def project(self, axes: np.ndarray) -> np.ndarray:
        """Unit latent vectors of the segments; zero where the axes hold nothing of one."""
        own = np.stack([value @ axes[terms] for terms, value in self.vectors()])
        norm = np.linalg.norm(own, axis=1, keepdims=True)
        return np.where(norm > 1e-6, own / np.maximum(norm, 1e-9), 0).astype(np.float32)


def _code_rows(docs: DataFrame, vocabulary: pa.Array, id_type: str) -> DataFrame:
    kind = np.int16 if len(vocabulary) < 1 << 15 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            codes, offsets = _coded(block.column("text"), vocabulary)
            codes = codes.astype(kind)
            rows = [codes[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "codes"])

    return docs.mapInArrow(run, f"doc_id {id_type}, codes binary")


def _streams(batches: Iterator[pa.RecordBatch], kind, align: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, codes, first) of some documents at a time, each padded to a multiple of `align` codes."""
    for batch in blocks(batches, "codes", 400_000):
        parts, first, at = [], [], 0
        for raw in batch.column("codes"):
            own = np.frombuffer(raw.as_buffer(), kind)
            gap = -len(own) % align
            first.append(at)
            parts += [own, np.full(gap, -1, kind)]
            at += len(own) + gap
        yield batch.column("doc_id").to_pylist(), np.concatenate(parts).astype(np.int64), np.array([*first, at])


def _frequencies(coded: DataFrame, size: int, kind) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for _, codes, first in _streams(batches, kind, PASSAGE):
            at = np.flatnonzero(codes >= 0)
            key = np.sort(at // PASSAGE * size + codes[at])
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            total[:size] += np.bincount(key % size, minlength=size)
            total[size] += len(codes) // PASSAGE
        yield parts_of(total)

    total = sum_arrays(coded.mapInArrow(run, "segment int, part binary"), "int64", size + 1)
    return total[:size], int(total[size])


def sum_rows(table_: np.ndarray, index: np.ndarray, starts: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """For each run of `index` (they begin at `starts`) the sum of its rows of a table, weighted.

    The j-th rows of all runs that are long enough are added at once, longest runs first.
    """
    many = np.diff(np.append(starts, len(index)))
    order = np.argsort(-many, kind="stable")
    first, many = starts[order], many[order]
    out = np.zeros((len(starts), table_.shape[1]), table_.dtype)
    for j in range(int(many[0]) if len(many) else 0):
        size = int(np.searchsorted(-many, -j, side="left"))
        at = first[:size] + j
        rows = table_[index[at]]
        if weight is not None:
            rows *= weight[at, None]
        out[:size] += rows
    back = np.empty_like(out)
    back[order] = out
    return back


def _range(coded: DataFrame, group: Group, start: np.ndarray, kind) -> np.ndarray:
    """A'(A Z) over all passages."""
    size, rank = start.shape
    shared = coded.sparkSession.sparkContext.broadcast((start, group.weight, group.local))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, weight, local = shared.value
        total, part = np.zeros((size, rank), np.float64), np.zeros((size, rank), np.float32)  # the sum, and that of one block
        for _, codes, _ in _streams(batches, kind, PASSAGE):
            codes = local[codes]
            heavy = np.flatnonzero((codes >= 0) & (weight[codes] > 0))
            if not len(heavy):
                continue
            key, count = np.unique(heavy // PASSAGE * size + codes[heavy], return_counts=True)
            for a in range(0, len(key), 40_000):
                row, term = np.divmod(key[a : a + 40_000], size)  # a passage cut here is two shorter ones
                value = (weight[term] * count[a : a + 40_000]).astype(np.float32)
                new = np.concatenate([[True], row[1:] != row[:-1]])
                rows = sum_rows(begin, term, np.flatnonzero(new), value)
                order = np.argsort(term, kind="stable")
                edge = np.flatnonzero(np.diff(term[order], prepend=-1))
                part[term[order][edge]] += sum_rows(rows, (np.cumsum(new) - 1)[order], edge, value[order])
            total += part
            part[:] = 0
        yield parts_of(total)

    return sum_arrays(coded.mapInArrow(run, "segment int, part binary"), "float64", size * rank).reshape(size, rank)


def latent_axes(start: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Right singular vectors of A by the Nystrom formula, from Z and A'(A Z)."""
    product = product.astype(np.float64)
    scale = np.linalg.norm(product)
    if not scale:
        return np.zeros((len(start), 1), np.float32)
    shift = 1e-7 * scale
    moved = product + shift * start
    core = start.T @ moved
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    keep = value > 1e-9 * value.max()
    half = moved @ (vector[:, keep] / np.sqrt(value[keep]))
    axes, singular, _ = np.linalg.svd(half, full_matrices=False)
    return axes[:, singular**2 > 2 * shift].astype(np.float32)


def lcs_length(masks: dict[int, int], size: int, window: list[int]) -> int:
    """Length of the longest common subsequence, with a bit for each place of the item."""
    full = (1 << size) - 1
    state = full
    for code in window:
        mask = masks.get(code)
        if mask:
            both = state & mask
            state = ((state + both) | (state - both)) & full
    return size - state.bit_count()


def _near(vectors: np.ndarray, own: np.ndarray, cosine: float) -> Iterator[tuple[int, int, float]]:
    """(vector, segment, cosine) of all pairs that reach `cosine`, by blocks of segments."""
    for first in range(0, len(own), 4096):
        near = vectors @ own[first : first + 4096].T
        for i, k in zip(*np.nonzero(near >= cosine), strict=True):
            yield int(i), first + int(k), float(near[i, k])


def _search(coded: DataFrame, items: Group, axes: np.ndarray, kind, cosine: float, lcs: float, answer: float, id_type: str) -> DataFrame:
    projected = items.weight[:, None] * axes  # a word's share in its window's latent vector
    own = items.project(axes)
    telling = np.zeros(items.size, bool)
    for terms in items.answers:
        telling[terms] = True
    needed = min((-(-len(a) * answer // 1) for a in items.answers), default=1)
    masks = []
    for _, codes in items.segments:
        mask: dict[int, int] = {}
        for i, code in enumerate(codes.tolist()):
            mask[code] = mask.get(code, 0) | 1 << i
        masks.append(mask)
    shared = coded.sparkSession.sparkContext.broadcast((projected, own, telling, needed, masks, items.segments, items.answers, items.local))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projected, own, telling, needed, masks, segments, answers, local = shared.value
        least = [max(-(-len(c) * lcs // 1), min(len(c), LEAST)) for _, c in segments]
        present = np.zeros(len(telling), bool)
        ids_are = pa.int64() if id_type == "bigint" else pa.string()
        for ids, codes, first in _streams(batches, kind, BLOCK):
            best: dict[tuple[int, int], tuple] = {}
            count = len(codes) // BLOCK
            if not count:
                continue
            codes = local[codes]
            tells = np.concatenate([[0], np.cumsum(((codes >= 0) & telling[codes]).reshape(count, BLOCK).sum(axis=1))])
            doc_of = np.repeat(np.arange(len(ids)), np.diff(first) // BLOCK)
            end_of = (first[1:] // BLOCK)[doc_of]
            chosen = []
            used = np.zeros(count + 1, np.int64)
            for width in WINDOWS:
                stop = np.minimum(np.arange(count) + width, end_of)
                some = np.flatnonzero(tells[stop] - tells[:count] >= needed)
                np.add.at(used, some, 1)
                np.add.at(used, stop[some], -1)
                chosen.append((width, stop, some))
            # Each block that a window needs is projected once; a window is the sum of its blocks.
            own_blocks = np.flatnonzero(np.cumsum(used[:-1]) > 0)
            if not len(own_blocks):
                continue
            row_of = np.full(count, -1)
            row_of[own_blocks] = np.arange(len(own_blocks))
            in_blocks = codes.reshape(count, BLOCK)[own_blocks]
            sums = np.zeros((len(own_blocks) + 1, projected.shape[1]), np.float32)  # the last row is that of no block
            for a in range(0, len(own_blocks), 2048):
                line, place = np.nonzero(in_blocks[a : a + 2048] >= 0)
                if len(line):
                    edge = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
                    sums[a + line[edge]] = sum_rows(projected, in_blocks[a : a + 2048][line, place], edge)
            for width, stop, some in chosen:
                for a in range(0, len(some), 1024):
                    part = some[a : a + 1024]
                    vector = sums[row_of[part]]
                    for j in range(1, width):
                        vector += sums[np.where(part + j < stop[part], row_of[np.minimum(part + j, count - 1)], -1)]
                    size = np.linalg.norm(vector, axis=1, keepdims=True)
                    vector /= np.maximum(size, 1e-9)
                    for i, k, near in _near(vector, own, cosine):
                        item, item_codes = segments[k]
                        place = int(part[i])
                        doc = int(doc_of[place])
                        low = max(int(first[doc]), (place - 1) * BLOCK)
                        high = min(int(first[doc + 1]), (int(stop[place]) + 1) * BLOCK)
                        window = codes[low:high]
                        own_words = window[window >= 0]
                        present[own_words] = True
                        there = np.count_nonzero(present[answers[k]]) / len(answers[k])
                        present[own_words] = False
                        if there < answer:
                            continue
                        common = lcs_length(masks[k], len(item_codes), window.tolist())
                        if common < least[k]:
                            continue
                        found = (common / len(item_codes), float(there), near, int(first[doc]) - low)
                        if found > best.get((doc, item), (0.0,)):
                            best[doc, item] = found
            if best:
                rows = [(ids[d], item, -at, c, s, t) for (d, item), (s, t, c, at) in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [ids_are, *[pa.int64()] * 2, *[pa.float64()] * 3], strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return coded.mapInArrow(run, FOUND.format(id_type))


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.4, lcs: float = 0.6, answer: float = 0.5, rank: int = 512, terms: int = 20_000) -> DataFrame:
    """One row per (doc_id, item_id) that matches: start (word), cosine, lcs_share, answer_share of the best window.

    doc_id may be a number or a string.
    """
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    id_type = "string" if dict(docs.dtypes)["doc_id"] == "string" else "bigint"
    items = benchmark.select("item_id", "text").filter("item_id is not null")
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // BENCHMARK_BYTES))
    found = None
    for k in range(parts):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        own = Items([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()])
        if not own.segments:
            continue
        size = len(own.vocabulary)
        kind = np.int16 if size < 1 << 15 else np.int32
        coded = materialize(_code_rows(docs, own.vocabulary, id_type), "codes")
        frequencies = _frequencies(coded, size, kind)
        for segments in own.groups(terms):
            group = Group(segments, size, *frequencies)
            start = group.start(rank)
            axes = latent_axes(start, _range(coded, group, start, kind))
            some = _search(coded, group, axes, kind, cosine, lcs, answer, id_type)
            found = some if found is None else found.union(some)
    if found is None:
        return docs.sparkSession.createDataFrame([], FOUND.format(id_type))
    best = F.max_by(F.struct("start", "cosine", "lcs_share", "answer_share"), F.struct("lcs_share", "answer_share", "cosine", -F.col("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold items of `benchmark`, whole or paraphrased."""
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
