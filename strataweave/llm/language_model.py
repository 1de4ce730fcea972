"""Language-model scores from a log-frequency Bloom filter.

Counts: every training text is a sequence of words and one end. Tasks count words and n-grams
by 64-bit hash (n-grams by its upper 48 bits), and hand keys and counts on by hash range; a reducer per range adds them up. The
words' counts stay exact. The n-grams' counts are quantised, q = 1 + floor(log_BASE c), and the pairs
(n-gram, 1) ... (n-gram, q) enter the filter: each hash range has a segment of its own, sized by its own counts and written to
the shared folder by the reducer that has them. Segments grow in number and in total with the corpus; nothing is left out to fit a size.

Score: texts lie in chunks of about CHUNK bytes. A chunk sends its distinct words and n-grams to their hash ranges, is
answered with exact counts and levels in the same order, and scores its texts. A count is read by probing (n-gram, 1),
(n-gram, 2), ... until a probe misses, and is at most those of the two shorter n-grams within. A word's probability is the n-gram's count smoothed by the lower order's probability
(Dirichlet prior of weight `mu`), down to additively smoothed single words. So the mass that a context's counts leave goes to the lower order, and
the probabilities after a context add up to one but for what the levels round and a Bloom filter's false hits add.

Base score: exact. Words that are at least one in `hot` of all training tokens, so at most `hot` words,
are broadcast with their counts and not asked for.

Defined results: a null or empty text is one end. Null ids train and are not held out. Repeated rows count and are scored
one by one. Very long texts are scored whole, as a chunk of their own. Without training texts N and V are 0, and base scores are those of unknown tokens. Columns beside doc_id and text
never enter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import blocks, hashes, mix, table, total_by_key, words
from strataweave.session import materialize

BASE = 1.6  # of the quantised counts
PROBES = 6  # bits per entry
ADD = 0.1
FLUSH = 2_500_000
CHUNK = 6_000_000  # bytes of text that ask for their counts together
BEGIN = np.uint64(0x5851F42D4C957F2D)
END_WORD = "\n"  # no word has white space
GOLD = np.uint64(0x9E3779B97F4A7C15)
UPPER = np.uint64(0xFFFFFFFFFFFF0000)  # of an n-gram's hash


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def _sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of words and ends, where each text's begin, and the hashes by code."""
    codes, offsets, vocabulary = words(texts)
    of = np.append(hashes(vocabulary), hashes(pa.array([END_WORD])))
    rows = len(texts)
    full = np.full(len(codes) + rows, len(of) - 1, np.int64)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    full[np.arange(len(codes)) + owner] = codes
    return full, offsets + np.arange(rows + 1), of


def ngrams(tokens: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-gram that ends at each token, for n = 2 ... order; texts begin with BEGIN."""
    first = offsets[:-1]
    out, before, gram = [], tokens, tokens
    for n in range(2, order + 1):
        before = np.concatenate([[BEGIN], before[:-1]])
        before[first] = BEGIN
        gram = mix(gram * GOLD + before + np.uint64(n))
        out.append(gram & UPPER)
    return out


def ranges(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(hash range, begin, end) of sorted keys."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(of, np.arange(buckets + 1)).tolist()
    return [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted n-gram keys: their number, then the steps between them by planes of bytes, the upper three compressed."""
    steps = np.diff(keys >> np.uint64(16), prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T)
    return len(keys).to_bytes(4, "little") + planes[:3].tobytes() + pa.compress(planes[3:].tobytes(), "zstd", asbytes=True)


def unsqueeze(raw: pa.Scalar) -> np.ndarray:
    raw = raw.as_buffer()
    n = int.from_bytes(raw[:4].to_pybytes(), "little")
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :3] = np.frombuffer(raw[4 : 4 + 3 * n], np.uint8).reshape(3, n).T
    steps[:, 3:6] = np.frombuffer(pa.decompress(raw[4 + 3 * n :], 3 * n, "zstd"), np.uint8).reshape(3, n).T
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64) << np.uint64(16)


def quantise(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


#: The count that a level stands for: the mean of the whole numbers that it holds, 0 for level 0.
LEVELS = np.array([0.0] + [(np.ceil(BASE ** (q - 1) - 1e-9) + np.ceil(BASE**q - 1e-9) - 1) / 2 for q in range(1, 80)])


def places(keys: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    """One of the PROBES bits of (key, level) in its segment of `bits`."""
    a = mix(keys + np.uint64(level * int(GOLD) & 0xFFFFFFFFFFFFFFFF))
    return ((a + np.uint64(probe) * (mix(a) | np.uint64(1))) % np.uint64(bits)).astype(np.int64)


@dataclass
class Filter:
    """A segment of a log-frequency Bloom filter."""

    raw: np.ndarray
    cutoff: int

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each key, by probes of one level after the other until one misses."""
        out = np.zeros(len(keys), np.int64)
        flat = self.raw.reshape(-1)
        bits = np.uint64(len(flat) * 8)
        live = np.arange(len(keys))
        for level in range(int(quantise(np.array([self.cutoff]))[0]), len(LEVELS)):
            at = mix(keys[live] + np.uint64(level * int(GOLD) & 0xFFFFFFFFFFFFFFFF))
            step = mix(at) | np.uint64(1)
            for _ in range(PROBES):
                bit = at % bits
                hit = (flat[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                live, at, step = live[hit], at[hit] + step[hit], step[hit]
            if not len(live):
                break
            out[live] = level
        return out


def fill(keys: np.ndarray, counts: np.ndarray, cutoff: int, size: int) -> bytes:
    """A segment of `size` bytes that holds the counts of at least `cutoff`."""
    bits = np.zeros(size * 8, bool)
    some = counts >= cutoff
    keys, level = keys[some], quantise(counts[some])
    for now in range(int(quantise(np.array([cutoff]))[0]), int(level.max(initial=0)) + 1):
        own = keys[level >= now]
        for probe in range(PROBES):
            bits[places(own, now, probe, size * 8)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _counts(docs: DataFrame, order: int, buckets: int, least: int) -> DataFrame:
    """Per hash range: words with exact counts, and the filter's segment of n-grams with counts of `least` or more."""

    def pack(kind: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([k for k, _ in held])
        if kind == 1:
            keys, counts = total_by_key(keys, np.concatenate([c for _, c in held]))
        else:
            keys = np.sort(keys)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[first], np.diff(np.append(first, len(keys)))
        counts = counts.astype(np.int64 if kind == 1 else np.int32)
        cuts = ranges(keys, buckets)
        k = [keys[a:b].tobytes() if kind == 1 else squeeze(keys[a:b]) for _, a, b in cuts]
        c = [counts[a:b].tobytes() for _, a, b in cuts]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, *_ in cuts], pa.int32()), pa.array([kind] * len(cuts), pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], ["bucket", "kind", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {1: [], 2: []}
        size = {1: 0, 2: 0}

        def add(kind: int, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
            held[kind].append((keys, counts))
            size[kind] += len(keys)
            if size[kind] > FLUSH:
                yield from pack(kind, held[kind])
                held[kind], size[kind] = [], 0

        for block in blocks(batches):
            codes, offsets, of = _sequences(block.column("text"))
            many = np.bincount(codes, minlength=len(of))
            some = np.flatnonzero(many)
            yield from add(1, of[some], many[some])
            for grams in ngrams(of[codes], offsets, order):
                yield from add(2, grams)
        for kind in (1, 2):
            if held[kind]:
                yield from pack(kind, held[kind])

    def merge(group: pa.Table) -> pa.Table:
        kinds = group["kind"].to_pylist()
        own = {}
        for kind, read, t in ((1, lambda x: np.frombuffer(x.as_buffer(), np.uint64), np.int64), (2, unsqueeze, np.int32)):
            rows = [i for i, k in enumerate(kinds) if k == kind]
            keys = np.concatenate([read(group["keys"][i]) for i in rows] or [np.empty(0, np.uint64)])
            own[kind] = total_by_key(keys, np.concatenate([np.frombuffer(group["counts"][i].as_buffer(), t) for i in rows] or [np.empty(0, t)]).astype(np.int64))
        words_, counts = own[1]
        keep = own[2][1] >= least
        grams, times = own[2][0][keep], own[2][1][keep]
        need = int((quantise(times) - quantise(np.array([least]))[0] + 1).sum())
        segment = fill(grams, times, least, max(64, int(need * PROBES / np.log(2) / 8) + 1))
        blob = lambda x: pa.array([x], pa.binary())
        return pa.table({"bucket": group["bucket"][:1], "word_keys": blob(words_.tobytes()), "word_counts": blob(counts.tobytes()), "segment": blob(segment), "tokens": pa.array([int(counts.sum())]), "distinct": pa.array([len(words_)])})

    parts = docs.mapInArrow(run, "bucket int, kind int, keys binary, counts binary")
    return parts.groupBy("bucket").applyInArrow(merge, "bucket int, word_keys binary, word_counts binary, segment binary, tokens bigint, distinct bigint")


@dataclass
class Model:
    """What a worker needs: totals, and the frequent words' exact counts. The rest stays in the table of counts."""

    buckets: int
    tokens: int
    distinct: int
    hot_keys: np.ndarray
    hot_counts: np.ndarray
    order: int
    mu: float
    cutoff: int

    def frequent(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are broadcast, and the counts of these (0 of others)."""
        if not len(self.hot_keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        place = np.minimum(np.searchsorted(self.hot_keys, keys), len(self.hot_keys) - 1)
        is_hot = self.hot_keys[place] == keys
        return is_hot, np.where(is_hot, self.hot_counts[place], 0)

    def text_scores(self, codes: np.ndarray, offsets: np.ndarray, single: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text, from the words' counts by code and the n-grams' levels by token."""
        chance = (single[codes] + ADD) / (self.tokens + ADD * (self.distinct + 1))
        context = np.concatenate([[len(single) - 1], codes[:-1]])
        context[offsets[:-1]] = len(single) - 1  # as many texts begin as end
        # No n-gram is more frequent than the two that it is made of, whatever a probe says.
        quantised = np.where(single > 0, quantise(single), 0)
        before, most = single[context], np.minimum(quantised[context], quantised[codes])
        for level in levels:
            level = np.minimum(level, most)
            most = np.minimum(np.concatenate([[0], level[:-1]]), level)
            most[offsets[:-1]] = np.minimum(quantised[-1], level[offsets[:-1]])
            count = LEVELS[level]
            chance = (count + self.mu * chance) / (np.maximum(before, count) + self.mu)
            before = np.concatenate([[0.0], count[:-1]])
            before[offsets[:-1]] = single[-1]
        return np.add.reduceat(np.log10(chance), offsets[:-1])


def fit(docs: DataFrame, order: int = 3, mu: float = 40.0, hot: int = 1 << 20, least: int = 1) -> tuple[Model, DataFrame]:
    """The model of all rows of `docs` (doc_id, text), and the table of exact counts and segments."""
    docs = docs.select("text")
    buckets = max(32, 4 * docs.rdd.getNumPartitions())
    counts = materialize(_counts(docs, order, buckets, least), "counts")
    total = counts.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    tokens, distinct = total["tokens"] or 0, total["distinct"] or 0
    floor = max(1, -(-tokens // hot))  # at most `hot` words reach it

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("word_keys"), batch.column("word_counts"), strict=True):
                keys, many = np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64)
                some = many >= floor
                yield pa.RecordBatch.from_arrays([pa.array([keys[some].tobytes()], pa.binary()), pa.array([many[some].tobytes()], pa.binary())], ["k", "c"])

    rows = counts.select("word_keys", "word_counts").mapInArrow(frequent, "k binary, c binary").collect()
    keys = np.concatenate([np.frombuffer(r["k"], np.uint64) for r in rows] or [np.empty(0, np.uint64)])
    many = np.concatenate([np.frombuffer(r["c"], np.int64) for r in rows] or [np.empty(0, np.int64)])
    rank = np.argsort(keys)
    return Model(buckets, tokens, distinct, keys[rank], many[rank], order, mu, least), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """The contract's columns for every row of `docs` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per chunk, named by its first row: the texts as a compressed stream."""
        for block in blocks(batches, chars=CHUNK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(block)
            yield pa.RecordBatch.from_arrays([block.column("row").slice(0, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

    texts = lambda group: pa.ipc.open_stream(group["rows"][0].as_buffer()).read_all()
    rows = docs.select("doc_id", "text", held_out().alias("held_out"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.mapInArrow(pack, "chunk bigint, rows binary")

    def ask(group: pa.Table) -> pa.Table:
        """The distinct words that are not broadcast and the distinct n-grams of a chunk, sorted, by hash range."""
        own: Model = shared.value
        codes, offsets, of = _sequences(texts(group)["text"].combine_chunks())
        rare = np.sort(of[~own.frequent(of)[0]])
        grams = np.sort(np.concatenate([np.empty(0, np.uint64), *ngrams(of[codes], offsets, own.order)]))
        grams = grams[np.append(True, grams[1:] != grams[:-1])] if len(grams) else grams
        words_, grams_ = ({i: (a, b) for i, a, b in ranges(x, own.buckets)} for x in (rare, grams))
        which = sorted(words_.keys() | grams_.keys())
        keys = [rare[slice(*words_.get(i, (0, 0)))].tobytes() for i in which]
        packed = [squeeze(grams[slice(*grams_.get(i, (0, 0)))]) for i in which]
        return pa.table({"bucket": pa.array(which, pa.int32()), "chunk": pa.array([group["chunk"][0].as_py()] * len(which), pa.int64()), "words": pa.array(keys, pa.binary()), "grams": pa.array(packed, pa.binary())})

    def look_up(asked: pa.Table, held: pa.Table) -> pa.Table:
        rare = [np.frombuffer(x.as_buffer(), np.uint64) for x in asked["words"]]
        grams = [unsqueeze(x) for x in asked["grams"]]
        edges = [np.cumsum([0, *map(len, x)]).tolist() for x in (rare, grams)]
        words_, keys = (np.concatenate([np.empty(0, np.uint64), *x]) for x in (rare, grams))
        count, level = np.zeros(len(words_), np.int64), np.zeros(len(keys), np.uint8)
        if held.num_rows:
            known, many = np.frombuffer(held["word_keys"][0].as_buffer(), np.uint64), np.frombuffer(held["word_counts"][0].as_buffer(), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, words_), len(known) - 1)
                count = np.where(known[place] == words_, many[place], 0)
            level = Filter(np.frombuffer(held["segment"][0].as_buffer(), np.uint8), shared.value.cutoff).level(keys).astype(np.uint8)
        cut = lambda x, at: pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
        return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "counts": cut(count, edges[0]), "levels": cut(level, edges[1])})

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        own: Model = shared.value
        own_rows = texts(group)
        codes, offsets, of = _sequences(own_rows["text"].combine_chunks())
        answers = answers.sort_by("bucket")
        count, level = (np.concatenate([np.empty(0, t), *(np.frombuffer(x.as_buffer(), t) for x in answers[c])]) for c, t in (("counts", np.int64), ("levels", np.uint8)))
        is_hot, exact = own.frequent(of)
        rare = np.flatnonzero(~is_hot)
        exact[rare[np.argsort(of[rare])]] = count
        grams = ngrams(of[codes], offsets, own.order)
        _, at = np.unique(np.concatenate([np.empty(0, np.uint64), *grams]), return_inverse=True)
        levels = [level[x] for x in np.split(at, len(grams))] if grams else []
        starts = offsets[:-1]
        logs = np.add.reduceat(np.log10(exact + ADD)[codes], starts)
        n, unit = np.diff(offsets), float(np.log10(own.tokens + ADD * (own.distinct + 1)))
        scores = own.text_scores(codes, offsets, exact.astype(np.float64), levels)
        return pa.table({"doc_id": own_rows["doc_id"], "held_out": own_rows["held_out"], "n_tokens": n, "n_known": np.add.reduceat((exact > 0)[codes].astype(np.int64), starts), "train_tokens": pa.array([own.tokens] * len(n), pa.int64()), "base_score": logs - n * unit, "score": scores})

    asked = dealt.groupBy("chunk").applyInArrow(ask, "bucket int, chunk bigint, words binary, grams binary")
    held = counts.select("bucket", "word_keys", "word_counts", "segment")
    answers = asked.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(look_up, "chunk bigint, bucket int, counts binary, levels binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of `documents` by a model of the nine tenths that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, *fit(docs.filter(~held_out())))

