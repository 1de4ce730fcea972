"""Best-fit packing with a swap-based local search.

Only lengths decide a packing, and there are at most `capacity` of them. So the documents are
tokenised and cut on the executors, the histogram of piece lengths (at most `capacity` rows,
whatever the input) goes to the driver, and the driver packs the histogram: bins with the
same content are one pattern with a multiplicity. Best fit in arrival order (of the lengths), and best fit decreasing, give first
patterns, and the better result of the two counts; the local search moves, exchanges one for one and two for one between underfull
patterns, each time raising the sum of squared fills, until bins empty. The plan, whose patterns are
bounded, is broadcast; each piece finds its bin and offset from its rank among the pieces of
its length. Ranks come from counts of (length, salt) cells, so a length that a third
of all rows share is many small groups.

Defined results: a null or empty text is the single end id. Repeated rows and repeated or null
ids are packed one by one, and ties are broken by row. An empty table packs into nothing. Very long texts are whole, as
full pieces, which are sequences of their own, and a rest. Columns beside doc_id and text never enter.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.llm.common import blocks, strings, table, words
from strataweave.session import materialize

PIECES = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
WORDS, YOUNG = 1_500_000, 100_000  # distinct words whose ids a worker keeps (about 50 bytes each); a full table starts anew


MARK = "\x01"  # a control character: alone it is one id


class _Words:
    """Ids by word. Words are named by 128-bit hashes, in sorted arrays: a large one and a young one."""

    most, young_most = WORDS, YOUNG

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.reset()

    def reset(self) -> None:
        none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.old, self.young = none, none  # names, their second halves, places in the pool, numbers of ids
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0

    def places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each word; unknown words are learnt."""
        if len(self.old[0]) + len(self.young[0]) > self.most:
            self.reset()
        digest = xxhash.xxh3_128_digest
        names = np.frombuffer(b"".join(map(digest, words)), np.uint64).reshape(-1, 2)
        first, size = np.full(len(words), -1), np.zeros(len(words), np.int64)
        for keys, checks, at, many in (self.old, self.young):
            if len(keys):
                place = np.minimum(np.searchsorted(keys, names[:, 0]), len(keys) - 1)
                hit = (keys[place] == names[:, 0]) & (checks[place] == names[:, 1])
                first[hit], size[hit] = at[place[hit]], many[place[hit]]
        new = np.flatnonzero(first < 0)
        if len(new):
            first[new], size[new] = self._learn([words[i] for i in new.tolist()])
            self.young = self._merge(self.young, (names[new, 0], names[new, 1], first[new], size[new]))
            if len(self.young[0]) > self.young_most:
                self.old, self.young = self._merge(self.old, self.young), tuple(x[:0] for x in self.young)
        return first, size

    @staticmethod
    def _merge(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words some at a time, with a mark between them whose id no other text gives."""
        encode = self.tokenizer.encode_batch_fast
        [mark] = encode([MARK], add_special_tokens=False)[0].ids
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        runs = [[i] for i, w in enumerate(words) if MARK in w]
        plain = [i for i, w in enumerate(words) if MARK not in w]
        runs += [plain[i : i + 64] for i in range(0, len(plain), 64)]
        for a in range(0, len(runs), 64):
            some = runs[a : a + 64]
            texts = [f" {MARK} ".join([words[i] for i in run]) for run in some]
            for run, found in zip(some, encode(texts, add_special_tokens=False), strict=True):
                ids = np.array(found.ids, np.uint32)
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
                self.ids[self.used : self.used + len(ids)] = ids
                edges = np.flatnonzero(ids == mark) if len(run) > 1 else np.empty(0, np.int64)
                first[run] = self.used + np.concatenate([[0], edges + 1])
                size[run] = np.diff(np.concatenate([[-1], edges, [len(ids)]])) - 1
                self.used += len(ids)
        return first, size


@functools.lru_cache(maxsize=1)
def _words(path: str) -> _Words:
    return _Words(path)


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's begin (one more entry than texts).

    The tokenizer turns white space into one space and no id spans a space, so a text's ids
    are those of its words, and each distinct word is encoded once.
    """
    known = _words(path)
    codes, offsets, vocabulary = words(texts, lower=False)
    places, sizes = known.places(strings(vocabulary))
    first, sizes = places[codes], sizes[codes]
    before = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    ids = known.ids[np.repeat(first - before[:-1], sizes) + np.arange(before[-1])]
    return ids, before[offsets]


def cut(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The pieces of every document, with the CRC-32 of their ids. `row` tells repeated rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for block in blocks(batches):
            ids, edges = encode_texts(block.column("text"), vocabulary)
            out: list[list] = [[] for _ in range(6)]
            for doc, row, a, b in zip(block.column("doc_id").to_pylist(), block.column("row").to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for n, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    for column, value in zip(out, (doc, row, n, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, PIECES)


# ---- the plan: patterns of lengths with multiplicities -----------------------------------------

Pattern = tuple[int, ...]  # lengths, largest first


def arrival(length: int) -> tuple[int, int]:
    """The order in which lengths come to the first plan: by a hash, as rows would come."""
    return length * 2654435761 % (1 << 32), length


def best_fit(histogram: dict[int, int], capacity: int, order=arrival) -> Counter[Pattern]:
    """Best fit over a histogram, lengths in `order` (a sort key); equal bins are filled together."""
    open_bins: dict[int, Counter[Pattern]] = {}  # by room
    rooms: list[int] = []
    closed: Counter[Pattern] = Counter()

    def put(pattern: Pattern, times: int, room: int) -> None:
        if not times:
            return
        if room == 0:
            closed[pattern] += times
            return
        if room not in open_bins:
            open_bins[room] = Counter()
            insort(rooms, room)
        open_bins[room][pattern] += times

    for length in sorted(histogram, key=order):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_bins[room].popitem()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, pattern, times = capacity, (), left
            most = room // length
            full = min(times, left // most)
            put(pattern + (length,) * most, full, room - most * length)
            left -= full * most
            times -= full
            if times and left and left < most:
                put(pattern + (length,) * left, 1, room - left * length)
                times, left = times - 1, 0
            if pattern:
                put(pattern, times, room)
    for bins in open_bins.values():
        closed.update(bins)
    return Counter({tuple(sorted(p, reverse=True)): n for p, n in closed.items()})


def _some_of(pattern: Pattern, size: int) -> list[Pattern]:
    """The different choices of `size` lengths of a pattern, largest first."""
    many = Counter(pattern)
    choices = combinations_with_replacement(sorted(many, reverse=True), size)
    return [c for c in choices if size < 2 or c[0] != c[1] or many[c[0]] > 1]


class _Takes:
    """What underfull patterns can give in return, `size` lengths each: their total, and that and the pattern's room together."""

    def __init__(self, size: int, capacity: int):
        self.size, self.capacity, self.used, self.gone = size, capacity, 0, 0
        self.total, self.reach, self.room, self.owner = (np.zeros(1024, np.int64) for _ in range(4))
        self.places: dict[int, tuple[int, list[Pattern]]] = {}

    def add(self, number: int, pattern: Pattern) -> None:
        own = _some_of(pattern, self.size)
        while self.used + len(own) > len(self.total):
            self.total, self.reach, self.room, self.owner = (np.concatenate([x, np.zeros_like(x)]) for x in (self.total, self.reach, self.room, self.owner))
        at = slice(self.used, self.used + len(own))
        self.total[at] = [sum(c) for c in own]
        self.room[at] = self.capacity - sum(pattern)
        self.reach[at], self.owner[at] = self.total[at] + self.room[at], number
        self.places[number] = self.used, own
        self.used += len(own)

    def show(self, number: int, there: bool) -> None:
        first, own = self.places[number]
        at = slice(first, first + len(own))
        self.reach[at] = self.total[at] + self.room[at] if there else -1

    def drop(self, number: int) -> None:
        self.show(number, False)
        self.gone += len(self.places.pop(number)[1])
        if self.gone > 4096 and 2 * self.gone > self.used:  # close up
            old, self.used, self.gone = self.places, 0, 0
            columns = [x.copy() for x in (self.total, self.reach, self.room, self.owner)]
            self.places = {}
            for n, (first, own) in old.items():
                self.places[n] = self.used, own
                for mine, was in zip((self.total, self.reach, self.room, self.owner), columns, strict=True):
                    mine[self.used : self.used + len(own)] = was[first : first + len(own)]
                self.used += len(own)

    def best(self, given: int, room: int) -> tuple[int, int, Pattern] | None:
        """(room left, pattern's number, lengths) of the return for `given` that fills a pattern of at most `room` most."""
        reach = self.reach[: self.used]
        fits = np.flatnonzero((reach >= given) & (self.total[: self.used] < given) & (self.room[: self.used] <= room))
        if not len(fits):
            return None
        at = int(fits[np.argmin(reach[fits])])
        number = int(self.owner[at])
        first, own = self.places[number]
        return int(reach[at]) - given, number, own[at - first]


def _without(pattern: Pattern, gone: Pattern, new: Pattern) -> Pattern:
    left = Counter(pattern)
    left.subtract(gone)
    left.update(new)
    return tuple(sorted(left.elements(), reverse=True))


def local_search(bins: Counter[Pattern], capacity: int, patterns: int = 500_000) -> Counter[Pattern]:
    """Empty bins by moves and swaps between underfull patterns.

    The emptiest pattern gives: one length or two (a move), one for one, two for one, or one for two, to a pattern that is
    at least as full; of all such steps the one that leaves least room there. Each step raises the sum of squared fills, so
    the search ends: when no pattern has a step left, or the bins are as few as their total allows. A step is taken as
    often as both patterns allow at once. Above `patterns` patterns a step must use up both of its own, which bounds the plan.
    """
    bins = Counter(bins)
    count, fewest = bins.total(), -(-sum(sum(p) * n for p, n in bins.items()) // capacity)
    takes = [_Takes(size, capacity) for size in range(3)]
    of: dict[int, Pattern] = {}
    number: dict[Pattern, int] = {}
    queue: list[tuple[int, int]] = []
    fresh = 0

    def enter(pattern: Pattern) -> None:
        nonlocal fresh
        if sum(pattern) < capacity and pattern not in number:
            number[pattern], of[fresh] = fresh, pattern
            for t in takes:
                t.add(fresh, pattern)
            heappush(queue, (sum(pattern), fresh))
            fresh += 1

    def leave(pattern: Pattern) -> None:
        if pattern in number:
            for t in takes:
                t.drop(number[pattern])
            del of[number.pop(pattern)]

    for pattern in sorted(bins):
        enter(pattern)
    moved = True
    while count > fewest:
        if not queue:
            if not moved:
                break
            moved = False
            queue = [(sum(p), n) for p, n in number.items()]
            heapify(queue)
        fill, n = heappop(queue)
        if n not in of:
            continue
        a = of[n]
        alone = bins[a] < 2  # a bin does not give to itself
        for t in takes if alone else ():
            t.show(n, False)
        step: tuple[int, int, Pattern, Pattern] | None = None
        for size, back in ((1, 0), (1, 1), (2, 0), (2, 1), (1, 2)):
            for give in _some_of(a, size):
                found = takes[back].best(sum(give), capacity - fill)
                if found and (step is None or found[0] < step[0]):
                    step = *found, give
                    if not step[0]:
                        break
            if step and not step[0]:
                break
        for t in takes if alone else ():
            t.show(n, True)
        if step is None:
            continue
        _, other, take, give = step
        b = of[other]
        times = bins[a] // 2 if a == b else min(bins[a], bins[b])
        if len(bins) > patterns and not (a != b and bins[a] == bins[b]):
            continue
        for old in (a, b):
            bins[old] -= times
            if not bins[old]:
                del bins[old]
                leave(old)
        for new in (_without(a, give, take), _without(b, take, give)):
            if new:
                bins[new] += times
                enter(new)
            else:
                count -= times
        if a in number:
            heappush(queue, (fill, n))
        moved = True
    return bins


def pack_histogram(histogram: dict[int, int], capacity: int) -> Counter[Pattern]:
    """The better of two searches, from best fit in arrival order and from best fit decreasing; a search never adds bins to its start."""
    fewest = -(-sum(k * n for k, n in histogram.items()) // capacity)
    best: Counter[Pattern] | None = None
    for order in (arrival, lambda length: -length):
        found = local_search(best_fit(histogram, capacity, order), capacity)
        if best is None or found.total() < best.total():
            best = found
        if best.total() <= fewest:
            break
    return best


def plan(histogram: dict[int, int], capacity: int = 4096) -> dict[str, np.ndarray]:
    """For each length, runs of ranks that go to equal places: the arrays that `place` reads."""
    bins = pack_histogram({k: v for k, v in histogram.items() if v}, capacity)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter[int] = Counter()
    base = 0
    for pattern in sorted(bins, reverse=True):
        times, offset = bins[pattern], 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            runs.setdefault(length, []).append((used[length], base, each, offset))
            used[length] += each * times
            offset += each * length
        base += times
    flat = [(length, *run) for length in sorted(runs) for run in runs[length]]
    columns = np.array(flat, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "base", "each", "offset"), columns, strict=True))


def place(arrays: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sequence_id and offset of pieces by length and rank."""
    # ranks stay below 2**48 and lengths below 2**15
    key = (arrays["length"] << 48) + arrays["rank"]
    at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
    inside = rank - arrays["rank"][at]
    each = arrays["each"][at]
    return arrays["base"][at] + inside // each, arrays["offset"][at] + inside % each * length


def pack(pieces: DataFrame, capacity: int = 4096, cell: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to materialised pieces; `cell`: rows of a (length, salt) group."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    arrays = pieces.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    salts = max(32, -(-max(histogram.values(), default=0) // cell))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(salts)))
    cells = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    first = cells.select(
        F.col("length").alias("c_length"),
        F.col("salt").alias("c_salt"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("first"),
    )
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "row", "piece"))
    ranked = (
        salted.withColumn("inside", inside)
        .join(first, (F.col("length") == F.col("c_length")) & (F.col("salt") == F.col("c_salt")))
        .select("doc_id", "row", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("inside") - 1).alias("rank"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            sequence, offset = place(arrays.value, length, batch.column("rank").to_numpy())
            kept = [batch.column(c) for c in ("doc_id", "row", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(cut(docs.select("doc_id", "text"), vocabulary, capacity, end_id), "pieces")
    return pack(pieces, capacity).drop("row")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack `documents` into sequences of 4096 ids of the word vocabulary."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
