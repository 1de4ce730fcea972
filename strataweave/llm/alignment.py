"""Alignment of two tokenizers over the same bytes.

Python does no more than tokenise: a task cuts its texts into units that no token spans (pre-tokens of the byte-level vocabulary, words with
their leading spaces for the pieces), encodes each distinct unit once, and gives each text's ids and the byte offsets where its tokens end,
for both tokenizers. All else is Spark's array functions on these four arrays:

* `array_intersect` of the end arrays gives the places where groups end.
* Both end arrays, each end packed with its side and number, are sorted into one. At a place of that array, the element's own number and the
  number of elements before it name the token of either side that covers the bytes before that end. So each end but the second of two equal
  ones is one link, and the two equal ones end a group: one `transform` finds links and group ends, in linear time for any length of group.
* A `sequence` over the groups and `slice` of the id arrays spell out the groups.

Links are then rows, one for each occurrence, and are counted by id pair. Counts go back to the documents by join: the most frequent pairs, at
most HELD of them, are broadcast, and the rest, each of which is rare, meet their counts by shuffle; so no pair's rows gather in one task.
The highest count of each piece id, at most one row an id, is broadcast.

Defined results: null and empty texts, and texts whose tokens' bytes are not the text's with a space before it (those with U+2581, for one), have no tokens: zeros, and '' for
groups_sha256. Special strings inside texts are plain text. Repeated rows and repeated or null ids are documents of their own, and count as
such. Texts are whole, however long. An empty table gives no rows. Columns beside doc_id and text never enter.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import blocks, strings, table
from strataweave.llm.packing import _Words
from strataweave.llm.token_count import begins, symbols
from strataweave.session import materialize

HELD = 1 << 19  # pairs whose counts are broadcast (about 40 bytes each)
WRONG = 0xFFFFFFFF  # stands for the tokens of a unit whose bytes they do not give
ARRAYS = "doc_id bigint, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>"
BLOCK = 1_000_000  # bytes of text that a task tokenises at once
KNOWN, YOUNG = 400_000, 50_000  # units whose ids a worker keeps, of either tokenizer


class _Units(_Words):
    """Ids by unit, each distinct unit encoded once a worker (as long as the table is not full)."""

    most, young_most = KNOWN, YOUNG

    def __init__(self):
        self.reset()

    def _encode(self, units: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for unit, ids in zip(units, self._encode(units), strict=True):
            found.append(ids if b"".join([self.bytes[i] for i in ids]) == unit.encode() else [WRONG])
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.array([i for ids in found for i in ids], np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        first = self.used + np.cumsum(size) - size
        self.used += len(flat)
        return first, size

    @functools.cached_property
    def widths(self) -> np.ndarray:
        return np.array([len(b) for b in self.bytes], np.int64)


class ByteLevel(_Units):
    """A byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        raw = {i: bytes(letter[c] for c in t) for t, i in self.tokenizer.get_vocab().items() if all(c in letter for c in t)}
        self.bytes = [raw.get(i, b"") for i in range(self.tokenizer.get_vocab_size())]
        super().__init__()

    def _encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts' bytes, where their units begin and each text's first unit; a separator after each text is a unit of its own."""
        stream = "\n".join(texts) + "\n"
        points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        marks = np.flatnonzero(begins(symbols(points, ends)))
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width)])
        return stream.encode(), place[marks], np.searchsorted(marks, ends)


class Pieces(_Units):
    """A piece vocabulary of the sentencepiece library that puts a space before a text and whose pieces hold spaces only at their beginning."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        number = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in number]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece spans a space: texts cannot be cut into words")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(number, pieces, strict=True)]
        self.space = self.model.piece_to_id("▁")
        super().__init__()

    def _encode(self, units: list[str]) -> list[list[int]]:
        # The library adds the first space itself; an empty text would get none.
        return [ids or [self.space] for ids in self.model.encode([u[1:] for u in units], num_threads=1)]

    def cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """As of ByteLevel; a unit is a run of spaces and what follows up to the next space. Texts begin with a space."""
        data = "\n".join(texts).encode() + b"\n"
        raw = np.frombuffer(data, np.uint8)
        size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        ends = np.cumsum(size + 1) - 1
        space = raw == 32
        first = space & ~np.concatenate([[False], space[:-1]])
        first[ends] = True
        starts = np.flatnonzero(first)
        return data, starts, np.searchsorted(starts, ends)


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str) -> _Units:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def encode(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array and where each text's begin (one more entry than texts); WRONG marks a text whose bytes the tokens do not give."""
    known = _tokenizer(path)
    data, starts, last = known.cut(texts)
    edges = np.append(starts, len(data)).astype(np.int64)
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
    codes = units.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first, size = known.places(strings(units.dictionary))
    first, size = first[codes], size[codes]
    size[last] = 0  # separators
    before = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    ids = known.ids[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
    return ids, np.concatenate([[0], before[last]])


def _ends(ids: np.ndarray, edges: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Byte offsets inside its text where each token ends."""
    through = np.concatenate([[0], np.cumsum(widths[ids])])
    return through[1:] - np.repeat(through[edges[:-1]], np.diff(edges))


def tokenise(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, ids and ends of both tokenizers for every row of `docs` (doc_id, text); empty arrays for texts without tokens."""

    def lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values.astype(np.int32)))

    def keep(ids: np.ndarray, edges: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(edges)
        return ids[np.repeat(good, sizes)], np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for block in blocks(batches, chars=BLOCK):
            texts = [" " + (t or "") for t in block.column("text").to_pylist()]
            good = np.array([len(t) > 1 for t in texts])
            found = [encode(texts, path) for path in (a, b)]
            for ids, edges in found:
                wrong = np.searchsorted(edges, np.flatnonzero(ids == WRONG), side="right") - 1
                good[wrong] = False
            columns = [block.column("doc_id")]
            for path, (ids, edges) in zip((a, b), found, strict=True):
                ids, edges = keep(ids, edges, good)
                columns += [lists(ids, edges), lists(_ends(ids, edges, _tokenizer(path).widths), edges)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ARRAYS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, ARRAYS)


def _span(ids: str, cuts: str, g: Column) -> Column:
    """The ids of one side of group `g`, with commas; most groups have one or two, which need no slice."""
    before, through = F.get(cuts, g), F.get(cuts, g + 1)
    first, second = F.get(ids, before).cast("string"), F.get(ids, before + 1).cast("string")
    # The slice is cast, not the array: what a lambda names once is put into it and would be cast anew for each group.
    more = F.array_join(F.slice(ids, before + 1, through - before).cast("array<string>"), ",")
    return F.when(through == before + 1, first).when(through == before + 2, F.concat(first, F.lit(","), second)).otherwise(more)


def align(arrays: DataFrame, pieces: int) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the links (a id * pieces + b id, an int) of tokenised texts; `pieces`: ids of B."""
    side, low = 1 << 31, (1 << 31) - 1
    packed = lambda ends, extra: F.transform(ends, lambda e, i: F.shiftleft(e.cast("long"), 32) + i + F.lit(extra).cast("long"))
    pair = lambda i, j: F.get("a_ids", i) * F.lit(pieces) + F.get("b_ids", j)

    def step(x: Column, k: Column) -> Column:
        """A link; or, for the second of two equal ends, the number of A's and of B's tokens up to there, below zero."""
        own = x.bitwiseAND(F.lit(low)).cast("int")
        tied = F.shiftright(x, 32) == F.shiftright(F.get("both", k - 1), 32)
        a_side = x.bitwiseAND(F.lit(side).cast("long")) == 0
        group = -(F.shiftleft((k - own).cast("long"), 32) + own + 1)
        return F.when(a_side, pair(own, k - own).cast("long")).when(tied, group).otherwise(pair(k - own, own).cast("long"))

    merged = arrays.withColumn("both", F.sort_array(F.concat(packed("a_ends", 0), packed("b_ends", side))))
    found = merged.select(
        "doc_id", "a_ids", "b_ids", F.size("a_ids").cast("long").alias("n_a"), F.size("b_ids").cast("long").alias("n_b"),
        F.size(F.array_intersect("a_ends", "b_ends")).cast("long").alias("n_groups"), F.transform("both", step).alias("steps"),
    )
    cut = found.select(
        "doc_id", "n_a", "n_b", "n_groups", "a_ids", "b_ids",
        F.filter("steps", lambda x: x >= 0).cast("array<int>").alias("links"), F.filter("steps", lambda x: x < 0).alias("cuts"),
    )

    spans = cut.withColumns({
        "a_cuts": F.concat(F.array(F.lit(0)), F.transform("cuts", lambda x: F.shiftright(-x, 32).cast("int"))),
        "b_cuts": F.concat(F.array(F.lit(0)), F.transform("cuts", lambda x: (-x).bitwiseAND(F.lit(low)).cast("int"))),
    })
    spelled = lambda g: F.concat(_span("a_ids", "a_cuts", g), F.lit("|"), _span("b_ids", "b_cuts", g))
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_groups").cast("int") - 1), spelled), ";")
    return spans.select(
        "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"),
        F.when(F.col("n_groups") > 0, F.sha2(groups, 256)).otherwise("").alias("groups_sha256"), "links",
    )


def _frequent(counts: DataFrame, held: int) -> int:
    """The least count such that at most `held` pairs have it or more."""
    levels = counts.groupBy(F.floor(F.log2("n") * 8).alias("level")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least"))
    room, least = held, 1 << 62
    for row in levels.orderBy(F.desc("level")).collect():  # at most 512 rows
        room -= row["pairs"]
        if room < 0:
            break
        least = row["least"]
    return least


def counted(links: DataFrame, counts: DataFrame, held: int = HELD) -> DataFrame:
    """row, n_best and count_sum of rows with links (row, links), by counts (pair, n, best)."""
    least = _frequent(counts, held)
    often, rare = counts.where(F.col("n") >= least), counts.where(F.col("n") < least)
    each = links.select("row", F.explode("links").alias("pair"))
    total = [F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum")]
    parts = each.join(F.broadcast(often), "pair").groupBy("row").agg(*total)
    if rare.take(1):
        few = each.join(F.broadcast(often), "pair", "left_anti").groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times"))
        times = [(F.col("best").cast("long") * F.col("times")).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum")]
        parts = parts.unionByName(few.join(rare, "pair").select("row", *times)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return parts


def align_documents(docs: DataFrame, a: str, b: str, held: int = HELD) -> DataFrame:
    """One row per row of `docs` (doc_id, text): sizes, links with their corpus-wide counts, and the digest of the groups.

    `a` is a byte-level vocabulary (.json), `b` one of pieces (.model), in files that every worker can open.
    """
    pieces = _piece_count(b)
    found = materialize(align(tokenise(docs, a, b), pieces).withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = materialize(found.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    piece = F.pmod("pair", F.lit(pieces))
    highest = pairs.groupBy(piece.alias("piece")).agg(F.max("n").alias("highest"))  # at most one row a piece
    counts = pairs.withColumn("piece", piece).join(F.broadcast(highest), "piece").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    sums = counted(found.select("row", "links"), counts, held).withColumnRenamed("row", "of")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.drop("links").join(sums, F.col("row") == F.col("of"), "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def _piece_count(path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-level vocabulary of 50,257 ids against the 32,000 pieces, over `documents`."""
    import public_tokenizers

    return align_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
