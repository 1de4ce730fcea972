"""BPE ids of texts from content-defined chunks that documents share, and the texts decoded again.

A rolling hash over 32 bytes cuts texts where its top bits are zero, so equal passages fall into equal chunks wherever they stand. Steps:

1. Copies: texts are named by MD5. Of texts with many rows (the HELD most frequent) one row goes on; the rest have few rows each.
2. Chunks are counted by name. The HELD most frequent are encoded first and their ids broadcast (a bounded number of bounded chunks), so that
   no task meets a chunk that a large part of all texts hold.
3. Chunks of all texts go to partitions by their digest, packed and compressed by block; a partition encodes each distinct chunk once and
   sends its ids to the texts that hold it, packed again. Chunks of step 2 travel as references to their texts' partitions.
4. A text's partition puts its chunks in order and repairs the joins. White space ends every id of these vocabularies, so
   encodings of two cuttings agree exactly from a white space on. What lies between a chunk's last white space and the next one, in the next
   chunk or in one after it, is encoded again as one piece and takes the place of what both chunks had there: a join is
   repaired by going on until both sides agree. Chunks without white space are of that kind as a whole.
5. Ids are joined into texts of decimals and of tokens (a vocabulary without a decoder decodes to its tokens with blanks between) and named by SHA-256.
6. Rows meet their text's result by MD5: frequent texts by broadcast, others by shuffle.

Defined results: null and empty texts have no ids and the digest of nothing. Special strings in texts are their ids. Repeated rows and repeated or
null ids each give a row. Very long texts are whole; a text is assembled by one task. An empty table gives no rows. Columns beside doc_id and text never enter.
"""

from __future__ import annotations

import bz2
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import blocks, mix, release, table
from strataweave.llm.packing import encode_texts
from strataweave.session import materialize

LEAST, BITS, MOST = 256, 10, 16_384  # bytes of a chunk: at least, 2**BITS beyond that in the mean, at most
WINDOW = 32
BLOCK = 8_000_000  # bytes of text that a task cuts at once
PARTITION = 64 << 20  # bytes of text in a partition of chunks or of texts
HELD, OFTEN = 1024, 100  # names whose results are broadcast, and the rows that each has at least
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")

PACKED = "part int, packed binary"
CHUNKS = pa.schema([("digest", pa.binary(16)), ("text", pa.binary()), ("key", pa.binary(16)), ("seq", pa.int32())])
PIECES = pa.schema([("key", pa.binary(16)), ("seq", pa.int32()), ("digest", pa.binary(16)), ("head", pa.string()), ("ids", pa.binary()), ("tail", pa.string()), ("solid", pa.bool_())])
RESULT = "key binary, n_tokens bigint, ids_sha256 binary, decoded_sha256 binary"

Record = tuple[str, bytes, str, bool]  # head, ids between, tail, and whether it is all head


# ---- chunks --------------------------------------------------------------------------------------


@functools.cache
def _gear() -> np.ndarray:
    """A number for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte the hash of the WINDOW bytes that end there: doubled window by window."""
    hashed = _gear()[data]
    width = 1
    while width < WINDOW:
        wider = hashed.copy()
        wider[width:] += hashed[:-width] << np.uint32(width)
        hashed, width = wider, 2 * width
    return hashed


def cut(texts: list[bytes], least: int = LEAST, bits: int = BITS, most: int = MOST) -> list[list[bytes]]:
    """The chunks of each text (UTF-8, cut between characters)."""
    if not texts:
        return []
    stream = b"".join(texts)
    data = np.frombuffer(stream, np.uint8)
    inner = (data & 0xC0) == 0x80  # bytes inside a character
    at = np.flatnonzero(rolling(data) >> np.uint32(32 - bits) == 0) + 1
    at = at[at < len(data)]
    at = at[~inner[at]]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = ends - np.fromiter(map(len, texts), np.int64, len(texts))
    low, high = np.searchsorted(at, starts + max(least, WINDOW)), np.searchsorted(at, ends)
    at = at.tolist()
    out = []
    for start, end, i, j in zip(starts.tolist(), ends.tolist(), low.tolist(), high.tolist(), strict=True):
        edges = [start]
        for place in [*at[i:j], end]:
            while place - edges[-1] > most:
                forced = edges[-1] + most
                while inner[forced]:
                    forced -= 1
                edges.append(forced)
            if place == end or place - edges[-1] >= least:
                edges.append(place)
        out.append([stream[a:b] for a, b in zip(edges, edges[1:], strict=False) if b > a])
    return out


def _name(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _short(names: list[bytes]) -> np.ndarray:
    """The first eight bytes of names, as numbers."""
    return np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)[:, 0] if names else np.empty(0, np.int64)


@functools.lru_cache(maxsize=1)
def _width(vocabulary: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else "<u4"


def encode_chunks(chunks: list[bytes], vocabulary: str) -> list[Record]:
    """What each chunk is wherever it stands: the ids between its first and last white space, and its text before and after."""
    parts = []
    for chunk in chunks:
        plain = chunk.translate(SPACES)
        first, last = plain.find(b" "), plain.rfind(b" ")
        parts.append((chunk[:first], chunk[first:last], chunk[last + 1 :]) if first >= 0 else (chunk, b"", b""))
    ids, edges = encode_texts(pa.array([p[1].decode() for p in parts], pa.string()), vocabulary)
    raw, size = ids.astype(_width(vocabulary)), edges.tolist()
    return [(p[0].decode(), raw[a:b].tobytes(), p[2].decode(), p[0] == chunk) for p, chunk, a, b in zip(parts, chunks, size[:-1], size[1:], strict=True)]


# ---- packed rows: by bzip2, which takes a sixth less of the network than zstd does for texts and ids -----


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return bz2.compress(sink.getvalue().to_pybytes())


def _unpack(packed: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(bz2.decompress(packed.as_py())).read_all()


def _deal(part: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch by partition, packed, in their order."""
    order = np.argsort(part, kind="stable")
    batch, part = batch.take(pa.array(order)), part[order]
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int32()), pa.array([_pack(batch.slice(a, b - a))], pa.binary())], ["part", "packed"])


def _texts(block: pa.RecordBatch) -> Iterator[tuple[bytes, list[bytes]]]:
    """Name and chunks of each different text of a block."""
    held = {k: t.encode() for k, t in zip(block.column("key").to_pylist(), block.column("text").to_pylist(), strict=True) if t}
    yield from zip(held, cut(list(held.values())), strict=True)


def chunk_names(texts: DataFrame) -> DataFrame:
    """name (eight bytes as a number) of every chunk of texts (key, text), and a number for the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, chars=BLOCK):
            names, keys = [], []
            number = dict(zip(block.column("key").to_pylist(), block.column("number").to_pylist(), strict=True))
            for key, chunks in _texts(block):
                names += map(_name, chunks)
                keys += [number[key]] * len(chunks)
            yield pa.RecordBatch.from_arrays([pa.array(_short(names)), pa.array(keys, pa.int64())], ["name", "number"])

    return texts.select("key", "text", F.xxhash64("key").alias("number")).mapInArrow(run, "name bigint, number bigint")


def frequent_chunks(texts: DataFrame, vocabulary: str) -> dict[bytes, Record]:
    """The HELD most frequent chunks, encoded."""
    spark = texts.sparkSession
    often = _often(chunk_names(texts), "name", F.min("number").alias("of"))
    rows = often.collect()  # at most HELD
    if not rows:
        return {}
    wanted = spark.sparkContext.broadcast({r["name"] for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, chars=BLOCK):
            found = {name: c for _, chunks in _texts(block) for c in chunks for name in [_name(c)]}
            kept = [c for n, c in found.items() if _short([n])[0] in wanted.value]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], ["chunk"])

    holders = spark.createDataFrame([(r["of"],) for r in rows], "of bigint").distinct()
    some = texts.withColumn("of", F.xxhash64("key")).join(F.broadcast(holders), "of", "left_semi").select("key", "text").mapInArrow(run, "chunk binary").distinct()
    chunks = [bytes(r["chunk"]) for r in some.collect()]  # HELD chunks of at most MOST bytes
    return dict(zip(map(_name, chunks), encode_chunks(chunks, vocabulary), strict=True))


def _often(df: DataFrame, column: str, *more) -> DataFrame:
    """The HELD most frequent values of a column that have OFTEN rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), *more)
    return counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), column).limit(HELD)


# ---- the three exchanges ---------------------------------------------------------------------------


def deal_chunks(texts: DataFrame, parts: int, known) -> DataFrame:
    """The chunks of texts (key, text), packed by their digest's partition, each text of a chunk once a block; `known` ones by their text's partition, without their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, chars=BLOCK):
            digests, bodies, keys, numbers, light = [], [], [], [], []
            seen: set[bytes] = set()
            for key, chunks in _texts(block):
                for n, chunk in enumerate(chunks):
                    digest = _name(chunk)
                    digests.append(digest)
                    light.append(digest in known.value)
                    bodies.append(None if light[-1] or digest in seen else chunk)
                    keys.append(key)
                    numbers.append(n)
                    seen.add(digest)
            if digests:
                part = np.where(light, _short(keys) % parts, _short(digests) % parts)
                yield from _deal(part, pa.RecordBatch.from_arrays([pa.array(digests, pa.binary(16)), pa.array(bodies, pa.binary()), pa.array(keys, pa.binary(16)), pa.array(numbers, pa.int32())], schema=CHUNKS))
        release()

    return texts.mapInArrow(run, PACKED)


def encode_dealt(dealt: DataFrame, vocabulary: str, parts: int) -> DataFrame:
    """Chunks of partitions encoded once each, packed by their texts' partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known: dict[bytes, Record] = {}
        rows: list[tuple] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)]
            yield from _deal(_short([r[0] for r in rows]) % parts, pa.RecordBatch.from_arrays(columns, schema=PIECES))
            rows.clear()

        for batch in batches:
            for packed in batch.column("packed"):
                some = _unpack(packed)
                digests, bodies = some["digest"].to_pylist(), some["text"].to_pylist()
                new = {d: b for d, b in zip(digests, bodies, strict=True) if b is not None and d not in known}
                known.update(zip(new, encode_chunks(list(new.values()), vocabulary), strict=True))
                for digest, key, n in zip(digests, some["key"].to_pylist(), some["seq"].to_pylist(), strict=True):
                    own = known.get(digest)  # none: one of the most frequent, sent as it is
                    rows.append((key, n, *((digest, None, None, None, None) if own is None else (None, *own))))
                    size += len(own[1]) if own else 16
                if size > BLOCK:
                    yield from send()
                    size = 0
        if rows:
            yield from send()
        release()

    return dealt.repartitionById(parts, F.col("part")).mapInArrow(run, PACKED)


@functools.lru_cache(maxsize=1)
def _spelled(vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Decimals and tokens by id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    if tokenizer.decoder is not None:
        raise ValueError("the vocabulary's file names a decoder; tokens with blanks between are what one without gives")
    number = range(tokenizer.get_vocab_size())
    return np.array([str(i) for i in number], object), np.array([tokenizer.id_to_token(i) for i in number], object)


def join_chunks(texts: list[list[Record]], vocabulary: str) -> list[np.ndarray]:
    """The ids of texts from their chunks in order, joins repaired."""
    between: list[str] = []
    plans: list[list[bytes | int]] = []
    for chunks in texts:
        plan: list[bytes | int] = []
        begun: list[str] = []  # since the last white space

        def agree(plan=plan, begun=begun) -> None:
            if any(begun):
                plan.append(len(between))
                between.append("".join(begun))
            begun.clear()

        for head, ids, tail, solid in chunks:
            begun.append(head)
            if not solid:
                agree()
                plan.append(ids)
                begun.append(tail)
        agree()
        plans.append(plan)
    width = _width(vocabulary)
    again, edges = encode_texts(pa.array(between, pa.string()), vocabulary)
    again = again.astype(width)
    none = np.empty(0, width)
    return [np.concatenate([none, *(again[edges[x] : edges[x + 1]] if isinstance(x, int) else np.frombuffer(x, width) for x in plan)]) for plan in plans]


def assemble(sent: DataFrame, vocabulary: str, parts: int, known) -> DataFrame:
    """key, number of ids and digests of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tables = [_unpack(packed) for batch in batches for packed in batch.column("packed")]
        if not tables:
            return
        pieces = pa.concat_tables(tables).combine_chunks()
        del tables
        keys = pieces["key"].combine_chunks().dictionary_encode()
        code = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((pieces["seq"].to_numpy(), code))
        place = (code << 32) + pieces["seq"].to_numpy()
        order = order[np.concatenate([[True], np.diff(place[order]) != 0])]  # a text that two tasks cut came twice
        code = code[order]
        edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        decimal, token = _spelled(vocabulary)
        sizes = pa.compute.fill_null(pa.compute.binary_length(pieces["ids"]), 0).to_numpy()[order]
        first = 0
        while first < len(edges) - 1:
            last, size = first, 0
            while last < len(edges) - 1 and (last == first or size < BLOCK):
                size += int(sizes[edges[last] : edges[last + 1]].sum())
                last += 1
            some = pieces.take(pa.array(order[edges[first] : edges[last]]))
            records = [
                known.value[d] if d is not None else r
                for d, *r in zip(*(some[c].to_pylist() for c in ("digest", "head", "ids", "tail", "solid")), strict=True)
            ]
            base = edges[first]
            texts = [records[edges[i] - base : edges[i + 1] - base] for i in range(first, last)]
            out: list[list] = [[], [], [], []]
            for i, ids in zip(range(first, last), join_chunks(texts, vocabulary), strict=True):
                sha = [hashlib.sha256(" ".join(of[ids].tolist()).encode()).digest() for of in (decimal, token)]
                for column, value in zip(out, (keys.dictionary[int(code[edges[i]])].as_py(), len(ids), *sha), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], [c.split()[0] for c in RESULT.split(", ")])
            first = last
        release()

    return sent.repartitionById(parts, F.col("part")).mapInArrow(run, RESULT)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of `docs` (doc_id, text).

    `vocabulary` is a tokenizer's JSON file, which every worker can open; white space must end its ids.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    rows = materialize(named.select("doc_id", "key", F.octet_length("text").alias("size")), "names")
    often = materialize(_often(rows, "key", F.min("doc_id").alias("least")), "often")  # at most HELD
    first = F.col("n").isNull() | F.col("least").isNull() | (F.col("doc_id") == F.col("least"))
    texts = named.join(F.broadcast(often), "key", "left").where(first).select("key", "text")
    known = spark.sparkContext.broadcast(frequent_chunks(texts, vocabulary))
    total = rows.agg(F.sum("size")).head()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))
    sent = encode_dealt(deal_chunks(texts, parts, known), vocabulary, parts)
    found = materialize(assemble(sent, vocabulary, parts, known), "encoded")
    few = rows.join(F.broadcast(often), "key", "left_anti").join(found, "key", "left")
    many = rows.join(F.broadcast(often), "key", "left_semi").join(F.broadcast(found.join(F.broadcast(often), "key", "left_semi")), "key", "left")
    empty = hashlib.sha256(b"").hexdigest()
    out = few.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(many.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    digest = lambda c: F.coalesce(F.lower(F.hex(c)), F.lit(empty)).alias(c)
    return out.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), digest("ids_sha256"), digest("decoded_sha256"))


def op11_bpe_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of `documents` by the word vocabulary of 49,408 ids, and what they decode to."""
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
