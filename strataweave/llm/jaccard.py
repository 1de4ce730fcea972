"""N-gram Jaccard join by grouped prefixes.

1. A table of counters over hashed n-grams, of fixed size, orders n-grams rare first. Any
   order common to all sets keeps the prefix filter exact; rare first keeps the lists short.
2. Each text becomes the set of 64-bit hashes of its word n-grams, named by a 128-bit hash; its prefix holds the n-grams,
   rare first, of which two sets that reach the threshold share one. Rows with one set are one set. Sets with the same prefix and
   size are one group.
3. Each group posts its prefix once. Within a list only pairs of groups whose (size, place) can still reach the threshold go on.
   Lists of at most SHORT groups give all such pairs. A longer list gives the pairs with its first
   group only. Lists of frequent n-grams are dealt over several salts, whose first groups meet one another.
4. Group pairs are expanded: the first member of one meets the first member of the other, and of each group the rest meet its
   first. Each set has a bitmap of four to eight bits per n-gram; bits in which two bitmaps differ bound the sets'
   common n-grams from above, which sifts most pairs. The pairs left are verified on the whole sets, and links become components.
5. What those do not join is expanded whole: members of paired groups, of one group, and of long lists that are in different components
   by then meet, sift and are verified too. In a long list the smaller set of such a pair must reach sets of its own size,
   so a list without such sets has no pairs, and both sides meet by classes of sizes.

So no list is expanded into all its pairs, and nothing is dropped: a pair that reaches the
threshold is either verified or already in one component.

Defined results: null and empty texts and texts without words have no set and link with
nothing; texts with fewer than n words are one n-gram; very long texts are whole. Repeated rows are copies. Null ids take no
part as a name of a component unless a group has no other. Ties at the threshold link. Columns beside doc_id and text never enter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import add_up, blocks, fresh, hashes, mix, table, words
from strataweave.operators.components import connected_components
from strataweave.session import materialize

BITS, SEGMENTS = 22, 64  # counters (as a power of two), and the rows they are gathered in
SHORT = 32  # lists up to this size give all their pairs
SPLIT = 2048  # counted n-grams, above the mean counter, from which its list is dealt over salts
FLUSH = 600_000  # postings that a task holds before it hands them on
BITMAP = 26  # bits of the filter of candidate ids (as a power of two)
POSTINGS = "bucket int, token binary, gid binary, n binary, pos binary, salt binary"
FOUND = "token bigint, salt int, gid bigint, n int, pos int, other bigint, head boolean, long_list boolean"


def sets_of(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    codes, offsets, vocabulary = words(texts)
    of = hashes(vocabulary)[codes]
    if len(of) >= n:
        grams = np.zeros(len(of) - n + 1, np.uint64)
        for j in range(n):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + of[j : len(of) - n + 1 + j]
        grams = mix(grams)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(of[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def bitmap_of(own: np.ndarray) -> np.ndarray:
    """A bit for each n-gram, in a power of two of bits, as signed longs; halves fold into the next smaller size."""
    size = max(64, 1 << int(4 * len(own) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(own & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def name_of(own: np.ndarray, seed: int = 0) -> bytes:
    """A 128-bit name of a set, or of a prefix."""
    return xxhash.xxh3_128_digest(own.tobytes(), seed)


def _counted(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """log2 of the counters, one byte each, and the mean counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << BITS, np.uint32)
        for block in blocks(batches):
            for own in sets_of(block.column("text"), n):
                np.add.at(counters, (own >> np.uint64(64 - BITS)).astype(np.int64), 1)
        for k, part in enumerate(np.split(counters, SEGMENTS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["segment", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros((1 << BITS) // SEGMENTS, np.uint64)
        for packed in group["counts"].to_pylist():
            part = np.frombuffer(zlib.decompress(packed), np.uint8)
            total += part.view(np.uint32 if len(part) == total.nbytes // 2 else np.uint64)
        return pa.table({"idx": group["idx"][:1], "segment": group["segment"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    parts = docs.select("text").mapInArrow(run, "segment int, counts binary")
    levels, whole = np.zeros((SEGMENTS, (1 << BITS) // SEGMENTS), np.uint8), 0
    for row in add_up(parts, ["segment"], add, "idx bigint, segment int, counts binary", SEGMENTS).collect():  # SEGMENTS rows of fixed size
        total = np.frombuffer(zlib.decompress(row["counts"]), np.uint64)
        levels[row["segment"]] = np.ceil(np.log2(total.astype(np.float64) + 1)).astype(np.uint8)
        whole += int(total.sum())
    return levels.ravel(), whole >> BITS


def _profile(docs: DataFrame, n: int, share: tuple[int, int], levels) -> DataFrame:
    """doc_id, key, n, name, grp of each row; bits and prefix (n-grams, rare first) at least once for each set that a task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value[0]
        known: dict[bytes, bytes] = {}
        for block in blocks(batches):
            out: list[list] = [[] for _ in range(5)]
            for own in sets_of(block.column("text"), n):
                row = [len(own), None, None, None, None]
                if len(own):
                    row[1] = name_of(own)
                    row[2] = known.get(row[1])
                    if row[2] is None:
                        rare = level[(own >> np.uint64(64 - BITS)).astype(np.int64)]
                        prefix = own[np.argsort(rare, kind="stable")[: prefix_size(len(own), share)]]  # ties by hash: own is sorted
                        row[2:] = name_of(prefix, len(own)), bitmap_of(own), prefix.tobytes()
                        if len(known) >= 1 << 18:
                            known.clear()
                        known[row[1]] = row[2]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("key"), *columns], ["doc_id", "key", "n", "name", "grp", "bits", "prefix"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    return keyed.mapInArrow(run, "doc_id bigint, key bigint, n bigint, name binary, grp binary, bits array<bigint>, prefix binary")


def prefix_size(n: int, share: tuple[int, int]) -> int:
    """How many of a set's n-grams, rare first, meet every set that reaches the threshold."""
    return n - -(-n * share[0] // share[1]) + 1


def can_reach(na, pa_, nb, pb, share: tuple[int, int]):
    """Whether sets of these sizes may reach the threshold if their first common n-gram is at these places."""
    up, down = share
    least = -(-(na + nb) * up // (up + down))
    return (np.minimum(na, nb) * down >= np.maximum(na, nb) * up) & (1 + np.minimum(na - 1 - pa_, nb - 1 - pb) >= least)


def partners(n, pos, share: tuple[int, int]):
    """The size of the largest set that one of n n-grams may reach, if their first common one is at `pos`."""
    up, down = share
    return (n - pos) * (up + down) // up - n


def _postings(groups: DataFrame, levels, buckets: int) -> DataFrame:
    """The prefixes of all groups (gid, n, prefix), as arrays by bucket."""

    def pack(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        token, gid, size, pos, salt = (np.concatenate(c) for c in zip(*held, strict=True))
        bucket = (mix(token + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        out: list[list] = [[] for _ in range(6)]
        for part in np.split(order, cuts):
            out[0].append(int(bucket[part[0]]))
            for column, values in zip(out[1:], (token, gid, size, pos, salt), strict=True):
                column.append(values[part].tobytes())
        kinds = [pa.int32()] + [pa.binary()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["bucket", "token", "gid", "n", "pos", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, mean = levels.value
        base = (SPLIT + mean).bit_length()
        held: list[tuple] = []
        count = 0
        for batch in batches:
            for gid, size, raw in zip(batch.column("gid").to_pylist(), batch.column("n").to_pylist(), batch.column("prefix"), strict=True):
                prefix = np.frombuffer(raw.as_buffer(), np.uint64)
                k = len(prefix)
                often = level[(prefix >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.int64)
                salts = np.where(often > base, np.left_shift(1, np.maximum(often - base, 0)), 1)
                mine = mix(np.full(k, gid, np.int64).view(np.uint64)) % salts.astype(np.uint64)
                held.append((prefix, np.full(k, gid, np.int64), np.full(k, size, np.int32), np.arange(k, dtype=np.int32), mine.astype(np.int32) + (salts > 1)))
                count += k
                if count >= FLUSH:
                    yield from pack(held)
                    held, count = [], 0
        if held:
            yield from pack(held)

    return groups.select("gid", "n", "prefix").mapInArrow(run, POSTINGS)


def _lists(share: tuple[int, int]):
    """Reducer of a bucket: candidate pairs of its lists, and the members of long or salted lists."""
    kinds = {"token": pa.int64(), "salt": pa.int32(), "gid": pa.int64(), "n": pa.int32(), "pos": pa.int32(), "other": pa.int64(), "head": pa.bool_(), "long_list": pa.bool_()}

    def reduce(group: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in group[c]])
        token, gid, n, pos, salt = (read(c, t) for c, t in (("token", np.uint64), ("gid", np.int64), ("n", np.int32), ("pos", np.int32), ("salt", np.int32)))
        order = np.lexsort((gid, pos, salt, token))  # a list begins with the group that has the fewest rarer n-grams
        token, gid, n, pos, salt = token[order], gid[order], n[order].astype(np.int64), pos[order].astype(np.int64), salt[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(token)))
        run_size, first = np.repeat(size, size), np.repeat(start, size)
        out: list[dict] = []

        def emit(a, b, head, long_list):
            out.append({"token": token[a].view(np.int64), "salt": salt[a], "gid": gid[a], "n": n[a].astype(np.int32), "pos": pos[a].astype(np.int32), "other": gid[b], "head": head, "long_list": np.full(len(a), long_list)})

        at = np.flatnonzero((run_size > 1) & (run_size <= SHORT) & (salt == 0))
        for step in range(1, SHORT):
            at = at[at + step < len(token)]
            at = at[first[np.minimum(at + step, len(token) - 1)] == first[at]]
            if not len(at):
                break
            a, b = at, at + step
            fit = can_reach(n[a], pos[a], n[b], pos[b], share)
            emit(a[fit], b[fit], np.zeros(np.count_nonzero(fit), bool), False)
        # In a pair the smaller set reaches sets of its own size: lists and members without such a partner end here.
        most = partners(n, pos, share)
        least = np.repeat(np.minimum.reduceat(np.where(most >= n, n, np.iinfo(np.int64).max), start), size)
        far = np.flatnonzero((run_size > SHORT) & (salt == 0) & (most >= least) | (salt > 0))
        if len(far):
            centre = first[far]
            fit = can_reach(n[far], pos[far], n[centre], pos[centre], share)
            emit(far, np.where(fit, centre, far), far == centre, True)
        if not out:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        return pa.table({k: pa.array(np.concatenate([x[k] for x in out]), t) for k, t in kinds.items()})

    return reduce


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of each id: a filter of fixed size."""
    part = 1 << (BITMAP - 6)

    def mark(group: pa.Table) -> pa.Table:
        bits = np.zeros(part, bool)
        bits[group["at"].to_numpy()] = True
        return pa.table({"segment": group["segment"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP))
    places = ids.select((h / part).cast("int").alias("segment"), (h % part).cast("int").alias("at")).distinct()
    out = np.zeros((64, part // 8), np.uint8)
    for row in places.groupBy("segment").applyInArrow(mark, "segment int, bits binary").collect():  # 64 rows of fixed size
        out[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _sets(docs: DataFrame, sets: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(sid, own) for the sets whose sid is in `ids`, from one document of each."""
    wanted = materialize(sets.join(ids, "sid", "left_semi").select("doc_id", F.col("name").alias("w_name"), "sid"), "wanted")
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = bits.value
        for batch in batches:
            at = batch.column("at").to_numpy()
            found = np.flatnonzero(table_[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            if not len(found):
                continue
            for block in blocks(iter([batch.take(pa.array(found))])):
                own = sets_of(block.column("text"), n)
                names = pa.array([name_of(x) if len(x) else None for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), names, pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], ["r_id", "name", "own"])

    hashed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP)).alias("at"))
    rows = hashed.mapInArrow(run, "r_id bigint, name binary, own array<bigint>")
    # Ids that share a bit and ids with several texts go here; repeated rows are found again below.
    both = rows.join(wanted, (F.col("name") == F.col("w_name")) & F.col("r_id").eqNullSafe(F.col("doc_id")))
    return both.select("sid", "own")


def _sift(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) that may reach the threshold, by their sets' bitmaps."""
    own = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(own("v"), "v").join(own("u"), "u")
    size = F.least(F.size("bits_u"), F.size("bits_v"))

    def fold(c: str):  # sizes are within 3:4 of one another, so one halving is enough; others are not compared
        x = F.col(c)
        halves = F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseOR(q))
        return F.when(F.size(x) == size, x).when(F.size(x) == 2 * size, halves)

    differ = F.aggregate(F.zip_with(fold("bits_u"), fold("bits_v"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, x: a + x)
    up, down = share
    total = F.col("n_u") + F.col("n_v")
    fits = (total - F.coalesce(differ, F.lit(0))) * (up + down) >= 2 * up * total
    return both.filter(fits).select("u", "v")


def _verify(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) of sets that reach the threshold."""
    left = sets.select(F.col("sid").alias("u"), F.col("own").alias("own_u"))
    right = sets.select(F.col("sid").alias("v"), F.col("own").alias("own_v"))
    both = pairs.join(right, "v").join(left, "u")
    common = F.size(F.array_intersect("own_u", "own_v"))
    whole = F.size("own_u") + F.size("own_v") - common
    return both.filter(common * share[1] >= whole * share[0]).select("u", "v").distinct()


def _across(lists: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) of sets in one list (token, sid, n, pos, comp) and different components, where they can reach the threshold."""
    up, down = share
    lists = lists.withColumn("most", F.expr(f"(n - pos) * {up + down} div {up} - n"))
    ends = lists.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or(F.col("most") >= F.col("n")).alias("some"))
    mixed = ends.filter("lo <> hi and some").select(F.col("token").alias("m_token"))
    rows = materialize(lists.join(mixed, F.col("token") == F.col("m_token"), "left_semi"), "mixed-lists")
    sizes = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy(F.col("token").alias("t")).agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
    # Classes of sizes: sets that may link are in one or in neighbouring ones.
    size_class = F.floor(F.log("n") / F.log(F.lit(down / up)) + 1e-9).cast("int")
    split = rows.join(main, F.col("token") == F.col("t")).select("token", "sid", "n", "pos", "comp", "most", (F.col("comp") == F.col("main")).alias("in_main"), size_class.alias("class"))
    split = materialize(split, "split-lists")
    # The smaller set of a pair reaches its own size; it meets sets of its class and the next.
    small = split.filter("most >= n").withColumn("class", F.explode(F.array("class", F.col("class") + 1)))
    small = small.select("token", "class", *(F.col(c).alias(f"{c}_b") for c in ("sid", "n", "comp", "most", "in_main")))

    def met(large: str, small_: str) -> DataFrame:
        both = split.filter(large).join(small.filter(small_), ["token", "class"])
        fits = f"comp <> comp_b AND (n_b < n OR n_b = n AND (most < n OR sid_b < sid)) AND n <= most_b AND n_b <= most AND n_b * {down} >= n * {up}"
        return both.filter(fits).select(F.least("sid", "sid_b").alias("u"), F.greatest("sid", "sid_b").alias("v"))

    return met("true", "not in_main_b").union(met("not in_main", "in_main_b")).distinct()


def jaccard_classes(docs: DataFrame, n: int = 5, share: tuple[int, int] = (3, 4), bucket_postings: int = 400_000) -> DataFrame:
    """doc_id, key (xxhash64 of the text), n_shingles, component_id, class_key for every row of `docs` (doc_id, text).

    `class_key` names the class whatever its ids are; it is null for rows without words.

    `share`: the least Jaccard similarity, as a fraction. `bucket_postings`: postings that a
    reducer takes on average.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    levels = spark.sparkContext.broadcast(_counted(docs, n))
    profile = materialize(_profile(docs, n, share, levels), "profile")
    named = profile.filter("name is not null")
    sets = named.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.max("grp").alias("grp"))
    sets = materialize(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")
    groups = named.select("grp", "n", "prefix").groupBy("grp").agg(F.max("n").alias("n"), F.max("prefix").alias("prefix"))
    groups = materialize(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
    members = materialize(sets.select("sid", "grp").join(groups.select(F.col("grp").alias("g_grp"), "gid"), F.col("grp") == F.col("g_grp")).select("sid", "gid"), "members")
    heads = materialize(members.groupBy("gid").agg(F.min("sid").alias("head"), F.count(F.lit(1)).alias("size")), "heads")

    # Pairs of groups.
    postings = groups.agg(F.sum(F.octet_length("prefix") / 8).alias("n")).first()["n"] or 0
    buckets = max(24, -(-int(postings) // bucket_postings))
    posted = _postings(groups, levels, buckets)
    found = materialize(posted.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_lists(share), FOUND), "lists")
    long_lists = found.filter("long_list")
    salted = long_lists.filter("salt > 0 and head").select("token", "gid", "pos")
    centre = salted.groupBy(F.col("token").alias("c_token")).agg(F.min_by("gid", F.struct("pos", "gid")).alias("centre"))
    meet = salted.join(centre, F.col("token") == F.col("c_token")).filter("gid <> centre").select(F.col("gid").alias("g"), F.col("centre").alias("h"))
    ordered = lambda d: d.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"))
    pairs_of = ordered(found.filter("gid <> other").select(F.col("gid").alias("g"), F.col("other").alias("h")).union(meet)).distinct()
    group_pairs = materialize(pairs_of, "group-pairs")

    # Expanded to the groups' first members, and from those to the others of their group.
    first = lambda c: heads.select(F.col("gid").alias(c), F.col("head").alias(f"first_{c}"), F.col("size").alias(f"size_{c}"))
    met = materialize(group_pairs.join(first("g"), "g").join(first("h"), "h"), "group-pairs-sized")
    shared = heads.filter("size > 1")
    inner = members.join(shared, "gid").filter("sid <> head").select(F.col("head").alias("u"), F.col("sid").alias("v"))
    flat = lambda d: d.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = flat(met.select(F.col("first_g").alias("u"), F.col("first_h").alias("v"))).union(flat(inner))
    pairs = materialize(pairs, "pairs")

    def linked(some: DataFrame, step: str) -> DataFrame:
        sifted = materialize(_sift(some, sets, share), f"pairs-sifted-{step}")
        ends = sifted.select(F.col("u").alias("sid")).union(sifted.select(F.col("v").alias("sid"))).distinct()
        own = materialize(_sets(docs, sets, ends, n), f"candidate-sets-{step}")
        return materialize(_verify(sifted, own, share), f"links-{step}")

    links = linked(pairs, "first")
    labels = materialize(connected_components(links), "labels")

    # What is not in one component yet: long lists, groups of several sets, and pairs with such groups.
    crowded = met.filter("size_g > 1 or size_h > 1")
    if shared.take(1) or long_lists.take(1):
        of = lambda c: labels.select(F.col("node").alias(f"node_{c}"), F.col("component").alias(c))
        comp = lambda d, sid, c: d.join(of(c), F.col(sid) == F.col(f"node_{c}"), "left").withColumn(c, F.coalesce(c, sid)).drop(f"node_{c}")
        in_lists = long_lists.select("token", "gid", "n", "pos").distinct().join(members, "gid").select("token", "sid", "n", "pos")
        sized = sets.select(F.col("sid").alias("s_sid"), "n")
        in_groups = members.join(shared.select("gid"), "gid", "left_semi").join(sized, F.col("sid") == F.col("s_sid"))
        in_groups = in_groups.select(F.xxhash64(F.lit("group"), "gid").alias("token"), "sid", F.col("n").cast("int").alias("n"), F.lit(0).alias("pos"))
        more = _across(comp(in_lists.union(in_groups), "sid", "comp"), share)
        side = lambda c: members.select(F.col("gid").alias(c), F.col("sid").alias(f"sid_{c}"))
        whole = comp(comp(crowded.select("g", "h").join(side("g"), "g").join(side("h"), "h"), "sid_g", "comp_g"), "sid_h", "comp_h")
        wide = flat(whole.filter("comp_g <> comp_h").select(F.col("sid_g").alias("u"), F.col("sid_h").alias("v")))
        more = materialize(more.union(wide).distinct().join(pairs, ["u", "v"], "left_anti"), "pairs-across")
        if more.take(1):
            links = links.union(linked(more, "across"))
            labels = materialize(connected_components(links), "labels")
    # The least doc_id of a component: of the sets that are linked.
    of_sets = sets.join(labels, F.col("sid") == F.col("node"), "left").select("name", "doc_id", F.coalesce("component", "sid").alias("comp"))
    of_sets = materialize(of_sets, "classes")
    # Written before it is joined, so that both sides are dealt for the join and a large class can be split.
    least = materialize(of_sets.groupBy(F.col("comp").alias("l_comp")).agg(F.min("doc_id").alias("component_id")), "least-ids")
    classes = of_sets.join(least, F.col("comp") == F.col("l_comp")).select(F.col("name").alias("c_name"), "component_id", F.col("comp").alias("class_key"))
    rows = profile.select("doc_id", "key", "n", "name")
    return rows.join(classes, F.col("name") == F.col("c_name"), "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "class_key"
    )


def keep_one(docs: DataFrame, n: int = 5, share: tuple[int, int] = (3, 4)) -> DataFrame:
    """The rows of `docs`, with their columns, without the near copies: of each class the row with
    the least (doc_id, hash of the text) stays. Rows without words are in no class and stay."""
    classes = materialize(jaccard_classes(docs, n, share), "near-classes")
    first = F.min(F.struct("doc_id", "key"))
    kept = classes.filter("n_shingles > 0").groupBy("class_key").agg(first.alias("k"))
    bare = classes.filter("n_shingles = 0").select("doc_id", "key").distinct()
    names = docs.columns
    key, id_, kept_key = (fresh(names, c) for c in ("key", "id", "kept"))
    kept = materialize(kept.select("k.*").union(bare), "near-kept").select(F.col("doc_id").alias(id_), F.col("key").alias(kept_key))
    marked = docs.withColumn(key, F.xxhash64("text"))
    rows = marked.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(kept_key)), "left_semi")
    if classes.filter("n_shingles > 0").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1):
        # Rows that are the same twice: one of them, whole.
        words_ = F.col("text").rlike(r"[^\x20\x09-\x0D]")
        one = rows.filter(words_).groupBy("doc_id", key).agg(F.first(F.struct(*names)).alias("row")).select("row.*")
        rows = one.union(rows.filter(~F.coalesce(words_, F.lit(False))).select(*names))
    return rows.select(*names)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of `documents` linked by five-word shingles at 0.75 or more."""
    return jaccard_classes(table(spark, sf_dir, "documents", "doc_id", "text")).drop("key", "class_key")
