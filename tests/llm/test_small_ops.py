"""The operators on small tables: brute force, ties, repeated rows, nulls, empty tables, clashing columns."""

import base64
import gzip
import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataweave.llm import decontaminate, exact_dedup, html_text, jaccard, language_model, packing, quality, token_count, warc

SCHEMA = "doc_id bigint, text string, digest string, length string, key string, row string, fp string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta", "vo", "re") for b in ("n", "r", "st", "l", "nd", "m", "k", "x")]


def docs(spark, rows, path=None):
    """Documents with columns whose names operators use inside."""
    df = spark.createDataFrame([(i, t, "d", "l", "k", "r", "f") for i, t in rows], SCHEMA)
    if path is not None:
        df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return df


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def sample(rng, n=60):
    rows = [(i, prose(rng, rng.randint(0, 120))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, rows[5][1]), (n + 4, rows[5][1]), (n + 3, rows[5][1]), (None, rows[7][1]), (None, None), (n + 5, "long " * 20_000)]
    return rows


# ---- op3, op9 ------------------------------------------------------------------------------


def test_packing_is_whole_and_gapless(spark, tmp_path):
    rows = sample(random.Random(1))
    docs(spark, rows, tmp_path)
    got = packing.op3_best_fit_packing(spark, str(tmp_path)).collect()
    ids = [e.ids + [1] for e in Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    want = Counter((d, n, a, len(x[a : a + 4096]), zlib.crc32(struct.pack(f"<{len(x[a : a + 4096])}I", *x[a : a + 4096]))) for (d, _), x in zip(rows, ids, strict=True) for n, a in enumerate(range(0, len(x), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(map(len, ids)) // 4096)


def test_packing_of_nothing(spark, tmp_path):
    docs(spark, [], tmp_path)
    assert packing.op3_best_fit_packing(spark, str(tmp_path)).collect() == []


def test_local_search_empties_bins():
    bins = Counter({(60, 20): 1, (50, 30): 1, (40,): 1})  # 200 of 2 bins of 100
    out = packing.local_search(bins, 100)
    assert sorted(x for p, n in out.items() for x in p * n) == sorted(x for p, n in bins.items() for x in p * n)
    assert all(sum(p) <= 100 for p in out) and out.total() == 2


def _lengths(bins):
    total = Counter()
    for p, n in bins.items():
        for x in p:
            total[x] += n
    return total


@pytest.mark.parametrize("seed", range(4))
def test_the_search_makes_the_packing(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(3, 400): rng.randint(1, 60) for _ in range(60)} | {rng.randint(400, 900): rng.randint(1, 60) for _ in range(60)}
    first = packing.best_fit(histogram, 1000)
    out = packing.local_search(first, 1000)
    fewest = -(-sum(k * n for k, n in histogram.items()) // 1000)
    square = lambda bins: sum(sum(p) ** 2 * n for p, n in bins.items())
    assert _lengths(first) == _lengths(out) == histogram and all(sum(p) <= 1000 for p in out)
    assert square(out) > square(first) and fewest <= out.total() < first.total()  # without the search there are more bins
    if out.total() > fewest:  # then no move between two bins is left
        under = [p for p in out if sum(p) < 1000]
        assert not any(min(a) <= 1000 - sum(b) for a in under for b in under if sum(a) <= sum(b) and (a != b or out[a] > 1))


def test_the_search_keeps_to_its_bound_of_patterns():
    rng = random.Random(9)
    first = packing.best_fit({rng.randint(1, 900): rng.randint(1, 10**6) for _ in range(300)}, 1000)
    out = packing.local_search(first, 1000, patterns=len(first))
    assert len(out) <= len(first) + 2 and _lengths(out) == _lengths(first)


def test_best_fit_on_large_counts():
    out = packing.best_fit({50: 10**9, 30: 10**9, 20: 10**9 + 1}, 100)
    total = Counter()
    for p, n in out.items():
        assert sum(p) <= 100
        for x in p:
            total[x] += n
    assert total == {50: 10**9, 30: 10**9, 20: 10**9 + 1}


def test_token_counts_equal_the_library(spark, tmp_path):
    rng = random.Random(4)
    parts = [*"abst'rvel dm,.!#0123", "'s", "'re", "'ll", "  ", "\r\n", "\x1c", "\x85", "　", "é", "日本", "👍🏽", "<|endoftext|>", "ß", "İ"]
    rows = sample(rng) + [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 90)))) for i in range(800)]
    rows += [(5000, "a" * 5000), (5001, "! " * 3000), (5002, "<|endoftext|>" * 3 + "'s  ")]
    docs(spark, rows, tmp_path)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.op9_token_counts(spark, str(tmp_path)).collect())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = [len(e.ids) for e in tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert got == Counter((d, len((t or "").encode()), n, n > 512) for (d, t), n in zip(rows, counts, strict=True))
    docs(spark, [], tmp_path)
    assert token_count.op9_token_counts(spark, str(tmp_path)).collect() == []


@pytest.fixture(scope="module")
def merger():
    return token_count._compiled(public_tokenizers.path("byte_bpe_50k.json"))[0]


def test_followers_are_those_of_the_encoding(merger):
    rng = random.Random(2)
    ids = list(merger.text)
    seen = Counter()
    for _ in range(4000):
        text = merger.text[rng.choice(ids)] + merger.text[rng.choice(ids)]
        cut = rng.randint(1, len(text) - 1)
        a, b = merger.ids.get(text[:cut], rng.choice(ids)), merger.ids.get(text[cut:], rng.choice(ids))
        want = merger.encode(merger.text[a] + merger.text[b]) == [a, b]
        seen[want] += 1
        assert merger.follows(a, b) is want
    assert min(seen.values()) > 100


@pytest.mark.parametrize("lane", [65, 100, 128, 5000])
def test_merger_maps_compose_as_one_run(merger, lane):
    rng = random.Random(lane)
    words = [bytes(rng.choice(b"abcdeinrst ") for _ in range(rng.randint(1, 64))) for _ in range(400)] + ["für日本".encode()] * 3
    begin = np.concatenate([np.arange(len(w)) == 0 for w in words])
    each = merger.emitted(np.frombuffer(b"".join(words), np.uint8), begin, lane)
    got = np.add.reduceat(each, np.flatnonzero(begin)).tolist()
    assert got == [len(merger.encode(w)) for w in words] == [merger.alone(w) for w in words]


def test_full_tables_begin_anew(spark, monkeypatch):
    rng = random.Random(6)
    texts = [prose(rng, 200) for _ in range(8)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [token_count.count_texts([t], path)[0] for t in texts]
    monkeypatch.setattr(token_count, "STATES", 50)
    assert [token_count.count_texts([t], path)[0] for t in texts] == want == token_count.count_texts(texts, path)


def test_state_maps_compose_as_one_run():
    rng = np.random.default_rng(3)
    stream = rng.integers(0, 9, 5000).astype(np.uint8)
    to, marks = token_count._splitter()
    state, want = 0, []
    for s in stream:
        want.append(marks[state, s])
        state = to[state, s]
    for chunk in (1, 7, 96, 6000):
        assert token_count.begins(stream, chunk).tolist() == want


# ---- op4 -----------------------------------------------------------------------------------


def lm_brute(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + ["\n"] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    unit = log10(n + 0.1 * (v + 1))
    return [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(log10(c[w] + 0.1) - unit for w in ws), 6)) for (d, _), ws, h in zip(rows, tokens, held, strict=True)]


def test_lm_base_scores_are_exact(spark, tmp_path):
    rows = sample(random.Random(2), 200)
    rows[3] = (3, "Mixed\x0bCASE İx ÄÖ " + (rows[3][1] or ""))
    docs(spark, rows, tmp_path)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for hot in (1 << 20, 50):  # 50: most words go by shuffle
        got = language_model.score(df, *language_model.fit(df.filter(~language_model.held_out()), hot=hot)).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == Counter(lm_brute(rows))
        assert all(r.score < 0 for r in got)


def test_lm_beats_its_base_on_held_out_text(spark, tmp_path):
    rng = random.Random(9)
    follow = {w: rng.sample(WORDS, 4) for w in WORDS}
    rows = []
    for i in range(400):
        w, out = rng.choice(WORDS), []
        for _ in range(80):
            w = rng.choice(follow[w])
            out.append(w)
        rows.append((i, " ".join(out)))
    docs(spark, rows, tmp_path)
    got = [r for r in language_model.op4_lm_scores(spark, str(tmp_path)).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_lm_without_rows(spark, tmp_path):
    docs(spark, [], tmp_path)
    assert language_model.op4_lm_scores(spark, str(tmp_path)).collect() == []


def test_lm_scores_equal_an_exact_count_model(spark, tmp_path):
    """The score by plain dictionaries with the quantised counts is the operator's; with exact counts it is near."""
    rng = random.Random(12)
    words = [w for w in WORDS[:12] for _ in range(WORDS.index(w) + 1)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs(spark, rows, tmp_path)
    got = {r.doc_id: (r.score, r.n_tokens) for r in language_model.op4_lm_scores(spark, str(tmp_path)).collect()}
    train = [t.split() + ["\n"] for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    counts = [Counter(), Counter(), Counter()]
    for t in train:
        full = ["\n", "\n", *t]
        for k, w in enumerate(t):
            counts[0][w] += 1
            counts[1][tuple(full[k + 1 : k + 3])] += 1
            counts[2][tuple(full[k : k + 3])] += 1
    total, distinct = sum(counts[0].values()), len(counts[0])

    def chance(full, k, value):
        p = (counts[0][full[k]] + 0.1) / (total + 0.1 * (distinct + 1))
        before = counts[0][full[k - 1]]
        for n in (1, 2):
            c = value(counts[n][tuple(full[k - n : k + 1])])
            p = (c + 40.0 * p) / (max(before, c) + 40.0)
            before = value(counts[1][tuple(full[k - 2 : k])]) if k > 2 else counts[0]["\n"]
        return p

    quantised = lambda c: language_model.LEVELS[language_model.quantise(np.array([c]))[0]] if c else 0.0
    for value, most in ((quantised, 0.01), (float, 0.03)):
        apart = []
        for i, t in rows:
            full = ["\n", "\n", *t.split(), "\n"]
            want = sum(log10(chance(full, k, value)) for k in range(2, len(full)))
            apart.append(abs(got[i][0] - want) / got[i][1])
        assert np.mean(apart) < most
    # Over all words, and one unknown, a context's probabilities add up to one, but for what quantising moves.
    sums = [sum(chance(["", a, b, w], 3, quantised) for w in [*counts[0], "?"]) for a, b in sorted(counts[1]) if b != "\n"]
    assert abs(np.mean(sums) - 1) < 0.05 and max(abs(x - 1) for x in sums) < 0.25


def test_filter_never_underestimates():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    counts = rng.integers(2, 5000, 5000)
    raw = np.frombuffer(language_model.fill(keys, counts, 2, 120_000), np.uint8).reshape(1, -1)
    level = language_model.Filter(raw, 2).level(keys)
    assert (level >= language_model.quantise(counts)).all()
    absent = language_model.Filter(raw, 2).level(rng.integers(0, 2**63, 5000).astype(np.uint64))
    assert (absent > 0).mean() < 0.3


def test_lm_segments_grow_with_the_counts(spark):
    rng = random.Random(4)
    sizes = []
    for n in (100, 800):
        texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(100)) for _ in range(n)]
        df = docs(spark, [(i, t) for i, t in enumerate(texts * 2)])
        model, counts = language_model.fit(df)
        rows = counts.select("bucket", "segment").collect()
        sizes.append(sum(len(r.segment) for r in rows))
        codes, offsets, of = language_model._sequences(pa.array(texts * 2))
        keys, many = np.unique(language_model.ngrams(of[codes], offsets, 2)[0], return_counts=True)
        parts = {i: (a, b) for i, a, b in language_model.ranges(keys, model.buckets)}
        for r in rows:
            a, b = parts[r.bucket]
            level = language_model.Filter(np.frombuffer(r.segment, np.uint8), model.cutoff).level(keys[a:b])
            assert (level >= language_model.quantise(many[a:b])).all()
    assert sizes[1] > 5 * sizes[0]


def test_lm_knows_what_was_seen_once(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(300)]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    free = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 10 == 0]
    shuffled = train[0].split()
    rng.shuffle(shuffled)
    rows += [(free[0], train[0]), (free[1], " ".join(shuffled))]
    docs(spark, rows, tmp_path)
    got = {r.doc_id: r for r in language_model.op4_lm_scores(spark, str(tmp_path)).collect()}
    assert got[free[0]].held_out and got[free[1]].held_out
    assert got[free[0]].score > 0.6 * got[free[1]].score
    df = spark.read.parquet(f"{tmp_path}/documents.parquet").filter(~language_model.held_out())
    model, counts = language_model.fit(df)
    codes, offsets, of = language_model._sequences(pa.array(train))
    parts = {r.bucket: language_model.Filter(np.frombuffer(r.segment, np.uint8), model.cutoff) for r in counts.collect()}
    for grams in language_model.ngrams(of[codes], offsets, 3):
        keys = np.unique(grams)
        assert all((parts[i].level(keys[a:b]) > 0).all() for i, a, b in language_model.ranges(keys, model.buckets))
    model, counts = language_model.fit(df, order=2)
    two = {r.doc_id: r.score for r in language_model.score(spark.read.parquet(f"{tmp_path}/documents.parquet"), model, counts).collect()}
    assert got[free[0]].score > two[free[0]]


# ---- op5, op7 ------------------------------------------------------------------------------


def test_exact_dedup(spark, tmp_path):
    rows = sample(random.Random(5))
    docs(spark, rows, tmp_path)
    got = exact_dedup.op5_exact_dedup(spark, str(tmp_path)).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(d)
    assert len(got) == len(rows)
    for r in got:
        own = groups[r.text_sha256]
        best = max((d for d in own if d is not None), default=None)
        assert r.group_size == len(own) and r.keep_id == best and (not r.kept or r.doc_id == best)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(groups.keys())
    kept = exact_dedup.keep_first(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and kept.count() == len(groups)


def test_digest_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = exact_dedup.dedupe(docs(spark, [(1, "a"), (2, "a"), (3, "b")]), index).collect()
    assert {r.doc_id for r in first if r.kept} == {2, 3}
    again = exact_dedup.DigestIndex(spark, index.path, buckets=4)
    second = exact_dedup.dedupe(docs(spark, [(9, "a"), (10, "c"), (11, "c")]), again).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in second} == {(9, 2, 3, False), (10, 11, 2, False), (11, 11, 2, True)}
    again.append(again.read().select("digest", "keep_id", "copies"), 1)  # run again
    assert again.read().count() == 3 and again.compact().read().count() == 3
    third = exact_dedup.dedupe(docs(spark, [(12, "a"), (13, "d")]), again).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in third} == {(12, 2, 4, False), (13, 13, 1, True)}
    whole = again.compact()
    fourth = exact_dedup.dedupe(docs(spark, [(14, "a"), (15, "c"), (16, "d"), (17, None)]), whole).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in fourth} == {(14, 2, 5, False), (15, 11, 3, False), (16, 13, 2, False), (17, 17, 1, True)}


def test_batches_go_through_the_index(spark, monkeypatch):
    rows = [(i, f"text {i % 7}") for i in range(50)] + [(None, "text 3"), (None, "other"), (None, "other")]
    calls = []
    missing = exact_dedup.DigestIndex.missing
    monkeypatch.setattr(exact_dedup.DigestIndex, "missing", lambda self, groups: calls.append((groups.count(), missing(self, groups).count())) or missing(self, groups))
    one, many = (sorted(map(str, exact_dedup.dedupe(docs(spark, rows), batches=n).collect())) for n in (1, 4))
    assert one == many and sum(n for _, n in calls[1:]) == 8 and sum(n for n, _ in calls[1:]) > 8  # the anti-join drops what earlier batches brought


def test_keep_first_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 2), (2, "a", "y", 2), (3, None, None, None)], "doc_id bigint, text string, KEY string, sha long")
    got = exact_dedup.keep_first(rows)
    assert got.columns == rows.columns and sorted(r.doc_id for r in got.collect()) == [2, 3]


def near_brute(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for _, t in rows]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in words]
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                label[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min((x for x in (least.get(top(i)), d) if x is not None), default=None)
    return Counter((d, len(s), least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_rows(rng):
    rows = sample(rng, 40)
    for k in range(12):  # clusters of edited copies, some only linked through others
        base = prose(rng, 80).split()
        for c in range(rng.randint(2, 14)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(WORDS) + str(rng.randint(0, 9))
            rows.append((1000 + 100 * k + c, " ".join(own)))
    passage = prose(rng, 90)
    rows += [(5000 + i, prose(rng, rng.randint(5, 25)) + " " + passage) for i in range(40)]
    return rows


@pytest.mark.parametrize("short,split", [(32, 2048), (3, 2048), (3, 4)])
def test_near_classes_match_brute_force(spark, monkeypatch, short, split):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "SPLIT", split)
    rows = near_rows(random.Random(short + split))
    got = jaccard.jaccard_classes(docs(spark, rows), bucket_postings=2000)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == near_brute(rows)


def test_groups_of_one_prefix_are_expanded(spark):
    rng = random.Random(4)
    between = prose(rng, 6)
    tails = [f"{between} {prose(rng, 18)}" for _ in range(4)]  # frequent, so not in a prefix of those that begin with a rare part
    heads = [prose(rng, 18) for _ in range(5)]
    rows = [(i, f"{prose(rng, 2)} {tails[i % 4]}") for i in range(160)]
    rows += [(200 + 10 * h + k, f"{heads[h]} {tails[k % 4]}") for h in range(5) for k in range(6)]
    rows += [(300 + 10 * h + k, f"{heads[h]} {' '.join(tails[k].split()[:20])} {prose(rng, 4)}") for h in range(5) for k in range(4)]
    rng.shuffle(rows)
    classes = jaccard.jaccard_classes(docs(spark, rows), bucket_postings=2000)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in classes.collect()) == near_brute(rows)
    levels = spark.sparkContext.broadcast(jaccard._counted(docs(spark, rows), 5))
    groups = jaccard._profile(docs(spark, rows), 5, (3, 4), levels).groupBy("grp").agg(F.count_distinct("name").alias("sets"))
    assert groups.filter("sets > 2").count() >= 5


def test_lists_without_reaching_sets_give_no_pairs(spark):
    # Template and own words, just below the threshold: every list of the template is long, and no two sets can link.
    shared = [f"t{i}" for i in range(32)]
    rows = [(i, " ".join(shared + [f"u{i}x{j}" for j in range(8)])) for i in range(3000)]
    levels = spark.sparkContext.broadcast(jaccard._counted(docs(spark, rows), 5))
    groups = jaccard._profile(docs(spark, rows), 5, (3, 4), levels).filter("prefix is not null").withColumn("gid", F.monotonically_increasing_id())
    posted = jaccard._postings(groups, levels, 8)
    assert posted.groupBy("bucket").applyInArrow(jaccard._lists((3, 4)), jaccard.FOUND).filter("gid <> other or salt = 0").count() == 0


def test_near_keep_one(spark):
    rng = random.Random(8)
    a = prose(rng, 60)
    rows = [(3, a), (2, a + " end"), (2, a + " end"), (7, prose(rng, 30)), (None, prose(rng, 30)), (None, prose(rng, 31)), (8, ""), (9, None)]
    kept = jaccard.keep_one(docs(spark, rows)).collect()
    assert Counter(r.doc_id for r in kept) == Counter([2, 7, None, None, 8, 9])
    assert jaccard.keep_one(docs(spark, [])).collect() == []


# ---- op1, op10 -----------------------------------------------------------------------------


def test_contaminated_documents_are_found(spark):
    rng = random.Random(6)
    rare = [f"{w}{v}q" for w in WORDS for v in "aeiou"]
    items = [(i, " ".join(rng.choice(WORDS if rng.random() < 0.5 else rare) for _ in range(rng.randint(16, 70)))) for i in range(25)]
    clean = [(i, prose(rng, rng.randint(0, 200))) for i in range(120)]
    hit = []
    for n in range(50):
        w = items[n % 25][1].split()
        if n % 2:
            w = [x.upper() + "," if rng.random() < 0.3 else x for x in w if rng.random() > 0.15]
        hit.append((500 + n, prose(rng, 40) + " " + " ".join(w) + " " + prose(rng, 40)))
    rows = clean + hit + [(900, None), (901, ""), (500, hit[0][1]), (None, hit[1][1])]
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(500 + n, n % 25) for n in range(50)}
    grouped = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), bench, terms=120).collect()}
    assert grouped == got
    mixed = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), bench, rank=12).collect()}
    assert mixed == got
    named = docs(spark, rows).withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id")))
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(named, bench.withColumn("codes", F.lit("x"))).collect()} == {(f"n{d}", i) for d, i in got}
    assert decontaminate.contaminated(docs(spark, []), bench).collect() == []
    assert decontaminate.contaminated(docs(spark, rows), spark.createDataFrame([], "item_id bigint, text string")).collect() == []


def test_very_long_texts_and_repeated_items(spark):
    rng = random.Random(16)
    item = " ".join(f"{rng.choice(WORDS)}{rng.choice('aeiou')}q" for _ in range(30))
    long_text = f"{prose(rng, 60_000)} {item} {prose(rng, 60_000)} {item}"
    bench = spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id bigint, text string")
    got = decontaminate.contaminated(docs(spark, [(5, long_text), (6, prose(rng, 500))]), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(5, 1), (5, 2)]
    assert all(r.lcs_share == 1.0 and min(abs(r.start - 60_000), abs(r.start - 120_030)) < 100 for r in got)


def test_axes_and_candidates_equal_a_dense_svd(spark):
    rng = random.Random(3)
    terms = [f"{w}{v}z" for w in WORDS[:20] for v in "ae"]
    items = [(i, " ".join(rng.sample(terms, 10))) for i in range(18)]
    rows = [(i, " ".join(rng.choice(terms + WORDS) for _ in range(rng.randint(20, 200)))) for i in range(150)]
    own = decontaminate.Items(items)
    size = len(own.vocabulary)
    coded = decontaminate._code_rows(docs(spark, rows).select("doc_id", "text"), own.vocabulary, "bigint")
    df, passages = decontaminate._frequencies(coded, size, np.int16)
    [segments] = own.groups(1000)
    group = decontaminate.Group(segments, size, df, passages)
    group.weight = np.maximum(group.weight, 0.1)
    start = group.start(512)
    axes = decontaminate.latent_axes(start, decontaminate._range(coded, group, start, np.int16))
    words = own.vocabulary.to_pylist()
    lists = [t.split()[a : a + 48] for _, t in rows for a in range(0, len(t.split()), 48)]
    counts = np.array([[ws.count(w) for w in words] for ws in lists], float)
    assert passages == len(lists) and (df == (counts > 0).sum(axis=0)).all()
    matrix = counts * group.weight
    _, singular, right = np.linalg.svd(matrix, full_matrices=False)
    assert start.shape[1] == size  # few terms: the range is whole, so the axes are those of the dense decomposition
    lead = singular > 1e-3 * singular[0]
    assert np.allclose(np.abs(np.sum(axes[:, :5] * right[:5].T, axis=0)), 1, atol=1e-2) and axes.shape[1] >= lead.sum() - 1
    windows = matrix[:40] @ axes
    dense = (matrix[:40] @ right[lead].T) @ (right[lead] @ np.stack([np.bincount(c, minlength=size) * group.weight for _, c in group.segments]).T)
    norms = np.linalg.norm(matrix[:40] @ right[lead].T, axis=1)[:, None] * np.linalg.norm(right[lead] @ np.stack([np.bincount(c, minlength=size) * group.weight for _, c in group.segments]).T, axis=0)
    unit = (windows / np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    got = {(i, k) for i, k, _ in decontaminate._near(unit, group.project(axes), 0.4)}
    cosines = dense / np.maximum(norms, 1e-9)
    assert {(i, k) for i, k in zip(*np.nonzero(cosines > 0.41), strict=True)} <= got <= {(i, k) for i, k in zip(*np.nonzero(cosines > 0.39), strict=True)}


def test_sums_of_rows():
    rng = np.random.default_rng(5)
    table, index, weight = rng.random((9, 3)), rng.integers(0, 9, 40), rng.random(40)
    starts = np.array([0, 1, 4, 20, 21])
    want = np.add.reduceat(table[index] * weight[:, None], starts, axis=0)
    assert np.allclose(decontaminate.sum_rows(table, index, starts, weight), want)
    assert decontaminate.sum_rows(table, index[:0], starts[:0]).shape == (0, 3)


def test_lcs_with_bits():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [[rng.randrange(6) for _ in range(rng.randint(1, 30))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontaminate.lcs_length(masks, len(a), b) == table[-1][-1]


def test_quality_on_held_out_rows(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = prose(rng, 60) if good else " ".join(rng.choice(["BUY!!", "$$$", "|", "x%%%"]) for _ in range(60))
        rows.append((i, text))
        labels.append((i, int(good)))
    df = docs(spark, rows + [(700, None), (701, ""), (None, "x y z")])
    model = quality.fit(df, spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id bigint, quality int"), sample=300)
    assert len(model.labels) <= 300
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    truth = dict(labels)
    out = [r.predicted == truth[d] for d, r in got.items() if d in truth and zlib.crc32(str(d).encode()) % 3 == 1]
    assert len(out) > 100 and np.mean(out) > 0.97
    assert got[700].score == got[701].score and 0 <= got[700].score <= 1
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items() if d is not None)
    assert quality.keep_good(df, model).columns == df.columns
    none = quality.fit(df, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}


def test_all_tied_neighbours_vote(spark):
    rng = random.Random(31)
    good, bad = prose(rng, 40), "$$$ %%% | " * 20
    rows = [(i, good) for i in range(40)] + [(100 + i, good) for i in range(20)] + [(200 + i, bad) for i in range(10)] + [(300, good), (301, good + " x" * 200_000), (302, None), (302, None)]
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(20)] + [(200 + i, 0) for i in range(10)]
    df = docs(spark, rows)
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    seen = [y for d, y in labels if zlib.crc32(str(d).encode()) % 3 != 1 and d < 200]
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert abs(got[300] - np.mean(seen)) < 1e-6 and len({round(got[d], 12) for d, _ in rows if d is not None and d < 200}) == 1
    # Over plain products: the neighbours at least as near as the 24th, weighted by their similarity.
    terms = quality.terms_of(pa.array([good, bad, good + " zz " + bad]))
    scores = model.score(terms, 24)
    for i, row in enumerate(terms):
        unit = (row * model.idf) @ model.axes
        near = np.round(model.vectors @ (unit / np.linalg.norm(unit)), 5)
        vote = near >= np.sort(near)[-24]
        weight = np.maximum(near[vote], 0).astype(float) ** 4 + 1e-9
        assert abs(scores[i] - (weight * model.labels[vote]).sum() / weight.sum()) < 1e-3
    assert quality.score(docs(spark, []), model).collect() == []


# ---- op6, op8 ------------------------------------------------------------------------------


def page_rows():
    rng = random.Random(11)
    same = "<p>" + prose(rng, 40)
    rows = [(i, f"http://x/{i}?a=b c\r\nd", "<p>" + prose(rng, rng.randint(0, 400))) for i in range(60)]
    return rows + [(100, "u", same), (70, "u", same), (101, None, same), (102, "u", None), (103, "u", ""), (104, "u", "short"), (105, "u", "short"), (None, "u", prose(rng, 50)), (106, "u", "ü" * 200_000)]


def test_warc_round_trip(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, path string")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter(warc.op6_warc(spark, str(tmp_path)).collect())
    first = {}
    for i, _, h in rows:
        first[h or ""] = min((x for x in (first.get(h or ""), i) if x is not None), default=None)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 100 and first[h or ""] != i
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[h or ""] if revisit else None)] += 1
    assert Counter({tuple(r): n for r, n in got.items()}) == want


@pytest.mark.parametrize("split", [1, 7, 1000, 1 << 22])
def test_warc_splits_own_each_record_once(tmp_path, split):
    members = [warc.record(i, f"http://x/{i}", bytes([65 + i % 20]) * (i * 37), hashlib.sha256(bytes([65 + i % 20]) * (i * 37)).hexdigest(), None, False, "2024-01-01T00:00:00Z") for i in range(30)]
    noise = b"\x1f\x8b\x08" + b"junk" * 5 + gzip.compress(b"not a record")
    raw = members[0] + noise + b"".join(members[1:]) + b"\x1f\x8b"
    path = str(tmp_path / "a.warc.gz")
    (tmp_path / "a.warc.gz").write_bytes(raw)
    store = pafs.LocalFileSystem()
    got = [r[1] for a in range(0, len(raw), split) for r in warc.scan(path, a, min(a + split, len(raw)), len(raw), store)]
    assert got == [warc.urn(i) for i in range(30)]


def test_warc_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<b>eins</b>"), (2, None, None)], "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/w"
    got = warc.read_archives(warc.write_archives(pages, folder), folder, payloads=True).collect()
    assert {(r.record_id, bytes(r.payload)) for r in got} == {("<urn:page:1>", b"<b>eins</b>"), ("<urn:page:2>", b"")}
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_archives(warc.write_archives(empty, folder), folder).collect() == []


ARTICLE = "<article><h1>Title &amp; more</h1><p>First, with <b>bold</b> and <a href='x'>a link</a>.</p><p>Second   paragraph,\n with a break<br>inside.</article>"
BARS = (
    "<nav><ul><li><a href='/'>Home</a></li></ul></nav>", "<div class='cookie-notice'>We use cookies, and more.</div>", "<aside>Side, bar, text, that, is, long</aside>", "<div id='sidebar'><p>Other, stories, here</p></div>",
    "<script>var a = '<p>no, no, no</p>';</script>", "<form><label>Name, please</label><input></form>", "<!-- <p>hidden, comment</p> -->", "<div class='ad'>Buy, now, cheap</div>", "<footer>&copy; someone, 2024</footer>",
    "<section class='comments'><article class='comment'><p>Great, thanks, all, of, you!</p></article></section>", "<div role='navigation'>Menu, entries</div>", "<style>p{margin:0,1}</style>",
)
WANT = "Title & more\nFirst, with bold and a link.\nSecond paragraph, with a break inside."


@pytest.mark.parametrize("seed", range(6))
def test_main_text(seed):
    rng = random.Random(seed)
    bars = rng.sample(BARS, len(BARS))
    k = rng.randint(0, len(bars))
    page = f"<!DOCTYPE html><html><head><title>No</title></head><body>{''.join(bars[:k])}{ARTICLE}{''.join(bars[k:])}"
    assert html_text.main_text(page + rng.choice(["</body></html>", "", "<div", "</body"])) == WANT


def test_main_text_without_article_and_odd_pages():
    page = "<body><div id='menu'>a, b</div><div><h2>Head</h2><p>Long, good, text of the page.</p><p>More, of, it.</p></div><div class='footer'>x, y</div>"
    assert html_text.main_text(page) == "Head\nLong, good, text of the page.\nMore, of, it."
    assert html_text.main_text("") == "" and html_text.main_text("<div></div>") == ""
    assert html_text.main_text("a &lt; b & c") == "a < b & c"
    assert html_text.main_text("<div>" * 30_000 + "deep") == "deep"
    assert html_text.main_text("<p>one<p>two</p></p>three") == "one\ntwo\nthree"


def test_article_parts_with_doubtful_names_stay():
    words = "Words, and more of them. " * 10
    page = (
        '<body><div class="header"><h1>Site</h1></div><article><div class="post-header"><h1>The title</h1></div><p>{0}</p><div class="related-work"><h2>Related work</h2><p>{0}</p></div>'
        '<div class="related"><ul><li><a href="x">{0}</a></li></ul></div><div class="comments"><p>{0}</p></div><div class="share">Share this</div></article><div class="footer"><p>{0}</p></div></body>'
    ).format(words)
    text = words.strip()
    assert html_text.main_text(page) == f"The title\n{text}\nRelated work\n{text}"


def test_deep_and_wide_pages_are_linear():
    text = "hello, this is the one text of a page"
    begin = time.time()
    assert html_text.main_text("<div>" * 200_000 + f"<p>{text}") == text
    assert html_text.main_text("<ul>" * 50_000 + "<li>x<p>" * 50_000).count("x") == 50_000
    assert len(html_text.main_text("".join(f"<div><p>hello, there {i}</p>" for i in range(50_000)))) > 0
    assert time.time() - begin < 60


def test_extract_nothing(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def _foreign(kind, block, *headers, content="application/http; msgtype=response"):
    lines = ["WARC/1.0", f"warc-type: {kind}", "WARC-Record-ID: <urn:x>", f"content-type: {content}", f"CONTENT-LENGTH: {len(block)}", *headers]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_warc_of_other_writers(tmp_path):
    body = b"<p>payload</p>"
    sha1 = hashlib.sha1(body)
    http = lambda header: b"HTTP/1.1 200 OK\r\n" + header + b"\r\n\r\n" + body
    records = [
        _foreign("warcinfo", b"software: x", content="application/warc-fields"),
        _foreign("response", http(b"content-length: 14"), "WARC-Payload-Digest: sha1:" + base64.b32encode(sha1.digest()).decode()),
        _foreign("response", http(b"Content-Length: many"), "WARC-Payload-Digest: sha1:" + sha1.hexdigest()),
        _foreign("response", http(b"Server: x"), "WARC-Payload-Digest: crc9:17"),
        _foreign("response", http(b"Server: x"), "WARC-Payload-Digest: md5:" + "0" * 32),
        _foreign("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: what\r\n\r\n", "WARC-Payload-Digest: sha1:" + base64.b32encode(sha1.digest()).decode()),
    ]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(records))
    size = path.stat().st_size
    got = list(warc.scan(str(path), 0, size, size, pafs.LocalFileSystem(), payloads=True))
    own = hashlib.sha256(body).hexdigest()
    assert [r[0] for r in got] == ["warcinfo", *["response"] * 4, "revisit"]
    assert [(r[4], r[5]) for r in got] == [(11, hashlib.sha256(b"software: x").hexdigest()), *[(14, own)] * 4, (None, "sha1:" + sha1.hexdigest())]
    assert [r[6] for r in got] == [None, True, True, None, False, None]
    assert got[1][9] == body and got[0][9] == b"software: x"


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t"), (2, None, None, "t"), (None, "u", "", "t")], "page_id bigint, url string, html string, text string")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == Counter({(1, "u", "x", 1): 2, (2, None, "", 0): 1, (None, "u", "", 0): 1})
    assert pa.array([1]).type == pa.int64()


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_partial_sums_in_a_tree(spark, monkeypatch, fan):
    from strataweave.llm import common

    monkeypatch.setattr(common, "FAN_IN", fan)
    size = common.PART_BYTES // 8 + 3  # two segments
    ends = lambda b: np.concatenate([[b.num_rows], np.zeros(size - 2, np.int64), [1]])
    parts = spark.range(0, 40, 1, 9).mapInArrow(lambda bs: (common.parts_of(ends(b)) for b in bs), "segment int, part binary")
    total = common.sum_arrays(parts, "int64", size)
    assert total[0] == 40 and total[-1] == 9 and total.sum() == 49


def test_an_append_writes_one_file_a_bucket(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    exact_dedup.dedupe(docs(spark, [(i, f"text {i}") for i in range(200)]).repartition(7), index)
    files = [f for f in spark.read.parquet(index.path).inputFiles() if f.endswith(".parquet")]
    assert len(files) == 4 and index.read().count() == 200


# ---- what was lost before ----------------------------------------------------------------------


def test_an_index_opened_again_knows_its_buckets(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(200)]
    index = exact_dedup.DigestIndex(spark, f"{tmp_path}/index", buckets=64)
    exact_dedup.dedupe(docs(spark, rows), index).collect()
    spark.sql(f"DROP TABLE {index.table}")  # as in a new process, whose catalog is empty
    again = exact_dedup.DigestIndex(spark, f"{tmp_path}/index")
    assert again.buckets == 64
    assert not exact_dedup.dedupe(docs(spark, rows), again).filter("kept").collect()
    with pytest.raises(ValueError, match="64 buckets"):
        exact_dedup.DigestIndex(spark, f"{tmp_path}/index", buckets=32)


def test_an_index_of_two_folders_opens_as_it_is(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(50)]
    index = exact_dedup.DigestIndex(spark, f"{tmp_path}/new", buckets=8)
    exact_dedup.dedupe(docs(spark, rows), index).collect()
    (tmp_path / "old").mkdir()
    (tmp_path / "new" / "_buckets").rename(tmp_path / "old" / "buckets")
    (tmp_path / "new").rename(tmp_path / "old" / "digests")
    again = exact_dedup.DigestIndex(spark, f"{tmp_path}/old")
    assert again.buckets == 8 and again.read().count() == 50
    assert not exact_dedup.dedupe(docs(spark, rows), again).filter("kept").collect()


def test_the_fit_takes_an_id_once(spark):
    rng = random.Random(3)
    rows = [(7, f"{prose(rng, 30)} {i}") for i in range(300)] + [(i, prose(rng, 30)) for i in range(100, 140)]
    labels = spark.createDataFrame([(i, i % 2) for i in [7, *range(100, 140)]], "doc_id long, quality int")
    known = labels.filter(~quality.held_out()).count()
    model = quality.fit(docs(spark, rows), labels, sample=200)
    assert 0 < len(model.labels) <= known
    same = quality.fit(docs(spark, rows[::-1]).repartition(3), labels, sample=200)
    assert sorted(model.labels) == sorted(same.labels)


PROSE = "<p>This is a paragraph of the article, with commas, and enough prose to be one, as articles have them.</p>"


@pytest.mark.parametrize(
    "part",
    [
        f'<section class="comment-analysis">{PROSE}UNIQUE</section>', '<p class="hidden-gem">UNIQUE short</p>', f'<section id="banner-history">{PROSE}UNIQUE</section>',
        '<section id="menu-planning"><p>UNIQUE short.</p></section>', f'<section id="login"><h2>UNIQUE</h2>{PROSE}</section>', f'<div class="section" id="popup-menus">{PROSE}UNIQUE</div>',
        '<div class="related-work"><p>UNIQUE short one.</p></div>', '<table class="results"><tr><td>UNIQUE</td><td>2</td></tr></table>',
    ],
)
def test_parts_of_an_article_with_names_like_boilerplate_stay(part):
    assert "UNIQUE" in html_text.main_text(f"<body><article><h1>T</h1>{PROSE}{part}{PROSE}</article></body>")


def test_a_table_beside_the_best_container_stays():
    page = f'<body><div class="nav"><a href="x">a</a></div><div><h1>T</h1>{PROSE * 3}</div><table><tr><td>UNIQUE</td></tr></table></body>'
    assert "UNIQUE" in html_text.main_text(page)


@pytest.mark.parametrize(
    "part",
    [
        f'<div id="comments">{PROSE}UNIQUE</div>', f'<div class="comment-body">{PROSE}UNIQUE</div>', f'<div class="ad-slot">{PROSE}UNIQUE</div>', f'<div id="newsletter">{PROSE}UNIQUE</div>',
        f'<section id="comments">{PROSE}UNIQUE</section>', f'<div class="cookie-text">{PROSE}UNIQUE</div>', '<div class="related"><a href="x">UNIQUE one</a> <a href="y">two</a></div>',
    ],
)
def test_boilerplate_inside_an_article_goes(part):
    assert "UNIQUE" not in html_text.main_text(f"<body><article><h1>T</h1>{PROSE}{part}{PROSE}</article></body>")


def _histogram(rng, kind):
    if kind == "uniform":
        return Counter(rng.randint(1, 4095) for _ in range(800))
    if kind == "middle":
        return Counter(rng.randint(900, 2100) for _ in range(500))
    return Counter(min(4095, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(1500))


@pytest.mark.parametrize("seed", range(9))
def test_packing_never_needs_more_bins_than_best_fit_decreasing(seed):
    histogram = _histogram(random.Random(seed), ("uniform", "middle", "lognormal")[seed % 3])
    out = packing.pack_histogram(histogram, 4096)
    assert _lengths(out) == histogram and all(sum(p) <= 4096 for p in out)
    assert out.total() <= packing.best_fit(histogram, 4096, lambda length: -length).total()
