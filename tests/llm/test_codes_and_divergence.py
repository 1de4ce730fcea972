"""op11 to op13 against the libraries and brute force: hard texts, repeated rows, nulls, empty tables, clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from strataweave.llm import alignment, chunk_bpe, divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, key string, row string, n long, part int"
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
HARD = [
    None, "", " ", "  \n ", "a", " a", "a ", "a  b", "it's we'll 'r 're '", "Ünïcödé ÇA VA? " * 50, "é ́x å", "日本語の文章です。" * 900, "x" * 40_000, "\x00 \x01a",
    "<|endoftext|>a<|startoftext|> <|end oftext|>", "<s>a</s><0x41>", "▁a b", "a　b c d", "\r\n\t tab\tbed", "🙂🙃" * 300, "123456 7,8.9" * 200, "İSTANBUL ΣΑΣ", "ab <|endoftext|> cd " * 700,
]
LETTERS = "abcdefghij '.,ÄÖ1\n日本語é"


def texts(rng, n=30):
    shared = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(900))
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 3000))) for _ in range(n)]
    out += [shared[rng.randint(0, 800) :] + out[i] + shared[: rng.randint(0, 5000)] for i in range(8)]
    return out


def docs(spark, rows, path=None):
    rows = [(r[0], r[1], *(r[2:] or ("en", "s")), "k", "r", 1, 2) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    if path is not None:
        df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return df


def table(seed):
    rng = random.Random(seed)
    some = HARD + texts(rng)
    return [*enumerate(some), (3, some[-1]), (3, some[-1]), (None, some[-2]), (None, None)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- op11 ----------------------------------------------------------------------------------


def plain_codes(rows):
    library = Tokenizer.from_file(WORD)
    found = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t in rows]
    return Counter((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) for d, ids in found)


@pytest.mark.parametrize("often", [100, 1])
def test_codes_equal_the_library(spark, tmp_path, monkeypatch, often):
    monkeypatch.setattr(chunk_bpe, "OFTEN", often)  # with 1 every name is broadcast as a frequent one
    rows = table(11)
    docs(spark, rows, tmp_path)
    got = chunk_bpe.op11_bpe_codes(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == plain_codes(rows)


def test_codes_with_frequent_texts_and_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunk_bpe, "HELD", 3)
    rng = random.Random(5)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta's"]) + str(rng.randint(0, 99)) for _ in range(1200))
    rows = [(i, passage + f" own{i}") for i in range(150)] + [(i, passage) for i in range(130)] + [(i, None) for i in range(120)] + [(None, "none")] * 110
    docs(spark, rows, tmp_path)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet").repartition(7)
    assert Counter(map(tuple, chunk_bpe.encode_documents(df, WORD).collect())) == plain_codes(rows)


def test_codes_of_nothing(spark, tmp_path):
    docs(spark, [], tmp_path)
    assert chunk_bpe.op11_bpe_codes(spark, str(tmp_path)).collect() == []


def test_chunks_follow_content():
    rng = random.Random(2)
    body = bytes(rng.choice(b"abcdefghij klmnop") for _ in range(60_000))
    a, b = chunk_bpe.cut([body, b"something before " * 9 + body])
    assert b"".join(a) == body and b"".join(b).endswith(body)
    assert len(set(a) & set(b)) >= len(a) - 3  # all but those about the first cut
    sizes = list(map(len, a[:-1]))
    assert min(sizes) >= chunk_bpe.LEAST and max(sizes) <= chunk_bpe.MOST
    wide = ("日本語" * 40_000).encode()
    for part in chunk_bpe.cut([wide, b"", b"z" * 50_000]):
        assert all(len(c) <= chunk_bpe.MOST for c in part) and [c.decode() for c in part] is not None


def test_rolling_hash_is_that_of_its_window():
    data = np.frombuffer(bytes(random.Random(1).choices(range(256), k=500)), np.uint8)
    gear, got = chunk_bpe._gear(), chunk_bpe.rolling(data)
    for i in (31, 100, 499):
        want = sum(int(gear[data[i - k]]) << k for k in range(32)) & 0xFFFFFFFF
        assert got[i] == want


@pytest.mark.parametrize("bits", [1, 4])
def test_joins_are_repaired_wherever_the_cuts_are(bits):
    library = Tokenizer.from_file(WORD)
    some = [t for t in HARD + texts(random.Random(bits), 10) if t]
    parts = chunk_bpe.cut([t.encode() for t in some], least=0, bits=bits, most=90)
    got = chunk_bpe.join_chunks([chunk_bpe.encode_chunks(p, WORD) for p in parts], WORD)
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in some]


# ---- op12 ----------------------------------------------------------------------------------


def plain_alignment(rows):
    a, b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    out, every, counts = [], [], Counter()
    for doc, text in rows:
        full = (" " + text).encode() if text else b""
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not text or any(b"".join(r) != full for r in raw):
            out.append((doc, 0, 0, 0, 0, ""))
            every.append([])
            continue
        owner = [np.repeat(np.arange(len(r)), [len(x) for x in r]) for r in raw]
        links = [(ids[0][i], ids[1][j]) for i, j in sorted(set(zip(owner[0].tolist(), owner[1].tolist(), strict=True)))]
        ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
        both = set(ends[0]) & set(ends[1])
        spans = []
        for own, end in zip(ids, ends, strict=True):
            group: list[list[str]] = [[]]
            for i, e in zip(own, end, strict=True):
                group[-1].append(str(i))
                if e in both:
                    group.append([])
            spans.append([",".join(g) for g in group[:-1]])
        out.append((doc, len(ids[0]), len(ids[1]), len(both), len(links), sha(";".join(map("|".join, zip(*spans, strict=True))))))
        every.append(links)
        counts.update(links)
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return Counter((*o[:5], sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), o[5]) for o, links in zip(out, every, strict=True))


@pytest.mark.parametrize("held", [1 << 19, 40, 0])
def test_alignment_equals_brute_force(spark, held):
    rows = table(12)
    got = alignment.align_documents(docs(spark, rows).repartition(3), BYTE, PIECE, held=held).collect()
    assert Counter(map(tuple, got)) == plain_alignment(rows)


def test_alignment_query(spark, tmp_path):
    rows = [(1, "The quick brown fox"), (2, None), (2, "The quick brown fox"), (None, "▁")]
    docs(spark, rows, tmp_path)
    got = alignment.op12_token_alignment(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == plain_alignment(rows)
    docs(spark, [], tmp_path)
    assert alignment.op12_token_alignment(spark, str(tmp_path)).collect() == []


def test_units_encode_as_whole_texts():
    some = [" " + t for t in HARD + texts(random.Random(8)) if t]
    for path, library in ((BYTE, Tokenizer.from_file(BYTE)), (PIECE, SentencePieceProcessor(model_file=PIECE))):
        ids, edges = alignment.encode(some, path)
        if path == BYTE:
            library.encode_special_tokens = True
        for text, a, b in zip(some, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            want = library.encode(text, add_special_tokens=False).ids if path == BYTE else library.encode(text[1:])
            assert ids[a:b].tolist() == want or alignment.WRONG in ids[a:b] and "▁" in text


# ---- op13 ----------------------------------------------------------------------------------


def plain_audit(rows, least=3, top=200, scale=10**9):
    texts_of, kept = defaultdict(Counter), defaultdict(Counter)
    spread, total = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms, word = [], ""
        for c in (text or "") + " ":
            if c.isascii() and not c.isalpha():
                terms += [word] if word else []
                word = ""
            else:
                word += c.lower() if c.isascii() else c
        texts_of[lang, source].update(terms)
        total[lang].update(terms)
        spread[lang].update(set(terms))
    for lang in {k[0] for k in texts_of}:
        kept[lang] = Counter({t: n for t, n in total[lang].items() if spread[lang][t] >= least})
    p = {}
    for (lang, source), own in texts_of.items():
        size = sum(own[t] for t in kept[lang])
        p[lang, source] = {t: 1 + scale * (own[t] + 1) // (size + len(kept[lang])) for t in kept[lang]}
    q = {lang: {t: 1 + scale * (n + 1) // (own.total() + len(own)) for t, n in own.items()} for lang, own in kept.items()}
    f = lambda x, y: (x - y) ** 2 // y
    out = []
    for (lang, source), mine in p.items():
        pairs = [(s, sum(f(mine[t], other[t]) for t in mine)) for (x, s), other in p.items() if x == lang and s != source]
        terms = [(t, f(mine[t], q[lang][t])) for t in mine if texts_of[lang, source][t] and mine[t] > q[lang][t]]
        for part, items, last in (("pair", pairs, None), ("term", terms, top)):
            items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:last]
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(items)]
    return sorted(out)


def audit_rows(seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "γάμμα", "DELTA", "e", "Zürich", "x y"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ä", "z", None])
        body = rng.choice([" ", "-", "1", "\x00", "\n"]).join(rng.choices(words[: rng.randint(5, len(words))], k=rng.randint(0, 60)))
        rows.append((i, rng.choice([body, body, body, None, ""]), lang, source))
    return [*rows, *rows[:20], (None, "Alpha", "fr", "only"), (7, "", "it", "a"), (8, "rare", "it", "b"), (9, "term " * 50_000, "en", "a")]


@pytest.mark.parametrize("shard", [200_000, 5])
def test_audit_equals_brute_force_and_oracle(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(divergence.whole_terms, "__defaults__", (shard,))
    rows = audit_rows(shard)
    docs(spark, rows, tmp_path)
    got = divergence.op13_source_divergence(spark, str(tmp_path))
    assert [tuple(r) for r in sorted(got.collect())] == plain_audit(rows)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(duck.execute(divergence.ORACLE).fetchall()) == plain_audit(rows)


def test_audit_parameters_and_joins(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUPS", 0)  # sizes join by shuffle
    rows = audit_rows(3)
    got = divergence.audit(docs(spark, rows).repartition(5), least=1, top=4, scale=1000)
    assert [tuple(r) for r in sorted(got.collect())] == plain_audit(rows, 1, 4, 1000)


def test_audit_of_nothing(spark, tmp_path):
    docs(spark, [], tmp_path)
    assert divergence.op13_source_divergence(spark, str(tmp_path)).collect() == []


def test_shards_cut_no_term():
    rng = random.Random(4)
    rows = sorted((rng.choice("ab"), rng.choice("uvwxyz"), i) for i in range(400))
    flat = pa.RecordBatch.from_pylist([{"lang": x, "term": y, "i": i} for x, y, i in rows])
    cuts = sorted(rng.sample(range(1, 400), 30))
    batches = [flat.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, 400], strict=True)]
    parts = [t.to_pylist() for t in divergence.whole_terms(iter(batches), 20)]
    assert [r["i"] for p in parts for r in p] == [i for *_, i in rows]
    names = [{(r["lang"], r["term"]) for r in p} for p in parts]
    assert sum(map(len, names)) == len(set().union(*names))


def test_value_of_large_counts(spark):
    """Shares are exact where counts times the scale pass 64 bits."""
    n, size = 10**13 + 7, 3 * 10**13
    row = spark.createDataFrame([(n, size, 5)], "n long, size long, kept long").select(divergence._share(F.col("n"), "size", 10**9)).head()
    assert row[0] == 1 + 10**9 * (n + 1) // (size + 5)
