"""op2: base spans against Python's re, edge cases, and discovery of unseen identifiers."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strataweave.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def run(spark, rows, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, key string, spans string").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return pii.op2_pii(spark, path).collect()


def test_base_spans_match_plain_expressions(spark, tmp_path):
    rng = random.Random(3)
    parts = [
        "a@b.cd", "x.y%z@mail-1.example.com.", "@", ".", "%", "_", "+", " ", "-", "é", "👍", "\n", "1.2.3.4", "256.1.1.1", "001.02.3.4", "9" * 16,
        "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567", "+", "(", ")", "0", "5", "12", "a", "b@", "@c", "d.e",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [None, "", "a@b.c_d@e.f", "4111111111111111", "1." * 3000 + "1", "9" * 40000, "a" * 40000, "a@b" + ".c" * 20000, "+1" + "(" * 20000]
    got = run(spark, [(i, t, "k", "s") for i, t in enumerate(texts)], tmp_path)
    assert len(got) == len(texts)
    for row in got:
        want = brute(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[row.doc_id][:80]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [want.count(f"{k}:") for k in BASE]
        assert set(filter(None, want.split(","))) <= set(row.spans.split(","))


def test_contexts_find_unseen_identifiers(spark, tmp_path):
    rows = [(i, f"Some words. Please call +1 (555) 010-{1000 + i} today or not.", "", "") for i in range(8)]
    rows += [(50, "Some words. Please call 555-0199x today or not.", "", ""), (51, "They call 2024-plan the best of all.", "", "")]
    rows += [(60 + i, "of the 4111111111111111 and so on " + "of the road " * 20 + "of the 77-55", "", "") for i in range(6)]
    got = {r.doc_id: r for r in run(spark, rows, tmp_path)}
    text = rows[8][1]
    assert got[50].spans == f"phone:{text.index('555')}:{text.index('555') + 9}"
    assert got[50].n_phone == 0 and got[51].spans == ""
    assert all(len(got[60 + i].spans.split(",")) == 1 for i in range(6))
    assert all(got[i].n_phone == 1 and got[i].spans for i in range(8))


def test_copies_count_once_in_a_pattern(spark, tmp_path):
    rows = [(i, f"Some words. Please call +1 (555) 010-{1000 + i} today or not.", "", "") for i in range(20)]
    rows += [(100 + i, "Please call us.", "", "") for i in range(500)]
    rows += [(50, "Some words. Please call 555-0199x today or not.", "", "")]
    # Five seeds, one of them copied, among thirty words.
    rows += [(2000 + i, f"We visit a{min(i, 4)}@b.cd", "", "") for i in range(300)]
    rows += [(3000 + i, f"We visit {chr(97 + i % 26)}{'xyz'[i // 26]}", "", "") for i in range(30)]
    rows += [(51, "We visit room-17", "", "")]
    got = {r.doc_id: r for r in run(spark, rows, tmp_path)}
    at = rows[520][1].index("555")
    assert got[50].spans == f"phone:{at}:{at + 9}"
    assert got[51].spans == ""


def plain_bootstrap(edges, support=4, rounds=3, confidence=0.75, trust=0.5, purity=0.9):
    """The rounds over lists: edges are (pattern, instance, seed kind or None, shapes)."""
    slots = defaultdict(set)
    for p, i, *_ in edges:
        slots[p].add(i)
    slots = {p: s for p, s in slots.items() if len(s) >= support}
    shapes = {i: s for p, i, _, s in edges}
    seeds = {i: k for p, i, k, _ in edges if k is not None and p in slots}
    nodes = {i: (k, 1.0, True) for i, k in seeds.items()}
    trusts = {}
    for _ in range(rounds):
        trusts = {}
        for p, own in slots.items():
            kinds = defaultdict(lambda: [0, 0.0])
            for i in own & nodes.keys():
                kinds[nodes[i][0]][0] += nodes[i][2]
                kinds[nodes[i][0]][1] += nodes[i][1]
            if kinds:
                k = max(kinds, key=lambda x: (*kinds[x], -x))
                n, total = kinds[k]
                if n >= support and n >= purity * sum(x[0] for x in kinds.values()):
                    trusts[p] = k, min(total / len(own), 1) * (1 - 1 / (1 + n))
        new = {}
        for i in {i for own in slots.values() for i in own} - seeds.keys():
            best = None
            for k in range(5):
                own = [t for p, (q, t) in trusts.items() if q == k and i in slots[p]]
                if own and k in shapes[i]:
                    score = 1 - math.prod(max(1 - t, 1e-9) for t in own)
                    if best is None or score > best[1]:
                        best = k, score, score >= confidence and max(own) >= trust
            if best:
                new[i] = best
        nodes = {i: (k, 1.0, True) for i, k in seeds.items()} | new
    return {i: v[0] for i, v in nodes.items() if v[2] and i not in seeds}, trusts


@pytest.mark.parametrize("seed", range(3))
def test_bootstrap_equals_plain_rounds(spark, seed):
    rng = random.Random(seed)
    kind = {i: rng.choice([None, None, i % 3]) for i in range(60)}
    shapes = {i: sorted({i % 3, *rng.sample(range(5), 2)}) for i in kind}
    home = [[i for i in kind if i % 3 == k] for k in range(3)]
    pairs = {(p, i) for p in range(40) for i in rng.sample(home[p % 3], rng.randint(1, 14)) + rng.sample(range(60), rng.randint(0, 2))}
    edges = [(p, i, kind[i], shapes[i]) for p, i in sorted(pairs)]
    found, trusts = pii.bootstrap(spark.createDataFrame(edges, "pattern long, instance long, kind int, shapes array<int>"))
    want, want_trusts = plain_bootstrap(edges)
    assert {r.instance: r.kind for r in found.collect()} == want
    assert {r.pattern: (r.kind, round(r.trust, 9)) for r in trusts.collect()} == {p: (k, round(t, 9)) for p, (k, t) in want_trusts.items()}
    assert want


def test_found_instances_induce_patterns(spark, tmp_path):
    # The word "ring" never stands before a seed; the numbers found after "please call" bring it in.
    rows = [(i, f"Words. Please call +1 (555) 010-{1000 + i} now or then.", "", "") for i in range(12)]
    rows += [(100 + i, f"Please call 555-01{10 + i}. You may also ring 555-01{10 + i} when late", "", "") for i in range(5)]
    rows += [(200, "You may also ring 555 7788 99", "", "")]
    got = {r.doc_id: r for r in run(spark, rows, tmp_path)}
    text = rows[-1][1]
    assert got[200].spans == f"phone:{text.index('555')}:{len(text)}"


def test_labels_line_starts_and_long_words(spark, tmp_path):
    rows = [(i, f"A{'b' * 500}\nE-mail: user{i}@mail.example\nrest of it {i}", "", "") for i in range(8)]
    rows += [(20, "Something.\nE-mail: postmaster@localhost\nmore", "", ""), (21, "Costs: 12 in 1999 and 5 more", "", "")]
    got = {r.doc_id: r for r in run(spark, rows, tmp_path)}
    at = rows[8][1].index("postmaster")
    assert got[20].spans == f"email:{at}:{at + 20}" and got[21].spans == ""


def test_labelled_secrets_stay_out_of_the_contract_columns(spark, tmp_path):
    key = "f4fddc3c96e5e269ce7e65dcd469a6a9ed407e8e"
    got = run(spark, [(1, f'so token = "{key}" it is', "", "")], tmp_path)[0]
    assert got.spans == "" and got.secrets == f"secret:12:{12 + len(key)}" and got.n_found == 1
    assert got.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_starts_add_up(spark):
    for n in (0, 1, 2, 3, 10, 1000):
        sizes = [(i * 7) % 11 for i in range(n)]
        want = [sum(sizes[:i]) for i in range(n)]
        frame = spark.createDataFrame([(sizes,)], "s array<int>")
        assert frame.select(pii._starts(F.col("s"))).first()[0] == want


def test_repeated_rows_and_empty_table(spark, tmp_path):
    got = run(spark, [(1, "a@b.cd", "", ""), (1, "a@b.cd", "", ""), (1, "none", "", ""), (None, "a@b.cd", "", "")], tmp_path)
    assert sorted((r.doc_id is None, r.n_email) for r in got) == [(False, 0), (False, 1), (False, 1), (True, 1)]
    assert run(spark, [], tmp_path) == []


@pytest.mark.parametrize("value,good", [("4111111111111111", True), ("4111111111111112", False)])
def test_luhn(spark, value, good):
    assert spark.range(1).select(pii._luhn(F.lit(value))).first()[0] is good
