"""Greedy clustering by joins against the sequential rule."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataweave.functions import text as T
from strataweave.operators import resolve, stars


def names(rng, n):
    words = ["Rad", "Radweg", "Solar", "Dach", "Stadt", "Ausbau", "Park", "Schule", "Energie", "Bus", "Netz", "ÖPNV", "Wald", "e", "A1"]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.45:  # a variant of an earlier one
            x = list(rng.choice(out))
            for _ in range(rng.randint(1, 3)):
                at = rng.randint(0, len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "x", " ", "n"])
            out.append("".join(x))
        elif kind < 0.5:
            out.append("".join(rng.choice("ab") for _ in range(rng.randint(0, 4))))
        else:
            out.append(" ".join(rng.choice(words) + rng.choice(["", "en", "-2030", "s"]) for _ in range(rng.randint(1, 4))))
    return out


def sequential_stars(rows, least):
    groups = {}
    for run, bucket, name, at in sorted(rows, key=lambda r: r[3]):
        groups.setdefault((run, bucket), {}).setdefault(name, at)
    out = set()
    for (run, bucket), known in groups.items():
        found = []
        for name, at in known.items():
            star = next((o for s, o in found if resolve.name_similarity(s, name) >= least), at)
            if star == at:
                found.append((name, at))
            out.add((run, bucket, name, at, star))
    return out


@pytest.mark.parametrize(("least", "size"), [(0.85, 2000), (0.95, 300), (0.6, 200)])
def test_star_groups_equal_the_sequential_rule(spark, least, size):
    rng = random.Random(size)
    rows = [("r", rng.choice("xxxy"), name, i) for i, name in enumerate(names(rng, size))]
    rows += [("s", "x", "  ", 1), ("s", "x", "", 0), ("s", "x", "Abc", 2), ("s", "x", " abc", 3), ("s", "x", "b", 4)]
    got = resolve.star_groups(spark.createDataFrame(rows, "run_id string, bucket string, name string, ord long"), least)
    assert {tuple(r) for r in got.collect()} == sequential_stars(rows, least)


def test_registration_equals_the_sequential_rule(spark):
    rng = random.Random(7)
    rows = [("r", rng.choice("kl"), name, i) for i, name in enumerate(names(rng, 900))]
    df = spark.createDataFrame(rows, "run_id string, kind string, name string, ord long")
    form = {r["name"]: r["form"] for r in df.select("name", T.registry_form(df["name"]).alias("form")).collect()}
    want, known = set(), {}
    seen = set()
    for run, kind, name, at in rows:
        if (kind, name) in seen:
            continue
        seen.add((kind, name))
        best, score = name, 0.0
        for other in known.get(kind, []):
            s = 1.0 if form[name] == form[other] else SequenceMatcher(None, form[name], form[other]).ratio()
            if s >= 0.8 and s > score:
                best, score = other, s
        if not score:
            known.setdefault(kind, []).append(name)
        want.add((run, kind, name, at, best))
    assert {tuple(r) for r in resolve.register(df).collect()} == want


@pytest.mark.parametrize("block", [1024, 8])
def test_similarity_groups_equal_the_sequential_rule(spark, monkeypatch, block):
    monkeypatch.setattr(stars.near_vectors, "__defaults__", (block,))
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(12, 6))
    known = [f"wort{i % 12} nummer {i}" for i in range(150)]
    vectors = {n: (centres[i % 12] + rng.normal(scale=0.5, size=6)).tolist() for i, n in enumerate(known)}
    vectors[known[0]] = [0.0] * 6
    rows = [(r, n, i) for r, part in (("r", known), ("t", known[:40])) for i, n in enumerate(part)]
    got = resolve.similarity_groups(spark.createDataFrame(rows, "run_id string, name string, ord long"), spark.createDataFrame(list(vectors.items()), "name string, v array<double>"))
    want = []
    for run, part in (("r", known), ("t", known[:40])):
        unit = np.array([vectors[n] for n in part])
        unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        star = [-1] * len(part)
        for i, name in enumerate(part):
            if star[i] < 0:
                star[i] = i
                for j in range(i + 1, len(part)):
                    s = float(unit[i] @ unit[j])
                    if star[j] < 0 and s >= resolve.SIMILAR and resolve._may_merge(name, part[j], s):
                        star[j] = i
        for i in set(star):
            members = [n for n, s in zip(part, star, strict=True) if s == i]
            if len(members) > 1:
                want.append((run, part[i], members, max(members, key=len)))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_names_that_longer_ones_contain_go(spark):
    rng = random.Random(4)
    rows = [(rng.choice("rs"), "".join(rng.choice("abC ") for _ in range(rng.randint(0, 7))), i) for i in range(300)] + [("t", "", 0), ("u", "", 1), ("u", "x", 2)]
    own = {}
    for run, name, _ in rows:
        own.setdefault(run, set()).add(name)
    want = sorted((run, n) for run, known in own.items() for n in known if not any(len(x) > len(n) and n.lower() in x.lower() for x in known))
    got = resolve.without_contained(spark.createDataFrame(rows, "run_id string, name string, ord long"))
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_taken_equals_greedy_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(200), 2))) for _ in range((150, 600, 3000)[seed])}
    edges |= {(i, i + 1) for i in range(200, 212)}  # a chain: every other one is a star
    taken = set()
    for j in range(213):
        if any(b == j and a not in taken for a, b in edges):
            taken.add(j)
    got = {r["dst"] for r in stars.taken(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
    assert got == taken
    assert stars.taken(spark.createDataFrame([], "src long, dst long")).collect() == []


words = st.text(alphabet="abcde ", max_size=24)


@settings(max_examples=400, deadline=None)
@given(words, words, st.lists(st.tuples(st.integers(0, 23), st.sampled_from("abcdefx "))), st.sampled_from([0.65, 0.8, 0.85, 0.95]))
def test_no_similar_pair_goes_without_a_common_token(a, b, edits, least):
    b = list(b if len(edits) > 6 else a)
    for at, c in edits[:6]:
        b[at : at + 1] = [c]
    b = "".join(b)
    counts = np.zeros(stars.RARITY, np.int64)
    for x in (a, b, "abab"):
        for c in x:
            counts[stars._slot(c)] += 1
    left, right = (set(stars.tokens(x, least, counts, True)) for x in (a, b))
    if max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= least:
        assert {t for t in left & right if t[0] in "=12"}
    if a and a in b:
        assert {t[1:] for t in left if t[0] == "p"} & {t[1:] for t in right if t[0] == "c"}
