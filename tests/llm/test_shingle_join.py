import random
from itertools import combinations

import corpus_pipeline
import pytest

from lumaframe.llm import shingle_join, simhash

from .conftest import ordered, texts

WIDE = [f"w{k}" for k in range(3000)]


def slow_set(text):
    words = (text or "").lower().encode().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    """The groups of (id, text) rows."""
    groups = []
    for row in rows:
        own = slow_set(row[1])
        near = [g for g in groups if any(similar(own, s) for s, _ in g)]
        groups = [g for g in groups if g not in near] + [[(own, row)] + [x for g in near for x in g]]
    return {frozenset(map(repr, (r for _, r in g))) for g in groups}


def near_copies(seed=3, bases=12, copies=8):
    """Texts with one to several words changed, added or left out, some at similarity 0.8 or more and some below."""
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [rng.choice(WIDE) for _ in range(rng.randint(6, 150))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = rng.choice(([], [rng.choice(WIDE)]))
            rows.append((len(rows), " ".join(own)))
    return rows


def found(docs):
    bodies = {r["b"]: r["text"] for r in docs.selectExpr("text", "xxhash64(text) AS b").collect()}
    groups = {}
    for r in shingle_join.near_groups(docs).collect():
        groups.setdefault(r["root"], []).append(repr((r["doc_id"], bodies[r["body"]])))
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("longest", [64, 2])
def test_all_near_copies_against_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(shingle_join, "MAX_POSTING", longest)
    monkeypatch.setattr(shingle_join, "OFTEN", 2 if longest == 2 else 8)
    rows = near_copies()
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


@pytest.mark.parametrize("rounds", [0, 2])
def test_large_group_against_brute_force(spark, monkeypatch, rounds):
    """Copies of one text with up to five edits, cut short, or with one of three endings: some near each other only."""
    monkeypatch.setattr(shingle_join, "MAX_POSTING", 6)
    monkeypatch.setattr(shingle_join, "ROUNDS", rounds)
    rng = random.Random(8)
    base, endings = WIDE[:90], [WIDE[200 + 20 * k : 220 + 20 * k] for k in range(3)]
    rows = []
    for k in range(240):
        own = base[: rng.choice((60, 75, 90))] + rng.choice(([], rng.choice(endings)[: rng.randint(8, 20)]))
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = rng.choice(WIDE[300:330])
        rows.append((k, " ".join(own)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_odd_rows_against_brute_force(odd_docs):
    assert found(odd_docs) == brute(texts(odd_docs))


def test_stage_keeps_one_of_each_group(spark, no_docs):
    rows = near_copies(4, 5, 5) + [(None, "no id " + " ".join(WIDE[:40])), (900, "an id " + " ".join(WIDE[:40]))]
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    want = [min((r for r in rows if repr(r) in g), key=lambda r: (r[0] is None, r[0])) for g in brute(rows)]
    assert ordered(kept.collect()) == ordered(want)
    assert corpus_pipeline.one_of_each_group(spark, no_docs, "").count() == 0


def test_stage_takes_candidates_from_the_simhash_index(spark, monkeypatch):
    """All sets within two bits are connected by the pairs that go to the exact check, and the stage asks for them."""
    rows = [*near_copies(seed=5, bases=5), *[(1000 + k, t) for k, t in enumerate(["a b", "A  b", "", None, " "])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r["sig"]: r["fp"] & (2**64 - 1) for r in shingle_join.prefixes(docs, 5, 0.8).collect()}
    assert set(prints.values()) == {simhash.fingerprint((t or "").encode()) for _, t in rows}
    asked = []
    real = shingle_join.hashed_pairs
    monkeypatch.setattr(shingle_join, "hashed_pairs", lambda stored: asked.append(real(stored)) or asked[-1])
    assert corpus_pipeline.one_of_each_group(spark, docs, "").count() == len(brute([(k, t) for k, t in rows]))
    name = {s: s for s in prints}

    def top(s):
        while name[s] != s:
            s = name[s]
        return s

    for r in asked[0].collect():
        assert (prints[r["a"]] ^ prints[r["b"]]).bit_count() <= 2 and r["a"] < r["b"]
        name[top(r["a"])] = top(r["b"])
    near = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert near and all(top(a) == top(b) for a, b in near)
