import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from lumaframe.llm import simhash

from .conftest import texts


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))


def brute(pairs):
    """(id, fp) -> component of each."""
    groups = []
    for i, f in pairs:
        near = [g for g in groups if any(bin(f ^ x).count("1") <= 2 for _, x in g)]
        groups = [g for g in groups if g not in near] + [[(i, f)] + [x for g in near for x in g]]
    return {(i, f): min((i for i, _ in g if i is not None), default=None) for g in groups for i, f in g}


def test_against_brute_force(odd_docs):
    got = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_groups(odd_docs).collect()]
    prints = [(i, slow_print(t)) for i, t in texts(odd_docs)]
    assert sorted(map(repr, prints)) == sorted(repr(x[:2]) for x in got)
    want = brute(prints)
    assert all(want[i, f] == c for i, f, c in got)


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)}
    hub = rng.getrandbits(64)
    prints |= {hub ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(16)}  # more than a posting holds
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 2 for r in links if r["a"] != r["b"])
    got = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame([(r["a"], r["b"]) for r in links], "a long, b long")).collect()}
    want = brute([(p, int(np.int64(p).view(np.uint64))) for p in signed])
    assert all(got.get(i, i) == c for (i, _), c in want.items())


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["component"] for r in simhash.components(chain).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}


def test_keep_one(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(3) == 1 and 0 in ids and not set(range(100, 112)) & set(ids)
    assert simhash.keep_one(no_docs).count() == 0 and simhash.near_groups(no_docs).count() == 0


def test_rows_without_ids(spark):
    rows = [(None, "alone here with no id"), (None, "alone here with no id"), (None, "a text that has an id"), (4, "a text that has an id"), (5, "one more text of its own"), (5, "one more text of its own"), (5, "same id but another text"), (5, "a text that has an id")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[3], rows[4], rows[6]], key=repr)


def reached(spark, monkeypatch, rows):
    """near_groups() of (doc_id, fingerprint) rows."""
    prints = spark.createDataFrame([(i, k, f) for k, (i, f) in enumerate(rows)], "doc_id long, body long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: prints)
    return {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_groups(prints).collect()}


def test_a_text_without_an_id_links_others(spark, monkeypatch):
    got = reached(spark, monkeypatch, [(1, 0b0001), (None, 0b0111), (2, 0b11111), (None, 0xFF << 36), (None, 0x7F << 36), (9, 0xFFFF << 20), (9, 0xFF << 50)])
    assert [got[k] for k in ((1, 1), (None, 7), (2, 31))] == [1, 1, 1]
    assert got[None, 0xFF << 36] is None and got[9, 0xFF << 50] == 9


def test_a_hub_without_an_id_links_others(spark, monkeypatch):
    # more than a posting holds, and the smallest fingerprint of all stars has no id
    rows = [(None, 0)] + [(k, 1 << i | 1 << j) for k, (i, j) in enumerate(((i, j) for i in range(16) for j in range(i)), 1)]
    assert set(reached(spark, monkeypatch, rows).values()) == {1}


def test_keep_one_with_shared_and_missing_ids(spark, monkeypatch):
    rows = [(7, "first text"), (7, "second text"), (8, "second text"), (None, "near copy"), (3, "text near that copy"), (None, "alone"), (None, "alone")]
    prints = {"first text": 0, "second text": 0xFFFF << 8, "near copy": 0xFFFF << 40, "text near that copy": 0xFFFD << 40, "alone": -1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bodies = {r["text"]: r["b"] for r in docs.selectExpr("text", "xxhash64(text) AS b").collect()}
    table = spark.createDataFrame([(i, bodies[t], prints[t]) for i, t in rows], "doc_id long, body long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: table)
    assert sorted(map(tuple, simhash.keep_one(docs).collect()), key=repr) == sorted([rows[0], rows[1], rows[4], rows[5]], key=repr)
