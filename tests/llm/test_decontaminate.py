import random

import numpy as np
import pytest

from lumaframe.llm import decontaminate as d

from .conftest import ordered


def slow_tiles(text, item, least):
    """Greedy string tiling by looking at all pairs of places."""
    free_t, free_i, out = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        n, i, t = best
        if n < least:
            return out
        out.append((i, t, n))
        for k in range(n):
            free_i[i + k] = free_t[t + k] = False


def test_tiles():
    rng = random.Random(2)
    for _ in range(60):
        item = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        text = [rng.randint(0, 3) for _ in range(rng.randint(0, 40))]
        got = d.tiles(np.array(text, np.uint64), np.array(item, np.uint64), 3)
        want = slow_tiles(text, item, 3)
        assert sorted(n for _, _, n in got) == sorted(n for _, _, n in want), (item, text)
        assert all(item[i : i + n] == text[t : t + n] for i, t, n in got)


ITEM = "Alpha beta gamma delta epsilon, zeta eta theta iota kappa. Lambda mu nu xi omicron pi rho sigma tau upsilon"


@pytest.fixture(scope="module")
def tables(spark):
    words = ITEM.split()
    rows = [
        (1, "before " + ITEM + " after"),
        (2, "noise here " + " ".join(words[10:]).upper() + " something else between " + " ".join(words[:10])),  # reordered
        (3, "only " + " ".join(words[:6]) + " and other words"),
        (4, "a clean text about something else altogether"),
        (5, None), (6, ""), (7, ITEM), (7, ITEM), (None, ITEM),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None), (13, "")], "item_id long, text string")
    return docs, items


def test_both_ways_agree(tables):
    docs, items = tables
    near = ordered(d.overlaps(docs, items).collect())
    assert near == ordered(d.overlaps(docs, items, max_broadcast_words=0).collect())
    assert {(r[0], r[5]) for r in near} == {(1, 1.0), (2, 1.0), (3, 0.3), (7, 1.0), (None, 1.0)}
    assert sum(r[0] == 7 for r in near) >= 1


def test_clean_drops_only_the_contaminated(tables, odd_docs, no_docs):
    docs, items = tables
    assert ordered(d.clean(docs, items).select("doc_id").collect()) == [(3,), (4,), (5,), (6,)]
    assert d.clean(odd_docs, items).count() == odd_docs.count() and d.clean(odd_docs, items).columns == odd_docs.columns
    assert d.clean(no_docs, items).count() == 0
    assert d.clean(docs, items.where("false")).count() == docs.count()
    assert d.overlaps(docs, items.where("false"), max_broadcast_words=-1).count() == 0


@pytest.mark.parametrize("words", [2_000_000, 0])
def test_clean_tells_rows_of_one_id_apart(spark, words):
    rows = [(None, "before " + ITEM), (None, "clean and without an id"), (None, None), (1, ITEM), (1, "clean but with the id of another text"), (2, "clean as well")]
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    kept = d.clean(spark.createDataFrame(rows, "doc_id long, text string"), items, max_broadcast_words=words)
    assert ordered(kept.collect()) == ordered([rows[1], rows[2], rows[4], rows[5]])


def brute_overlaps(docs, items, least):
    hashes, out = d.WordHashes(), []
    for doc_id, text in docs:
        for item_id, passage in set(items):
            words, item = hashes.of(text).tolist(), hashes.of(passage).tolist()
            if found := slow_tiles(words, item, least) if passage else []:
                out.append((doc_id, item_id, len(item), sum(n for *_, n in found), len(found)))
    return sorted(out, key=repr)


def test_both_ways_against_brute_force(spark):
    """Repeated ids, null, empty and repeated-word texts, and ids of a narrow type."""
    rng = random.Random(8)

    def some(n):
        return " ".join(rng.choice("ab") for _ in range(rng.randint(0, n)))

    items = [(1, "a b c d e f g h"), (1, ""), (1, "a b c d e"), (2, None), (None, "b a b a b a"), (3, "a " * 9), (3, "a " * 9)] + [(k % 3, some(12)) for k in range(6)]
    docs = [(k, some(25)) for k in range(15)] + [(20, None), (21, ""), (22, "a " * 30), (22, "a " * 30), (None, "a b c d e f"), (None, "b a b a b")]
    table, bench = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    ways = [d.overlaps(table, bench, 5, words) for words in (10**6, 0)]
    assert ways[0].schema == ways[1].schema
    want = brute_overlaps(docs, items, 5)
    for way in ways:
        assert sorted((tuple(r)[:5] for r in way.collect()), key=repr) == want


def test_matches_in_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(40):
        text, item = (rng.integers(0, 2, rng.integers(0, 60)).astype(np.uint64) for _ in range(2))
        want = sorted(zip(*(x.tolist() for x in d.matches(text, item, 3)), strict=True))
        monkeypatch.setattr(d, "PAIRS", 7)
        assert sorted(zip(*(x.tolist() for x in d.matches(text, item, 3)), strict=True)) == want
        monkeypatch.undo()


def test_memory_follows_the_texts():
    import tracemalloc

    tracemalloc.start()
    found = d.tiles(np.ones(20_000, np.uint64), np.ones(2_000, np.uint64), 5)
    assert found == [(0, 0, 2_000)] and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
