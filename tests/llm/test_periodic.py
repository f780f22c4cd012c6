import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumaframe.llm import periodic
from lumaframe.llm.queries import QUERIES

from .conftest import SCHEMA, odd_rows, ordered


def plain_runs(w, least=12):
    """Every lag word by word; shorter periods looked for on the whole stretch."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(least, 2 * q) and not any(w[s : s + n - d] == w[s + d : s + n] for d in range(1, q)):
                out.append((s, n, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def planted(doc_id, w):
    """The words with what the query plants, by its rule."""
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = planted(doc_id, (text or "").encode().split())
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode(), b" ".join(kept(w, runs)))]
    return (doc_id, len(runs), *head, *digest)


@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=4), st.integers(1, 20), st.integers(2, 5))
@settings(max_examples=200, deadline=None)
def test_runs_equal_all_lags(texts, period, times):
    words = [[b"%d" % x for x in t[:period] * times + t] for t in texts]
    assert periodic.runs_of(words) == [plain_runs(w) for w in words]


def test_long_periods_and_nested_runs():
    rng = random.Random(3)
    some = [b"%d" % rng.randrange(50) for _ in range(700)]
    inner = some[:9] * 3
    for w in (some * 3, (inner + some) * 2 + some[:5], some[:100] * 7 + some, [b"x"] * 900 + some + [b"y", b"z"] * 300, [b"a", b"b", b"a"] * 5 + [b"b"]):
        assert periodic.runs_of([w]) == [plain_runs(w)]
    assert periodic.runs_of([[b"x"] * 200_000]) == [[(0, 200_000, 1)]]


def test_equal_hashes_decide_nothing(monkeypatch):
    monkeypatch.setattr(periodic, "mixed", lambda a, b: (a + b) % np.uint64(7))
    rng = random.Random(4)
    w = [b"%d" % rng.randrange(6) for _ in range(120)] * 2
    assert periodic.runs_of([w]) == [plain_runs(w)]


def test_splitting_leaves_the_same_words_both_ways():
    rng = random.Random(5)
    for _ in range(300):
        w = np.array([rng.randrange(rng.choice([3, 20, 90])) for _ in range(rng.randint(1, 150))])
        at, _ = periodic.survivors(np.zeros(len(w), np.int64), w, 12)
        assert periodic.worklist(w, 12).nonzero()[0].tolist() == at.tolist()


def test_many_rounds(monkeypatch):
    """Each round of splitting frees one more word; the worklist ends what the rounds leave."""
    w = []
    for k in range(60):
        w += [b"%d" % (k + 1)] + [b"%d.%d" % (k, x) for x in range(12)] * 2 + [b"%d" % k]
    monkeypatch.setattr(periodic, "ROUNDS", 2)
    assert periodic.runs_of([w]) == [plain_runs(w)]


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [r for r in odd_rows() if r[1] is None or len(r[1]) < 20_000]
    rows += [(1000 + k, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 150))), "en", "s", 1, 0.0, "", "", "", 0) for k in range(300)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_periodic"](spark, str(tmp_path)).collect()
    assert ordered(got) == ordered(expected(r[0], r[1]) for r in rows)
    assert sum(r["n_runs"] > 0 for r in got) > 20


def test_odd_tables(spark, odd_docs, no_docs):
    clashing = odd_docs.withColumnsRenamed({"score": "runs", "body": "collapsed", "_id": "n_words", "label": "start"})
    found = periodic.periodic_runs(clashing).collect()
    assert len(found) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by_id[400]["runs"] == [] and by_id[400]["collapsed"] == "" and by_id[402]["n_words"] == 0
    assert by_id[403]["n_words"] == 36_000 and by_id[403]["runs"] == by_id[404]["runs"]
    assert periodic.periodic_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(odd_docs, min_length=3)
