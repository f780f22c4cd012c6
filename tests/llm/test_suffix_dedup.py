import random
from collections import Counter

import numpy as np

from lumaframe.llm import suffix_dedup

from .conftest import ordered, texts


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    held = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if held[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return sorted(out, key=repr)


def mixed(rng, n):
    base = "".join(rng.choice("abcdef ") for _ in range(1500))
    rows = []
    for i in range(n):
        a = rng.randint(0, 1200)
        noise = ["".join(rng.choice("abcdefé ") for _ in range(rng.randint(0, 120))) for _ in range(2)]
        rows.append((i, noise[0] + base[a : a + rng.randint(0, 500)] + noise[1]))
    return rows + [(n, "ab" * 700), (n + 1, "z" * 900), (n + 2, base), (n + 2, base), (n + 3, None), (None, base[:700])]


def test_against_brute_force(spark):
    rows = mixed(random.Random(3), 50)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for length in (40, 100, 400):
        assert ordered(suffix_dedup.without_repeats(df, length).collect()) == brute(rows, length), length


def test_passage_in_many_contexts_crosses_buckets(spark, monkeypatch):
    """One gram over several buckets: what meets only across their boundaries is found."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh") for _ in range(160))
    rows = [(k, "".join(rng.choice("ijklmn") for _ in range(150)) + passage + "".join(rng.choice("opqrst") for _ in range(150))) for k in range(60)]
    rows += [(100 + k, rows[k][1][100 : 330 + k]) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(suffix_dedup.without_repeats(df, 100).collect()) == brute(rows, 100)


def test_segments_of_long_texts(spark, monkeypatch):
    rng = random.Random(11)
    rows = mixed(rng, 20)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 128)
    found = [a for _, t in rows for a in suffix_dedup.anchors((t or "").encode(), 100)]
    assert len(found) > len(rows)
    starts = sum(int((last - first + 1).sum()) for _, first, last, _, _ in found)
    assert starts == sum(max(0, len((t or "").encode()) - 99) for _, t in rows)


def test_odd_rows(odd_docs, no_docs):
    small = odd_docs.where("length(text) < 3000 or text is null")
    assert ordered(suffix_dedup.without_repeats(small, 60).collect()) == brute(texts(small), 60)
    assert suffix_dedup.without_repeats(no_docs, 400, digest=True).collect() == []
    by_id = {r["doc_id"]: r for r in suffix_dedup.without_repeats(odd_docs, 400).collect()}
    assert by_id[403]["kept"] == b"" and by_id[403]["n_removed"] == by_id[404]["n_bytes"] and by_id[405]["kept"] == b""


def test_bucket_against_brute_force():
    """Strings of one bucket, decided by neighbours and by the look-up beyond them."""
    rng = random.Random(6)
    for length in (60, 100):
        base = "".join(rng.choice("abc") for _ in range(700)).encode()
        parts = [base[a : a + rng.randint(0, 300)] + bytes(rng.choice(b"abc\0") for _ in range(40)) for a in (rng.randint(0, 500) for _ in range(60))]
        stretches, before, owned = [], [], []
        for text in parts:
            for at, first, last, _, _ in suffix_dedup.anchors(text, length):
                for a, f, end in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
                    stretches.append(text[f : end + length])
                    before.append(a - f)
                    owned.append(end - f + 1)
        row, number, repeats, _, _ = suffix_dedup.compare_bucket(stretches, np.array(before), np.array(owned), np.zeros(len(stretches), bool), length)
        strings = [stretches[r][k : k + length] for r, k in zip(row.tolist(), number.tolist(), strict=True)]
        held = Counter(strings)
        assert [held[x] > 1 for x in strings] == repeats.tolist() and 0 < repeats.sum() < len(repeats)


def test_planted_passages_of_51_to_90_words(spark):
    """Passages go if they have 400 bytes or more, however many words they have; shorter ones are outside of what is asked for."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 10)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, sizes = [], {}
    for k, n in enumerate(range(51, 91, 3)):
        passage = text(n)
        sizes[k] = len(passage)
        rows += [(10 * k + j, f"{text(20)} {passage} {text(20)}") for j in range(3)]
    got = ordered(suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect())
    assert got == brute(rows, 400)
    gone = {r[0]: r[2] for r in got}
    assert all((gone[10 * k] >= sizes[k]) if size >= 400 else (gone[10 * k] == 0 or size > 390) for k, size in sizes.items())
    assert min(sizes.values()) < 380 and max(sizes.values()) > 450


def test_many_copies_are_kept_out_of_shuffles(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    rows = mixed(random.Random(5), 12)
    rows += [(100 + k, rows[-3][1]) for k in range(9)] + [rows[0]] * 3
    assert ordered(suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect()) == brute(rows, 100)


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    digits = rng.integers(0, 4, (500, 5)).astype(np.uint64)
    order = suffix_dedup.multikey_quicksort(digits)
    assert [*map(tuple, digits[order].tolist())] == sorted(map(tuple, digits.tolist()))
