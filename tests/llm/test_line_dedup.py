import re
from collections import Counter, defaultdict

from lumaframe.llm import line_dedup

from .conftest import ordered, texts


def key(line):
    return re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line).translate({c: c + 32 for c in range(65, 91)})


def brute(rows, least):
    docs = set(rows)
    held = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < least or not key(x)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(odd_docs):
    assert ordered(line_dedup.dedup_lines(odd_docs, 10).collect()) == brute(texts(odd_docs), 10)
    assert ordered(line_dedup.dedup_lines(odd_docs, 2, batches=5, fanout=2).collect()) == brute(texts(odd_docs), 2)


def test_clean_keeps_columns(odd_docs):
    cleaned = line_dedup.clean(odd_docs, 10)
    assert cleaned.columns == odd_docs.columns
    rows = cleaned.collect()
    assert len(rows) == odd_docs.count()
    assert not any("Read MORE" in (r["text"] or "") for r in rows)
    assert all(r["n_chars"] == len(r["text"]) and r["score"] == 1.5 and r["body"] == "b" for r in rows)


def test_empty(no_docs):
    assert line_dedup.dedup_lines(no_docs).collect() == []


def test_runs_stay_few_and_batches_drop_what_came_before(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    seen, want, got = set(), [], []
    for b in range(5):
        rows = [(10 * b + k, f"line {k}\nonly {b}-{k}\nLINE {b}") for k in range(3)]
        out = line_dedup.dedup_batch(spark.createDataFrame(rows, "doc_id long, text string"), runs)
        got += [(r["doc_id"], r["_kept"]) for r in out.collect()]
        want += [(i, "\n".join(x for x in t.split("\n") if key(x) not in seen)) for i, t in rows]
        seen |= {key(x) for _, t in rows for x in t.split("\n")}
    assert sorted(got) == sorted(want)
    assert sum(map(len, runs.levels)) <= 3
    totals = defaultdict(int)
    for r in runs.counts().collect():
        totals[r["n"]] += 1
    assert sum(totals.values()) == len(seen)
