"""Quality, toxicity, language and quality rules: brute-force twins, held-out accuracy, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.llm import language, quality, quality_rules, toxicity
from lumaframe.llm.queries import op1_quality, op2_toxicity, op3_language

from .conftest import texts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out(spark, labels):
    found = op1_quality(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    found = op2_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert found[found.toxic == 1].predicted.mean() >= 0.9 and found[found.predicted == 1].toxic.mean() >= 0.95
    assert found.score.between(0, 1).all()


def test_toxicity_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"one of many rows of an id {k % 50}") for k in range(300)] + [(k, f"you idiot {k}") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)] + [(1, 0), (1, None)], "doc_id long, label int")
    seen = []
    found = toxicity.learnt_units
    try:
        toxicity.learnt_units = lambda sample, share: seen.append(sample.collect()) or found(sample, share)
        toxicity.fit(docs, labels)
    finally:
        toxicity.learnt_units = found
    assert len(seen[0]) < 45 and sum(r["doc_id"] > 1 for r in seen[0]) == 38


def slow_split(b, grad, hess, smooth):
    """The feature and cut of the best split over all rows, by trying each."""
    best = (-np.inf, 0, 0)
    for f in range(b.shape[1]):
        for c in range(b.max() + 1):
            left = b[:, f] <= c
            gain = sum(grad[s].sum() ** 2 / (hess[s].sum() + smooth) for s in (left, ~left)) - grad.sum() ** 2 / (hess.sum() + smooth)
            best = max(best, (gain + 1e-12 * (-f * 100 - c), f, c))
    return best[1:]


def test_first_split_against_brute_force():
    rng = np.random.default_rng(6)
    for seed in range(5):
        x = np.round(rng.normal(size=(120, 4)), 1)
        y = (x[:, seed % 4] + 0.3 * rng.normal(size=120) > 0.2).astype(float)
        trees = toxicity.Trees(depth=1, rounds=1).fit(x, y)
        p = y.mean()
        want = slow_split(trees._binned(x), y - p, np.full(len(y), p * (1 - p)), trees.smooth)
        assert (trees.trees[0][0][0], trees.trees[0][1][0]) == want


def test_stems_end_with_a_letter():
    assert toxicity.stem(b"abcdef", 5) == b"abcde" and toxicity.stem(b"abcde", 5) is None
    assert toxicity.stem("abcdéf".encode(), 5) is None and toxicity.stem("abcdéf".encode(), 6) == "abcdé".encode()


def slow_quality(text):
    """The statistics of a text with other words than the operator's."""
    b = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", b)
    n = max(len(words), 1)
    count = lambda pattern: len(re.findall(pattern, b))
    capitals, grams = count(rb"[A-Z]"), [tuple(words[k : k + 4]) for k in range(len(words) - 3)]
    letters = max(capitals + count(rb"[a-z]") + count(rb"[\xc0-\xff]"), 1)
    lines = [x for x in b.split(b"\n") if x]
    root = lambda v: max(v, 0) ** 0.5
    return [
        np.log1p(len(words)), np.log1p(len(text) / n), root(sum(len(w) > 20 for w in words) / n), root(count(rb"[#*$%&@^~<>{}\[\]\\=_+]") / n),
        root(count(rb"\|") / n), root(capitals / letters), root(sum(w.isupper() for w in words) / n), root(count(rb"[0-9]") / max(len(b), 1)), root(count(rb"!") / n),
        root(count(rb"[.?]") / n), root(count(rb"[,;]") / n), np.log1p(len(set(words))) / np.log1p(n), root(1 - len(set(grams)) / len(grams)) if grams else 0.0,
        np.log1p(n / max(len(lines), 1)), root(1 - len(set(lines)) / len(lines)) if lines else 0.0, root(count(rb" ") / max(len(b), 1)),
    ]


def test_quality_statistics_and_sums(spark, odd_docs):
    small = odd_docs.where("length(text) < 3000 or text is null")
    got = sorted(((r["doc_id"], [round(v, 4) for v in r["x"]]) for r in quality.vectors(small).collect()), key=repr)
    want = [(i, slow_quality(t or "")) for i, t in texts(small)]
    assert got == sorted(((i, [round(float(np.float32(v)), 4) for v in x]) for i, x in want), key=repr)
    known = [(x, int(i % 2)) for i, x in want if i is not None]
    model = quality.fit(spark.createDataFrame([([float(v) for v in x], y) for x, y in known], "x array<float>, label long"))
    for k in (0, 1):
        np.testing.assert_allclose(model.mean[k] * model.scale, np.mean([x for x, y in known if y == k], axis=0), rtol=1e-4, atol=1e-5)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = op3_language(spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97


def test_odd_rows_score(spark, odd_docs, no_docs, labels):
    known = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(41, None), (None, 1)], "doc_id long, label int")
    n = odd_docs.count()
    for learn in (F.col("doc_id") >= 0, F.lit(False)):
        found = quality.classify(odd_docs, known, F.coalesce(learn, F.lit(False))).collect()
        assert len(found) == n and all(0 <= r["score"] <= 1 for r in found)
    assert quality.classify(no_docs, known, F.lit(True)).collect() == []
    for some in (known, known.where("false"), known.where("label = 1")):
        model = toxicity.fit(odd_docs, some)
        found = toxicity.scored(odd_docs, model).collect()
        assert len(found) == n and all(0 <= r["score"] <= 1 for r in found)
        assert toxicity.scored(no_docs, model).collect() == []
    kept = toxicity.clean(odd_docs, toxicity.Model(), 0.5)
    assert kept.columns == odd_docs.columns and kept.count() == n


def test_discriminant_is_the_difference_of_normal_densities():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = {k: rng.normal(k, 1 + k, (400, d)) for k in (0, 1)}
    sums = {k: np.concatenate(([len(v)], v.sum(axis=0), (v.T @ v).ravel())) for k, v in x.items()}
    model = quality.Discriminant(sums, 0.1, 0.05)
    some = rng.normal(0.5, 1, (20, d))
    density = {}
    for k in (0, 1):
        cov = model.factor[k] @ model.factor[k].T
        diff = some / model.scale - model.mean[k]
        density[k] = -0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1]
    np.testing.assert_allclose(model.difference(some), np.clip(density[1] - density[0], -60, 60), rtol=1e-6)


def test_isotonic_rises():
    rng = np.random.default_rng(4)
    value = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * value))).astype(float)
    at, share = toxicity.isotonic(value, y)
    assert (np.diff(at) >= 0).all() and (np.diff(share) >= 0).all() and 0 <= share.min() <= share.max() <= 1
    assert abs(np.interp(value, at, share).mean() - y.mean()) < 1e-9


def test_obfuscated_words():
    model = toxicity.Model()
    row = dict(zip(toxicity.FEATURES, model.table([b"you are an 1d10t and a m0r0n! ok 2024 10"])[0], strict=True))
    assert row["obfuscated"] > 0 and row["obfuscated_lexicon"] == 2


def slow_labels(scores, penalty):
    k = len(scores[0])
    best, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(k), key=lambda s: best[s])
        came = [s if best[s] >= best[top] - penalty else top for s in range(k)]
        best = [(best[s] if came[s] == s else best[top] - penalty) + row[s] for s in range(k)]
        back.append(came)
    state = [max(range(k), key=lambda s: best[s])]
    for came in reversed(back):
        state.append(came[state[-1]])
    return state[::-1]


def test_viterbi_against_one_text_at_a_time():
    rng = np.random.default_rng(8)
    model = language.Model(["a", "b", "c"], np.ones((3, language.BUCKETS)), np.ones((3, len(language.SCRIPTS) + 2)), 3.0)
    text = np.repeat([0, 2, 3, 7], [1, 40, 300, 7])
    scores = np.round(rng.normal(size=(len(text), 3)) * 2, 3).astype(np.float32)
    got = model.labels(scores, text)
    for t in set(text.tolist()):
        own = scores[text == t].astype(float)
        want = slow_labels(own.tolist(), 3.0)
        value = lambda path: sum(own[k, s] for k, s in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:]))
        assert abs(value(got[text == t].tolist()) - value(want)) < 1e-4


def test_language_spans_and_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(1)
    en = [(k, " ".join(rng.choice("the and with from this that have".split()) for _ in range(30)), "en") for k in range(30)]
    ru = [(100 + k, " ".join(rng.choice("это как что для они был".split()) for _ in range(30)), "ru") for k in range(30)]
    de = [(200 + k, " ".join(rng.choice("und nicht auch schon durch zwischen über".split()) for _ in range(30)), "de") for k in range(30)]
    model = language.fit(spark.createDataFrame(en + ru + de, "doc_id long, text string, lang string"))
    marks = spark.createDataFrame([(1, "हिन्दी में चार शब्द"), (2, "\u0301 \u0302\u0303 1\u0301"), (3, "cafe\u0301\u0302 e\u0301te\u0301")], "doc_id long, text string")
    assert [r["n_words"] for r in language.spans(marks, model).groupBy("doc_id").agg(F.sum("n_words").alias("n_words")).orderBy("doc_id").collect()] == [4, 2]
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in language.predicted(marks, model).collect()} == {1: False, 2: True, 3: False}
    mixed = spark.createDataFrame([(1, "the and with from this 12 und nicht auch zwischen schon über это как что для"), (2, None), (3, "123 ...")], "doc_id long, text string")
    assert [(r["lang"], r["n_words"]) for r in language.spans(mixed, model).orderBy("doc_id", "span").collect()] == [("en", 5), ("de", 6), ("ru", 4)]
    assert {r["doc_id"]: r["lang_pred"] for r in language.predicted(mixed, model).collect()} == {1: "de", 2: "und", 3: "und"}
    found = {r["doc_id"]: r for r in language.predicted(odd_docs, model).collect()}
    assert found[400]["lang_pred"] == found[401]["lang_pred"] == found[408]["lang_pred"] == "und" and found[0]["lang_pred"] in ("en", "de")
    assert language.predicted(no_docs, model).collect() == []
    nothing = language.fit(no_docs)
    assert {r["lang_pred"] for r in language.predicted(odd_docs, nothing).collect()} == {"und"}


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    again = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


def test_rule_counts(odd_docs, no_docs):
    got = quality_rules.judged(odd_docs).collect()
    want = sorted(((i, *slow_counts(t)) for i, t in texts(odd_docs)), key=repr)
    assert sorted(((r["doc_id"], *[r[c] for c in quality_rules.COLUMNS]) for r in got), key=repr) == want
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"]) and 0 <= r["quality"] <= 1
    assert quality_rules.judged(no_docs).collect() == []


def test_estimated_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    right = [0.95, 0.9, 0.7, 0.8]
    cast = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where((rng.random(len(truth)) < a) == truth, 1, 2)) for a in right], axis=1)
    counts = Counter((cast @ (3 ** np.arange(4))).tolist())
    share, found, post = quality_rules.estimate(counts, 4)
    assert abs(share - 0.7) < 0.05 and np.abs(found.mean(axis=1) - right).max() < 0.06
    verdict = np.array([post[v] for v in (cast @ (3 ** np.arange(4))).tolist()]) > 0.5
    assert (verdict == truth).mean() > 0.85


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        language.fit(spark.createDataFrame([(k, "a text", f"l{k}") for k in range(3)], "doc_id long, text string, lang string"))
