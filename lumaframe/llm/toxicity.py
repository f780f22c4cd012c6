"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of lexicon words (a fixed list and words learnt from labelled texts), their stems, second-person words near
them, capitals, punctuation and obfuscated spellings. Learning uses about `max_fit_rows` labelled documents, drawn by a hash of
the id (all of them if there are fewer; one of the rows that share an id): their words are counted by Spark to extend the lexicon, their features go to the
driver, where trees of a few leaves are fitted to binned values; a quarter of the sample, which the trees have not seen,
calibrates the scores by pooling adjacent violators. Scoring reads each text once, where it lies.

Defined results: null and empty texts have all features zero and get a score like any other; unlabelled rows are not
learnt from, an id with several labels has the highest; without both labels every score is the share of label 1 (0 without labels); equal rows give equal results; an
empty table gives an empty result; texts may be of any length; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.common import as_bytes, once, saved, slices

# Insults and second-person words that the lexicon starts with.
INSULTS = """
idiot idiots moron morons stupid dumb clown loser losers scum trash garbage pathetic worthless disgusting disgrace
ugly hateful fool fools imbecile jerk vermin filth filthy coward creep freak
idiota estupido estupida imbecil basura asqueroso payaso escoria inutil
idiote stupide cretin ordure minable debile degoutant salaud
dummkopf trottel abschaum widerlich wertlos erbarmlich dumm
"""
SECOND_PERSON = "you your yours yourself ur u tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tus usted ustedes vosotros"
PUNCTUATION = bytes(32 if b < 0x80 and not chr(b).isalnum() else b for b in range(256))
#: Signs that stand for letters inside words; what is no letter, digit or such sign parts words.
SIGNS = bytes.maketrans(b"013457@$!", b"oieastasi")
KEPT_SIGNS = bytes(32 if b < 0x80 and not chr(b).isalnum() and chr(b) not in "@$!" else b for b in range(256))
DIGITS_AND_SIGNS = frozenset(b"013457@$!")
NEAR = 5
#: Bytes at the start of a longer word that are learnt as a stem, for words that vary at their ends; a stem ends with a letter.
STEMS = (5, 6, 7, 8)
FEATURES = [
    "lexicon", "lexicon_count", "lexicon_distinct", "learnt", "learnt_count", "learnt_distinct", "stems", "stem_count", "second_person", "second_person_near",
    "capitals", "capital_words", "exclamations", "questions", "punctuation", "obfuscated", "obfuscated_lexicon", "words",
]


def stem(word: bytes, size: int) -> bytes | None:
    """The first size bytes of a longer word; None where that would cut a letter."""
    return word[:size] if len(word) > size and word[size] & 0xC0 != 0x80 else None


def features(text: bytes, lexicon: frozenset[bytes], learnt: frozenset[bytes], stems: tuple[frozenset[bytes], ...], heads: frozenset[bytes], second: frozenset[bytes]) -> list[float]:
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    small = text.lower()
    words = small.translate(PUNCTUATION).split()
    n = max(len(words), 1)
    hits = [w for w in words if w in lexicon]
    more = [w for w in words if w in learnt]
    least = STEMS[0]
    stemmed = [w for w in words if w[:least] in heads and any(stem(w, k) in own for k, own in zip(STEMS, stems, strict=True))]
    persons = sum(map(second.__contains__, words))
    near = 0
    if persons and (hits or more):
        at = np.array([w in lexicon or w in learnt for w in words]).nonzero()[0]
        you = np.array([w in second for w in words]).nonzero()[0]
        place = you.searchsorted(at)
        after = you[place.clip(max=len(you) - 1)] - at
        before = at - you[(place - 1).clip(min=0)]
        near = int(((np.abs(after) <= NEAR) | (np.abs(before) <= NEAR)).sum())
    upper = counts[65:91].sum()
    letters = max(upper + counts[97:123].sum() + counts[0xC0:].sum(), 1)
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    disguised = disguises = 0
    if counts[48:58].sum() + counts[64] + counts[36] + counts[33]:
        for w in small.translate(KEPT_SIGNS).split():
            if not w.isalpha() and DIGITS_AND_SIGNS.intersection(w):
                plain = w.rstrip(b"!").translate(SIGNS)
                if plain != w.rstrip(b"!") and plain.isalpha() and not w.isdigit():
                    disguised += 1
                    disguises += plain in lexicon or plain in learnt
    return [
        len(hits) / n, np.log1p(len(hits)), len(set(hits)),
        len(more) / n, np.log1p(len(more)), len(set(more)),
        len(stemmed) / n, np.log1p(len(stemmed)),
        persons / n, near,
        upper / letters, sum(map(bytes.isupper, text.split())) / n,
        counts[33] / n, counts[63] / n, marks / n,
        disguised / n, disguises, np.log1p(len(words)),
    ]


class Trees:
    """Boosted regression trees of fixed depth on binned features, for the logistic loss."""

    def __init__(self, bins: int = 48, depth: int = 3, rounds: int = 80, rate: float = 0.15, smooth: float = 4.0):
        self.bins, self.depth, self.rounds, self.rate, self.smooth = bins, depth, rounds, rate, smooth
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cut, x[:, k], side="left") for k, cut in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        d = x.shape[1]
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins)[1:-1])) for k in range(d)]
        # rare counts sit above the highest quantile: zero against the rest is always a cut
        self.cuts = [np.unique(np.r_[0.0, c]) for c in self.cuts]
        width = 1 + max(len(c) for c in self.cuts)
        b = self._binned(x)
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.start = np.log(share / (1 - share))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, width)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                slot = (node[:, None] * d + np.arange(d)) * width + b
                g = np.bincount(slot.ravel(), np.repeat(grad, d), many * d * width).reshape(many, d, width).cumsum(axis=2)
                h = np.bincount(slot.ravel(), np.repeat(hess, d), many * d * width).reshape(many, d, width).cumsum(axis=2)
                all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
                gain = g**2 / (h + self.smooth) + (all_g - g) ** 2 / (all_h - h + self.smooth) - all_g**2 / (all_h + self.smooth)
                best = gain.reshape(many, -1).argmax(axis=1)
                feature[first : first + many], cut[first : first + many] = best // width, best % width
                own = first + node
                node = 2 * node + (b[np.arange(len(y)), feature[own]] > cut[own])
            leaf = self.rate * np.bincount(node, grad, 2**self.depth) / (np.bincount(node, hess, 2**self.depth) + self.smooth)
            margin += leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                own = 2**level - 1 + node
                node = 2 * node + (b[rows, feature[own]] > cut[own])
            out += leaf[node]
        return out


def isotonic(value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (values, rising probabilities) to interpolate between."""
    order = value.argsort(kind="stable")
    blocks: list[list[float]] = []
    for v, t in zip(value[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([t, 1.0, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2], hi]
    knots = [(v, t / n) for t, n, lo, hi in blocks for v in ([lo] if lo == hi else [lo, hi])]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Model:
    def __init__(self, learnt: frozenset[bytes] = frozenset(), stems: tuple[frozenset[bytes], ...] = (frozenset(),) * len(STEMS)):
        self.lexicon = frozenset(w.encode() for w in INSULTS.split())
        self.second = frozenset(w.encode() for w in SECOND_PERSON.split())
        self.learnt, self.stems, self.constant, self.trees, self.knots = learnt, stems, 0.0, None, None
        self.heads = frozenset(x[: STEMS[0]] for own in stems for x in own)

    def table(self, texts: list[bytes]) -> np.ndarray:
        return np.array([features(t, self.lexicon, self.learnt, self.stems, self.heads, self.second) for t in texts], float).reshape(-1, len(FEATURES))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        return np.interp(self.trees.margin(x), *self.knots)


def learnt_units(sample: DataFrame, share: float, least_docs: int = 5, size: int = 500) -> list[frozenset[bytes]]:
    """The words, and the stems of each length in STEMS, most over-represented in texts with label 1.

    Tasks count in how many of their texts each occurs, Spark adds up, and the `size` best of each kind are taken.
    """
    kinds = (0, *STEMS)

    def run(batches):
        counts: dict[tuple[int, bytes], list[int]] = {}

        def rows():
            keys = [*counts]
            n = np.array([counts[k] for k in keys], np.int64).reshape(-1, 2)
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["kind", "unit", "toxic", "n"])

        for part in slices(batches):
            for text, label in zip(as_bytes(part), part.column("label").to_pylist(), strict=True):
                words = set(text.lower().translate(PUNCTUATION).split())
                units = {(0, w) for w in words}
                for k in STEMS:
                    units.update((k, x) for w in words if (x := stem(w, k)))
                for u in units:
                    own = counts.get(u)
                    if own is None:
                        counts[u] = [label, 1]
                    else:
                        own[0] += label
                        own[1] += 1
            if len(counts) > 200_000:
                yield rows()
        yield rows()

    counts = sample.select("text", "label").mapInArrow(run, "kind long, unit binary, toxic long, n long").groupBy("kind", "unit").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    rate = (F.col("toxic") + 5 * share) / (F.col("n") + 5)
    good = saved(counts.where((F.col("toxic") >= least_docs) & (rate > 0.6)).withColumn("rate", rate), "toxic-units")
    return [frozenset(bytes(r["unit"]) for r in good.where(F.col("kind") == k).orderBy(F.desc("rate"), F.desc("n"), "unit").limit(size).collect()) for k in kinds]


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 20_000) -> Model:
    """Learns from docs (doc_id, text) with labels (doc_id, label); label is 0 or 1."""
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("label").cast("long")).alias("label"))
    n, ones = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n:
        return Model()
    # about max_fit_rows ids, with the number of rows that have each
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, max_fit_rows / n))))
    held = docs.select("doc_id").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("rows"))
    held = F.broadcast(saved(held, "drawn-labels"))
    # of the rows that share an id about one stays, and one of equal rows
    sample = docs.select("doc_id", "text").join(held, "doc_id").where(F.pmod(F.xxhash64("doc_id", "text"), F.col("rows")) == 0)
    sample = once(sample, ["doc_id", "text"], sample.where("rows > 1").select("doc_id", "text"))
    learnt, *stems = learnt_units(sample, ones / n)
    model = Model(learnt, tuple(stems))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in slices(batches):
            x = shared.value.table(as_bytes(part))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), values], names=["key", "label", "x"])

    points = sample.select(F.xxhash64("doc_id", "text").alias("key"), "label", "text").mapInArrow(run, "key long, label long, x array<double>").toArrow()
    key, y = points.column("key").to_numpy(), points.column("label").to_numpy().astype(float)
    order = key.argsort(kind="stable")  # whatever the order in which tasks came back
    x = np.array(points.column("x").to_pylist()).reshape(-1, len(FEATURES))[order]
    y, key = y[order], key[order]
    model.constant = float(y.mean()) if len(y) else 0.0
    aside = key % 4 == 0
    if min(y.sum(), len(y) - y.sum()) < 1 or len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        return model
    model.trees = Trees().fit(x[~aside], y[~aside])
    model.knots = isotonic(model.trees.margin(x[aside]), y[aside])
    return model


def scored(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """(doc_id, the columns keep, score)."""
    source = docs.select("doc_id", *keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in source.columns if c != "text"]

    def run(batches):
        for part in slices(batches):
            score = shared.value.score(shared.value.table(as_bytes(part)))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(score)], names=[*names, "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    return source.mapInArrow(run, f"{kept}, score double")


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more; every column stays as it is, and no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in slices(batches):
            score = shared.value.score(shared.value.table(as_bytes(part)))
            yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
