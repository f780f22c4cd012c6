"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a short vector of statistics (lengths, shares of symbols, capitals, repeats and so on), every one through
a logarithm or square root so that it is nearer to a normal. The classes' means and covariances come from sums over all
labelled documents (partial sums per task, added up by Spark), so nothing is sampled. Each covariance is shrunk towards
the pooled one and that towards a multiple of the identity; its Cholesky factor is computed once, and a text's score is
the difference of the two log densities (Mahalanobis terms by triangular solves with the cached factors), put on a scale
of probabilities by a logistic line fitted to a histogram of the differences of all labelled documents.

The text is read once; what is written out in between is one row of statistics per document. The model has a few hundred
numbers and is broadcast.

Defined results: null and empty texts have the statistics of an empty text and get a score like any other; rows without
a label are not learnt from; if either class is empty every score is the share of label 1 (0.5 without labels); equal rows
give equal results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.common import as_bytes, saved, slices
from lumaframe.llm.decontaminate import WordHashes, window_hashes

FEATURES = [
    "words", "word_length", "long_words", "symbols", "bars", "capitals", "capital_words", "digits", "exclamations", "stops",
    "commas", "distinct_words", "repeated_grams", "line_words", "repeated_lines", "spaces",
]
#: Bins of the histogram that the logistic line is fitted to.
BINS = 400
SPAN = 60.0


def statistics(text: bytes, hashes: WordHashes) -> list[float]:
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = max(len(words), 1)
    size = max(len(text), 1)
    points = counts[:0x80].sum() + counts[0xC0:].sum()
    upper = counts[65:91].sum()
    letters = max(upper + counts[97:123].sum() + counts[0xC0:].sum(), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    grams = window_hashes(ids, 4)
    repeats = 1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0
    lines = [x for x in text.split(b"\n") if x]
    distinct = len(np.unique(ids))
    return [
        np.log1p(len(words)),
        np.log1p(points / n),
        np.sqrt((lengths > 20).sum() / n),
        np.sqrt(sum(counts[b] for b in b"#*$%&@^~<>{}[]\\=_+") / n),
        np.sqrt(counts[124] / n),
        np.sqrt(upper / letters),
        np.sqrt(sum(map(bytes.isupper, words)) / n),
        np.sqrt(counts[48:58].sum() / size),
        np.sqrt(counts[33] / n),
        np.sqrt((counts[46] + counts[63]) / n),
        np.sqrt((counts[44] + counts[59]) / n),
        np.log1p(distinct) / np.log1p(n),
        np.sqrt(repeats),
        np.log1p(n / max(len(lines), 1)),
        np.sqrt(1 - len(set(lines)) / max(len(lines), 1)) if lines else 0.0,
        np.sqrt(counts[32] / size),
    ]


def vectors(docs: DataFrame, *keep: Column) -> DataFrame:
    """(doc_id, the columns keep, x): x is the array of FEATURES."""
    source = docs.select("doc_id", *keep, "text")

    def run(batches):
        hashes = WordHashes()
        for part in slices(batches):
            x = np.array([statistics(t, hashes) for t in as_bytes(part)], np.float32)
            others = [part.column(c) for c in part.schema.names if c != "text"]
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*others, values], names=[*[c for c in part.schema.names if c != "text"], "x"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    return source.mapInArrow(run, f"{kept}, x array<float>")


def forward(factor: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Solves factor @ z = y for a lower triangular factor and columns y, row by row."""
    z = np.empty_like(y)
    for k in range(len(factor)):
        z[k] = (y[k] - factor[k, :k] @ z[:k]) / factor[k, k]
    return z


#: Variance, in units of the scale, that is left where all labelled rows of a class are alike.
FLOOR = 0.1


class Discriminant:
    """Two classes' means and cached Cholesky factors; slope and offset of the logistic line."""

    def __init__(self, sums: dict[int, np.ndarray], shrink: float, ridge: float):
        """sums[label]: n, the sum of x and the sum of the outer products of x, in one row."""
        d = len(FEATURES)
        self.constant: float | None = None
        n = {k: float(v[0]) for k, v in sums.items()}
        if len([k for k in n if n[k] > 0]) < 2:
            self.constant = 0.5 if not n else float(max(n, key=n.get))
            return
        mean, cov = {}, {}
        for k, v in sums.items():
            mean[k] = v[1 : d + 1] / n[k]
            cov[k] = v[d + 1 :].reshape(d, d) / n[k] - np.outer(mean[k], mean[k])
        pooled = sum(n[k] * cov[k] for k in n) / sum(n.values())
        self.scale = np.sqrt(np.diag(pooled) + 1e-8)
        between = np.outer(self.scale, self.scale)
        pooled = pooled / between
        pooled = (1 - ridge) * pooled + ridge * max(np.trace(pooled) / d, FLOOR) * np.eye(d)
        self.mean = {k: mean[k] / self.scale for k in n}
        self.factor = {k: np.linalg.cholesky((1 - s) * cov[k] / between + s * pooled) for k in n for s in [max(shrink, min(1.0, 3 * d / n[k]))]}
        self.log_prior = np.log(n[1] / n[0])
        self.slope, self.offset = 1.0, 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 over label 0, prior included."""
        side = {}
        for k in (0, 1):
            z = forward(self.factor[k], (x / self.scale - self.mean[k]).T)
            side[k] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(self.factor[k])).sum()
        return np.clip(side[1] - side[0] + self.log_prior, -SPAN, SPAN)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.offset)))

    def calibrate(self, middle: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        """Newton steps for the logistic line through counts of labels at the differences in middle."""
        w = np.array([1.0, 0.0])
        design = np.stack([middle, np.ones_like(middle)], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ w))
            grad = design.T @ (ones - (ones + zeros) * p) - 1e-3 * w
            hess = (design * ((ones + zeros) * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            w = w + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.offset = max(float(w[0]), 1e-3), float(w[1])


def matrix(column) -> np.ndarray:
    return np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64).reshape(-1, len(FEATURES)) if len(column) else np.zeros((0, len(FEATURES)))


def column_of(part: pa.RecordBatch) -> pa.ListArray:
    x = part.column("x")
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), x.flatten())


def fit(labelled: DataFrame, shrink: float = 0.1, ridge: float = 0.05) -> Discriminant:
    """Learns from (x, label); label is 0 or 1."""
    size = 1 + len(FEATURES) + len(FEATURES) ** 2

    def add_up(batches):
        total = np.zeros((2, size))
        for part in batches:
            x, y = matrix(column_of(part)), part.column("label").to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], size)), pa.array(np.tile(np.arange(size), 2)), pa.array(total.ravel())], names=["label", "slot", "v"])

    sums: dict[int, np.ndarray] = {}
    for r in labelled.select("x", "label").mapInArrow(add_up, "label long, slot long, v double").groupBy("label", "slot").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r["label"], np.zeros(size))[r["slot"]] = r["v"]
    model = Discriminant({k: v for k, v in sums.items() if v[0] > 0}, shrink, ridge)
    if model.constant is not None:
        return model
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def histogram(batches):
        counts = np.zeros((2, BINS), np.int64)
        for part in batches:
            place = ((shared.value.difference(matrix(column_of(part))) + SPAN) / (2 * SPAN) * BINS).astype(np.int64).clip(0, BINS - 1)
            for k in (0, 1):
                counts[k] += np.bincount(place[part.column("label").to_numpy() == k], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], BINS)), pa.array(np.tile(np.arange(BINS), 2)), pa.array(counts.ravel())], names=["label", "slot", "n"])

    counts = np.zeros((2, BINS))
    for r in labelled.select("x", "label").mapInArrow(histogram, "label long, slot long, n long").groupBy("label", "slot").agg(F.sum("n").alias("n")).collect():
        counts[r["label"], r["slot"]] = r["n"]
    model.calibrate((np.arange(BINS) + 0.5) / BINS * 2 * SPAN - SPAN, counts[1], counts[0])
    return model


def scored(points: DataFrame, model: Discriminant) -> DataFrame:
    """vectors() with the column score in place of x."""
    shared = points.sparkSession.sparkContext.broadcast(model)
    names = [c for c in points.columns if c != "x"]

    def run(batches):
        for part in batches:
            score = shared.value.score(matrix(column_of(part)))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(score)], names=[*names, "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema if f.name != "x")
    return points.select(*names, "x").mapInArrow(run, f"{kept}, score double")


def classify(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3) -> DataFrame:
    """(doc_id, learn, score, predicted): learns from the rows where learn is true and labels (doc_id, label) has 0 or 1."""
    points = saved(vectors(docs, learn.alias("learn")), "quality-vectors")
    known = labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("long").alias("label"))
    model = fit(points.where("learn").join(known, "doc_id").select("x", "label"))
    return scored(points, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
