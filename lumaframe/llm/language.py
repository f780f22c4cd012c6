"""Language identification by words, with spans for mixed text.

A word is a letter and the letters and combining marks that follow it. The script of its first letter, by code point ranges, narrows the candidates to the languages
that are written in it; each candidate scores the word by the letter trigrams it has learnt. A Viterbi pass over the
words of a text, with a penalty for every switch, labels spans; the language with the most letters names the text.

Learning counts hashed trigrams over a sample of `max_fit_rows` documents per language (drawn by a hash of the id; all of
them if there are fewer); the model has BUCKETS numbers per language, of which there may be MAX_LANGUAGES, and is broadcast. Labelling reads each text once,
where it lies; the passes over the texts of a slice run side by side.

Defined results: a null text or one without a letter is `und` with score 0; ties go to the language first in order of
name; equal rows give equal results; an empty table gives an empty result; without anything to learn from every text is
`und`; more than MAX_LANGUAGES values in the language column are an error; texts may be of any length; other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.common import slices

BUCKETS = 1 << 15
#: More values than these in the language column are refused: they are no languages, and the model has to stay small.
MAX_LANGUAGES = 400
#: Scores (letters times languages) that are held at once.
SCORES = 1 << 24
NO_LANGUAGE = "und"
# Unicode ranges of scripts, first and last code point.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x591, 0x5F4), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}


@cache
def combining() -> np.ndarray:
    """Which code points are marks that belong to the letter before them."""
    return np.array([unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)])


@cache
def letter_scripts() -> np.ndarray:
    """For each code point 0 if it is no letter, else 1 + the number of its script, or 1 + len(SCRIPTS) for others."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = 1 + len(SCRIPTS)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            part = out[first : last + 1]
            part[part > 0] = k
    return out


class Letters:
    """The letters of some texts in a row: trigram bucket and word of each, script and text of each word."""

    def __init__(self, texts: list[str | None]):
        data = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
        # two code points that are no letters part the texts
        points = np.frombuffer(b"\0" * 4 + b"".join(d + b"\0" * 4 for d in data), np.uint32)
        script = letter_scripts()[points]
        is_letter = script > 0
        marks = combining()[points].nonzero()[0]
        if len(marks):  # those that follow a letter, with marks only between, count as letters of its word
            base = marks - 1
            while len(more := (combining()[points[base]]).nonzero()[0]):
                base[more] -= 1
            is_letter[marks[script[base] > 0]] = True
        at = is_letter.nonzero()[0]
        code = np.where(is_letter, points, 0).astype(np.uint64)
        mixed = (code[at - 1] * np.uint64(0x9E3779B97F4A7C15) + code[at]) * np.uint64(0xC2B2AE3D27D4EB4F) + code[at + 1]
        self.bucket = ((mixed * np.uint64(0x165667B19E3779F9)) >> np.uint64(49)).astype(np.int64)
        starts = ~is_letter[at - 1]
        self.word_first = starts.nonzero()[0]  # among the letters
        self.word_size = np.diff(np.r_[self.word_first, len(at)])
        first_at = at[starts]
        self.word_script = script[first_at]
        self.letter_script = np.repeat(self.word_script, self.word_size)
        ends = 1 + np.cumsum([len(d) // 4 + 1 for d in data])
        self.word_text = np.searchsorted(ends, first_at, side="right")
        self.word_place = first_at - np.r_[1, ends[:-1]][self.word_text] if len(data) else first_at
        self.letter_text = np.repeat(self.word_text, self.word_size)


class Model:
    def __init__(self, languages: list[str], trigrams: np.ndarray, scripts: np.ndarray, penalty: float):
        """trigrams[language, bucket] and scripts[language, script] are counts."""
        self.languages, self.penalty = languages, penalty
        smooth = trigrams + 0.5
        self.log = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        allowed = (share >= 0.001).T  # [script, language]
        allowed[~allowed.any(axis=1)] = True
        self.narrow = np.where(allowed, 0, -1e4).astype(np.float32)

    def word_scores(self, letters: Letters) -> np.ndarray:
        if not len(letters.word_first):
            return np.zeros((0, len(self.languages)), np.float32)
        scores = np.empty((len(letters.word_first), len(self.languages)), np.float32)
        step, k = max(1, SCORES // len(self.languages)), 0
        while k < len(scores):  # a part of the words at a time
            start = letters.word_first[k]
            j = max(k + 1, int(letters.word_first.searchsorted(start + step)))
            stop = letters.word_first[j] if j < len(scores) else len(letters.bucket)
            scores[k:j] = np.add.reduceat(self.log[letters.bucket[start:stop]], letters.word_first[k:j] - start, axis=0)
            k = j
        scores += self.narrow[letters.word_script]
        return scores

    def labels(self, scores: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The language of each word: the best path through the words of each text (text numbers ascend)."""
        first = np.r_[0, (np.diff(text) != 0).nonzero()[0] + 1]
        size = np.diff(np.r_[first, len(text)])
        total = np.add.reduceat(scores.astype(np.float64), first, axis=0)
        whole = total.argmax(axis=1)
        gain = np.add.reduceat((scores.max(axis=1)).astype(np.float64), first) - total.max(axis=1)
        out = whole.repeat(size)
        # if even free switching gains no more than one penalty, one language throughout is the best path
        mixed = (gain > self.penalty).nonzero()[0]
        mixed = mixed[size[mixed].argsort(kind="stable")[::-1]]
        if not len(mixed):
            return out
        first, size = first[mixed], size[mixed]
        steps = int(size[0])
        active = np.searchsorted(-size, -np.arange(steps), side="left")  # texts longer than each step
        best = np.zeros((len(mixed), scores.shape[1]))
        came = np.zeros((int(active.sum()), scores.shape[1]), np.int16)
        offsets = np.cumsum(active) - active
        rows = np.arange(len(mixed))
        own = np.arange(scores.shape[1])
        for t in range(steps):
            n = active[t]
            here = best[:n]
            if t:
                top = here.argmax(axis=1)
                switch = here[rows[:n], top] - self.penalty
                stay = here >= switch[:, None]
                came[offsets[t] : offsets[t] + n] = np.where(stay, own, top[:, None])
                here = np.where(stay, here, switch[:, None])
            best[:n] = here + scores[first[:n] + t]
        state = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            out[first[:n] + t] = state[:n]
            if t:
                state[:n] = came[offsets[t] + rows[:n], state[:n]]
        return out

    def label_words(self, letters: Letters) -> np.ndarray:
        scores = self.word_scores(letters)
        return self.labels(scores, letters.word_text) if len(scores) else np.zeros(0, np.int64)


def fit(docs: DataFrame, lang: str = "lang", max_fit_rows: int = 4000, penalty: float = 12.0) -> Model:
    """Learns from the rows of docs (doc_id, text and the language column) that have a language."""
    spark = docs.sparkSession
    known = docs.where(F.col(lang).isNotNull()).select("doc_id", "text", F.col(lang).alias("known"))
    sizes = {r[0]: r[1] for r in known.groupBy("known").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"the column {lang} has more than {MAX_LANGUAGES} values")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPTS) + 2)), penalty)
    number = {name: k for k, name in enumerate(languages)}
    share = spark.createDataFrame([(k, min(1.0, max_fit_rows / n)) for k, n in sizes.items()], "l string, share double")
    sample = known.join(F.broadcast(share), F.col("known") == F.col("l")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def run(batches):
        for part in slices(batches):
            letters = Letters(part.column("text").to_pylist())
            names = np.array([number[x] for x in part.column("l").to_pylist()], np.int64)
            owner = names[letters.letter_text]
            for kind, slots in ((0, owner * BUCKETS + letters.bucket), (1, owner * (len(SCRIPTS) + 2) + letters.letter_script)):
                at, n = np.unique(slots, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at), pa.array(n)], names=["kind", "slot", "n"])

    counts = sample.select("text", "l").mapInArrow(run, "kind long, slot long, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow()
    kind, slot, n = (counts.column(c).to_numpy() for c in ("kind", "slot", "n"))
    grams, scripts = np.zeros(len(languages) * BUCKETS), np.zeros(len(languages) * (len(SCRIPTS) + 2))
    grams[slot[kind == 0]] = n[kind == 0]
    scripts[slot[kind == 1]] = n[kind == 1]
    return Model(languages, grams.reshape(-1, BUCKETS), scripts.reshape(len(languages), -1), penalty)


def predicted(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """(doc_id, the columns keep, lang_pred, score): score is the share of the letters in spans of lang_pred."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", *keep, "text")

    def run(batches):
        model = shared.value
        for part in slices(batches):
            n, k = part.num_rows, len(model.languages)
            letters = Letters(part.column("text").to_pylist())
            names, score = np.full(n, NO_LANGUAGE, object), np.zeros(n)
            if k and len(letters.word_first):
                label = model.label_words(letters)
                held = np.bincount(letters.word_text * k + label, weights=letters.word_size, minlength=n * k).reshape(n, k)
                some = held.sum(axis=1) > 0
                names[some] = np.array(model.languages, object)[held.argmax(axis=1)[some]]
                score[some] = held.max(axis=1)[some] / held.sum(axis=1)[some]
            others = [part.column(c) for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(names, pa.string()), pa.array(score)], names=[*[c for c in part.schema.names if c != "text"], "lang_pred", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    return source.mapInArrow(run, f"{kept}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, span, lang, start, n_words): the spans of each text; start is the code point of the lower-cased text where one begins."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for part in slices(batches):
            letters = Letters(part.column("text").to_pylist())
            if not model.languages or not len(letters.word_first):
                continue
            label, text = model.label_words(letters), letters.word_text
            new = np.r_[True, (np.diff(label) != 0) | (np.diff(text) != 0)].nonzero()[0]
            size = np.diff(np.r_[new, len(label)])
            fresh = np.r_[True, np.diff(text[new]) != 0]
            number = np.arange(len(new)) - np.maximum.accumulate(np.where(fresh, np.arange(len(new)), 0))
            names = pa.array(np.array(model.languages, object)[label[new]], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text[new])), pa.array(number), names, pa.array(letters.word_place[new]), pa.array(size)], names=["doc_id", "span", "lang", "start", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, span long, lang string, start long, n_words long")
