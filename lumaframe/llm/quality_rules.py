"""Quality rules as weak supervision.

Every rule looks at one statistic of a text and votes good, bad or nothing. The votes of all documents are counted per
combination of votes (at most 3 ** len(RULES) combinations, counted by partial aggregation); expectation-maximisation
over these counts estimates how often each rule is right about good and about bad texts, and the share of good texts.
A document's verdict is the posterior probability that it is good, not whether it passes every rule.

Texts are read once and not shuffled; what is written out between the two steps is one small row per document.

Defined results: null and empty texts have no words, so base_failed is true; equal rows give equal results; an empty
table gives an empty result; texts may be of any length; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.common import as_bytes, saved, slices
from lumaframe.llm.decontaminate import WordHashes, window_hashes

# Frequent words of the languages that the stop-word rule knows.
STOP_WORDS = """
the of and to in a is that it for on with as are was be this by from at or an not have
der die das und ist in den von zu mit sich auf für im dem nicht ein eine als auch
le la les de des et en un une du que qui dans pour sur est au par plus pas avec
el la los las de que y en un una por con para del se es al lo como su
"""
SYMBOLS = b"#*$%&|<>"
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: name -> (bad if below, good from, good up to, bad if above), None where a side does not vote
RULES = {
    "symbols_per_word": (None, None, 0.02, 0.2),
    "word_length": (2.0, 3.0, 9.5, 14.0),
    "capitals": (None, None, 0.15, 0.4),
    "stop_words": (0.01, 0.06, None, None),
    "letter_words": (0.6, 0.9, None, None),
    "dup_lines": (None, None, 0.05, 0.3),
    "repeat_words": (None, None, 0.03, 0.15),
    "marks_per_word": (None, None, 0.25, 0.6),
}


def statistics(text: bytes, hashes: WordHashes, stop: frozenset[bytes]) -> tuple[list[int], list[float]]:
    """The counts in COLUMNS and the values that RULES look at."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    points = int(counts[:0x80].sum() + counts[0xC0:].sum())
    word_chars = points - int(counts[32] + counts[9:14].sum())
    symbols = int(sum(counts[b] for b in SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat = 0
    if n >= 6:
        h = window_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, n), 5)
        order = h.argsort(kind="stable")
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[order[1:]] == h[order[:-1]]
        twice = order[same[1:] | same[:-1]]
        if len(twice):
            cover = np.zeros(n + 1, np.int64)
            cover[twice] += 1
            np.subtract.at(cover, twice + 5, 1)
            repeat = int((np.cumsum(cover)[:n] > 0).sum())
    upper = int(counts[65:91].sum())
    letters = upper + int(counts[97:123].sum()) + int(counts[0xC0:].sum())
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    values = [
        symbols / max(n, 1),
        word_chars / max(n, 1),
        upper / max(letters, 1),
        sum(map(stop.__contains__, text.lower().split())) / max(n, 1),
        1 - sum(w.isdigit() or (len(w) == 1 and not w.isalnum()) for w in words) / max(n, 1),
        dup_lines / max(len(lines), 1),
        repeat / max(n, 1),
        marks / max(n, 1),
    ]
    return [n, word_chars, symbols, dup_lines, repeat], values


def vote(value: float, rule: tuple) -> int:
    """1 good, 2 bad, 0 no vote."""
    low, good_from, good_to, high = rule
    if low is not None and value < low or high is not None and value > high:
        return 2
    return int((good_from is None or value >= good_from) and (good_to is None or value <= good_to))


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, COLUMNS, votes): the votes are the digits of one number to the base three."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    stop = frozenset(w.encode() for w in STOP_WORDS.split())

    def run(batches):
        hashes = WordHashes()
        for part in slices(batches):
            counts, cast = [], []
            for text in as_bytes(part):
                c, values = statistics(text, hashes, stop)
                counts.append(c)
                cast.append(sum(vote(v, r) * 3**k for k, (v, r) in enumerate(zip(values, RULES.values(), strict=True))))
            table = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(table[:, k]) for k in range(len(COLUMNS))], pa.array(cast, pa.int64())], names=["doc_id", *COLUMNS, "votes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in COLUMNS)}, votes long")


def estimate(patterns: dict[int, int], n_rules: int, rounds: int = 100) -> tuple[float, np.ndarray, dict[int, float]]:
    """Expectation-maximisation over counts of vote combinations.

    Returns the share of good texts, right[j, y] = the chance that rule j, when it votes, is right about a text of class y
    (0 bad, 1 good), and the posterior of each combination. Chances stay within [0.55, 0.98]: a rule is taken to be better
    than a coin and never certain.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    cast = np.array([[k // 3**j % 3 for j in range(n_rules)] for k in keys]).reshape(len(keys), n_rules)
    share, right = 0.8, np.full((n_rules, 2), 0.8)
    post = np.full(len(keys), share)
    for _ in range(rounds):
        good = math.log(share) + np.where(cast == 1, np.log(right[:, 1]), np.where(cast == 2, np.log(1 - right[:, 1]), 0)).sum(axis=1)
        bad = math.log(1 - share) + np.where(cast == 2, np.log(right[:, 0]), np.where(cast == 1, np.log(1 - right[:, 0]), 0)).sum(axis=1)
        old, post = post, 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
        for j in range(n_rules):
            for y, weight in ((1, n * post), (0, n * (1 - post))):
                said, agreed = weight[cast[:, j] > 0].sum(), weight[cast[:, j] == 2 - y].sum()
                right[j, y] = np.clip((agreed + 8) / (said + 10), 0.55, 0.98)  # a prior of ten votes, eight of them right
        share = float(np.clip((n * post).sum() / max(n.sum(), 1), 0.05, 0.95))
        if np.abs(post - old).max(initial=0) < 1e-9:
            break
    return share, right, dict(zip(keys, post.tolist(), strict=True))


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, COLUMNS, base_failed, quality, kept): quality is the posterior, kept needs quality >= threshold and not base_failed."""
    cast = saved(votes(docs), "votes")
    counts = {r["votes"]: r["count"] for r in cast.groupBy("votes").count().collect()}  # at most 3 ** 8 rows
    _, _, post = estimate(counts, len(RULES))
    posterior = docs.sparkSession.createDataFrame(list(post.items()), "v long, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = cast.join(F.broadcast(posterior), F.col("votes") == F.col("v"))
    return found.select("doc_id", *COLUMNS, failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality")
