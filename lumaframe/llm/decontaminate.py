"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become words (lower case, punctuation dropped). A document and an item that share a seed
of `least` words meet; the longest match of unmarked words is marked in both, again and again, until no match of `least`
words is left. Matches grow out of Karp-Rabin hashes of word windows and are compared word by word (64-bit word
hashes). The share of the item's words under tiles is its coverage; order plays no part, so reordered passages count.

The benchmark is broadcast only after its words have been counted and found to be at most `max_broadcast_words`; then a
document is read once, where it lies, and never shuffled; the index of seeds is built once, by the driver. A larger
benchmark meets the documents in a join on seeds (distinct per document; a seed held by a third of the documents is a
skewed equi-join that adaptive execution splits), and only documents that share a seed are fetched. Both ways give the same
rows and schema. Seeds of a document and an item are looked at PAIRS at a time and kept as runs along diagonals, so memory
follows the texts and the number of maximal matches, not the product of their lengths.

Defined results: null and empty texts, and items of fewer than `least` words, match nothing; items that share an id but
not a text are items of their own with that id; equal rows give equal results; empty tables give an empty result; a null
doc_id or item_id is carried as it is; other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lumaframe.llm.common import saved, slices

BASE = np.uint64(0x9E3779B97F4A7C15)
PUNCTUATION = bytes(32 if b < 0x80 and not chr(b).isalnum() else b for b in range(256))
CACHE = 500_000
RESULT = "item_id {item}, n_item_words long, n_matched_words long, n_tiles long, coverage double"
#: Pairs of equal seeds that are held at once.
PAIRS = 1 << 20


class WordHashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().encode("utf-8", "surrogatepass").translate(PUNCTUATION).split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window of size words, modulo 2**64."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, size):
        h *= BASE
        h += words[k : k + n]
    return h


def matches(text: np.ndarray, item: np.ndarray, least: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of at least `least` equal words: (place in item, place in text, length).

    at: the places in text where a seed of any item starts, if known, ascending.
    """
    seeds, there = window_hashes(item, least), window_hashes(text, least)
    at = np.arange(len(there)) if at is None else at
    order = seeds.argsort(kind="stable")
    ranked = seeds[order]
    low, high = ranked.searchsorted(there[at], "left"), ranked.searchsorted(there[at], "right")
    many = high - low
    upto = np.cumsum(many)
    parts, k = [], 0
    while k < len(at):
        j = max(k + 1, int(upto.searchsorted((upto[k - 1] if k else 0) + PAIRS, "right")))
        n = many[k:j]
        t = np.repeat(at[k:j], n)
        i = order[np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[k:j], n)]
        same = np.ones(len(t), bool)
        for w in range(least):
            same &= text[t + w] == item[i + w]
        t, i = t[same], i[same]
        parts.append(joined(t - i, t, np.ones(len(t), np.int64)))
        k = j
        if len(parts) > 16:
            parts = [joined(*map(np.concatenate, zip(*parts, strict=True)))]
    line, t, n = joined(*map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64),) * 3
    return t - line, t, n + least - 1


def joined(line: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of n seeds from t on, on a diagonal each; those that follow each other become one."""
    order = np.lexsort((t, line))
    line, t, n = line[order], t[order], n[order]
    new = np.r_[True, (line[1:] != line[:-1]) | (t[1:] != t[:-1] + n[:-1])][: len(t)].nonzero()[0]
    return line[new], t[new], np.add.reduceat(n, new) if len(new) else n


def tiles(text: np.ndarray, item: np.ndarray, least: int, at: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length), longest first; ties go to the earliest in item, then text."""
    i, t, size = matches(text, item, least, at)
    queue = [(-n, a, b) for n, a, b in zip(size.tolist(), i.tolist(), t.tolist(), strict=True)]
    heapq.heapify(queue)
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    found = []
    while queue:
        n, a, b = heapq.heappop(queue)
        n = -n
        free = free_item[a : a + n] & free_text[b : b + n]
        if free.all():
            free_item[a : a + n] = free_text[b : b + n] = False
            found.append((a, b, n))
            continue
        edges = np.diff(np.r_[0, free.astype(np.int8), 0])
        for s, e in zip((edges == 1).nonzero()[0].tolist(), (edges == -1).nonzero()[0].tolist(), strict=True):
            if e - s >= least:
                heapq.heappush(queue, (s - e, a + s, b + s))
    return found


def _result(words: np.ndarray, item: np.ndarray, least: int, at: np.ndarray | None = None) -> tuple[int, int, int, float] | None:
    found = tiles(words, item, least, at)
    matched = sum(n for _, _, n in found)
    return (len(item), matched, len(found), matched / len(item)) if found else None


class Seeds:
    """The words of all items with a sorted index of their seeds, for one pass over the documents."""

    def __init__(self, texts: list[str], least: int):
        hashes = WordHashes()
        self.items, self.least = [hashes.of(t) for t in texts], least
        own = [np.unique(window_hashes(words, least)) for words in self.items]
        seeds, owner = np.concatenate([np.empty(0, np.uint64), *own]), np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = seeds.argsort(kind="stable")
        self.seeds, self.owner = seeds[order], owner[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(seeds >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, words: np.ndarray):
        """(item, its words, matched words, tiles, coverage) for each item that has a tile in the words."""
        hashes = window_hashes(words, self.least)
        maybe = self.filter[(hashes >> np.uint64(44)).astype(np.int64)].nonzero()[0]
        if not len(maybe):
            return
        low, high = self.seeds.searchsorted(hashes[maybe], "left"), self.seeds.searchsorted(hashes[maybe], "right")
        n = high - low
        place = np.repeat(maybe, n)
        owner = self.owner[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        order = owner.argsort(kind="stable")
        owner, place = owner[order], place[order]
        cuts = np.r_[0, (np.diff(owner) != 0).nonzero()[0] + 1, len(owner)].tolist()
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i and (found := _result(words, self.items[owner[i]], self.least, place[i:j])):
                yield (int(owner[i]), *found)


NUMBERS = [("n_item_words", pa.int64()), ("n_matched_words", pa.int64()), ("n_tiles", pa.int64()), ("coverage", pa.float64())]


def _schema(docs: DataFrame, items: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, body long, {RESULT.format(item=items.schema['item_id'].dataType.simpleString())}"


def _by_broadcast(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    table = items.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((table.column("item_id").combine_chunks(), Seeds(table.column("text").to_pylist(), least)))

    def run(batches):
        hashes = WordHashes()
        names, seeds = shared.value
        for part in slices(batches):
            out = [(row, *m) for row, text in enumerate(part.column("text").to_pylist()) for m in seeds.matches(hashes.of(text))]
            row, item = (pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))
            columns = [pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(NUMBERS, 2)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), part.column("body").take(row), names.take(item), *columns], names=["doc_id", "body", "item_id", *[n for n, _ in NUMBERS]])

    return docs.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(run, _schema(docs, items))


def _seeds_of(df: DataFrame, key: str, least: int) -> DataFrame:
    """(key, body, seed): the distinct seeds of each text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for part in slices(batches):
            found = [np.unique(window_hashes(hashes.of(t), least)).view(np.int64) for t in part.column("text").to_pylist()]
            row = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([part.column(key).take(row), part.column("body").take(row), pa.array(np.concatenate(found))], names=[key, "body", "seed"])

    return df.select(key, F.xxhash64("text").alias("body"), "text").mapInArrow(run, f"{key} {kind}, body long, seed long")


def _by_join(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    left = _seeds_of(docs, "doc_id", least)
    right = saved(_seeds_of(items, "item_id", least).withColumnRenamed("body", "passage"), "benchmark-seeds")
    pairs = saved(left.join(right, "seed").select("doc_id", "body", "item_id", "passage").distinct(), "seed-pairs")
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("b"), "text").dropDuplicates(["d", "b"])
    passages = items.select(F.col("item_id").alias("i"), F.xxhash64("text").alias("p"), F.col("text").alias("item"))
    both = pairs.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b"))).join(passages, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("passage") == F.col("p")))

    def run(batches):
        hashes = WordHashes()
        for part in slices(batches):
            found = [_result(hashes.of(t), hashes.of(p), least) for t, p in zip(part.column("text").to_pylist(), part.column("item").to_pylist(), strict=True)]
            part, found = part.filter(pa.array([x is not None for x in found], pa.bool_())), [x for x in found if x]
            columns = [pa.array([x[k] for x in found], t) for k, (_, t) in enumerate(NUMBERS)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), part.column("item_id"), *columns], names=["doc_id", "body", "item_id", *[n for n, _ in NUMBERS]])

    found = both.select("doc_id", "body", "item_id", "text", "item").mapInArrow(run, _schema(docs, items))
    # a row for each of equal documents again
    rows = docs.groupBy(F.col("doc_id").alias("d"), F.xxhash64("text").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    again = rows.where("n > 1").select("d", "b", F.explode(F.sequence(F.lit(2), F.col("n"))).alias("copy"))
    more = found.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b"))).select(*found.columns)
    return found.unionByName(more)


def _text_overlaps(docs: DataFrame, benchmark: DataFrame, least: int, max_broadcast_words: int) -> DataFrame:
    """overlaps() with body, a hash of the document's text."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("words"), F.sum(F.octet_length("text")).alias("bytes")).first()
    small = max(size["words"] or 0, (size["bytes"] or 0) // 8) <= max_broadcast_words
    return (_by_broadcast if small else _by_join)(docs, items, least)


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 5, max_broadcast_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, n_item_words, n_matched_words, n_tiles, coverage) for each document and item with a tile."""
    return _text_overlaps(docs, benchmark, least, max_broadcast_words).drop("body")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, max_broadcast_words: int = 2_000_000) -> DataFrame:
    """The rows of overlaps() whose coverage reaches the threshold."""
    return overlaps(docs, benchmark, least, max_broadcast_words).where(F.col("coverage") >= coverage)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, max_broadcast_words: int = 2_000_000) -> DataFrame:
    """docs without the documents that hold a benchmark item; rows are told apart by doc_id and text, so clean rows without an id stay."""
    hit = _text_overlaps(docs, benchmark, least, max_broadcast_words).where(F.col("coverage") >= coverage)
    found = saved(hit.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body")).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_body"]), "left_anti")
