"""Runs of periodic words: stretches that repeat a block of q words at least twice, and texts with one block of each left.

A run has smallest period q (words q apart are identical), at least max(min_length, 2 q) words, and no neighbouring word
that carries the period on. The words of a batch of texts are numbered and looked at side by side:

* Recursive frequency splitting. Every word of a run comes twice in it or more. So a word that is alone in its segment
  (at first a whole text) belongs to no run and splits the segment; parts under min_length words go, and the rest is
  counted anew until no segment changes. What goes on for more than ROUNDS rounds is finished by a worklist that recounts
  only the smaller side of each split.
* Lag scan of the segments that survive. Lags under 8 are compared word by word. For lags from 2^j on up to 2^(j+1) a run
  has matching stretches of 2^j words, so each holds a block of g = 2^(j-1) words that starts at a multiple of g; hashes of
  those blocks are compared with the blocks at every such lag, which is two comparisons a word for each j. What matches is
  extended word by word; each run is then compared word by word over its whole length, so that hashes decide nothing. A
  lag inside a run whose period divides it cannot be a smallest period and goes before it is extended.

Texts are not shuffled; a task holds a slice of texts. A text is never cut: one of n words takes some hundred bytes a word.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text; a text of any length is one
piece of work; equal rows give equal results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.common import as_bytes, slices

#: Lags below this are compared word by word.
SMALL = 8
#: Rounds of splitting over all segments before the worklist takes over.
ROUNDS = 32
#: Comparisons made at once.
BLOCK = 1 << 21


def worklist(words: np.ndarray, least: int) -> np.ndarray:
    """True at the words of one segment that survive splitting; each split counts only its smaller side anew."""
    alive = np.zeros(len(words), bool)
    w = words.tolist()
    counts: dict = {}
    for x in w:
        counts[x] = counts.get(x, 0) + 1
    places: dict = {}
    for k, x in enumerate(w):
        places.setdefault(x, []).append(k)
    todo = [(0, len(w), counts, [places[x][0] for x, n in counts.items() if n == 1])]
    while todo:
        start, end, counts, alone = todo.pop()
        alone = [k for k in alone if start <= k < end]
        if end - start < least:
            continue
        if not alone:
            alive[start:end] = True
            continue
        at = alone.pop()
        left, right = (start, at), (at + 1, end)
        small, large = (left, right) if at - start <= end - at - 1 else (right, left)
        fresh: dict = {}
        for x in w[small[0] : small[1]]:
            fresh[x] = fresh.get(x, 0) + 1
        rest = alone
        counts.pop(w[at], None)
        for x, n in fresh.items():
            counts[x] -= n
            if counts[x] == 1:  # its last place on the large side: found among its places by position
                own = places[x]
                low = int(np.searchsorted(own, large[0]))
                rest.append(own[low])
            elif not counts[x]:
                del counts[x]
        todo.append((*small, fresh, [places[x][int(np.searchsorted(places[x], small[0]))] for x, n in fresh.items() if n == 1]))
        todo.append((*large, counts, rest))
    return alive


def survivors(text: np.ndarray, word: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes) of the words that frequency splitting leaves; equal codes: the same word in the same segment."""
    at, segment, done = np.arange(len(word)), text, []
    for turn in range(ROUNDS + 1):
        if not len(at):
            break
        code = pd.factorize(segment * (int(word.max()) + 1) + word[at])[0]
        keep = np.bincount(code)[code] > 1
        heads = np.r_[True, segment[1:] != segment[:-1]].nonzero()[0]
        whole = np.minimum.reduceat(keep, heads).repeat(np.diff(np.r_[heads, len(at)]))
        if turn == ROUNDS:
            for a, b in zip(heads, np.r_[heads[1:], len(at)], strict=True):
                if not whole[a]:
                    keep[a:b] = worklist(code[a:b], least)
            whole[:] = True
        at, segment, keep, whole = at[keep], segment[keep], None, whole[keep]
        if not len(at):
            break
        cut = np.r_[True, (segment[1:] != segment[:-1]) | (at[1:] != at[:-1] + 1)]
        size = np.diff(np.r_[cut.nonzero()[0], len(at)])
        fits, segment = (size >= least).repeat(size), cut.cumsum()
        done.append(at[fits & whole])
        at, segment = at[fits & ~whole], segment[fits & ~whole]
    at = np.sort(np.concatenate(done)) if done else at[:0]
    if not len(at):
        return at, at
    cut = np.r_[True, (at[1:] != at[:-1] + 1) | (text[at][1:] != text[at][:-1])].cumsum()
    return at, pd.factorize(cut * (int(word.max()) + 1) + word[at])[0]


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.r_[False, same, False].astype(np.int8))
    return (edge == 1).nonzero()[0], (edge == -1).nonzero()[0]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def lag_runs(code: np.ndarray, q: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, q) of all stretches with period q, compared word by word."""
    s, e = stretches(code[:-q] == code[q:]) if q < len(code) else (np.zeros(0, int),) * 2
    fits = e - s >= max(least - q, q)
    return [(a, b + q, q) for a, b in zip(s[fits].tolist(), e[fits].tolist(), strict=True)]


def primitive(code: np.ndarray, start: int, q: int) -> bool:
    """No shorter period: those of a stretch of 2 q words divide q."""
    return not any(q % d == 0 and np.array_equal(code[start : start + q], code[start + d : start + d + q]) for d in range(1, q // 2 + 1))


def matches(h: np.ndarray, low: int, g: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, q): i a multiple of g, low <= q < 2 low, and blocks of g words at i and i + q with equal hashes."""
    grid = np.arange(0, max(0, len(h) - low), g)
    view = sliding_window_view(np.r_[h, np.zeros(low, h.dtype)], low)
    rows, places, lags = max(1, BLOCK // low), [], []
    for k in range(0, len(grid), rows):
        own = grid[k : k + rows]
        a, b = (view[own + low] == h[own][:, None]).nonzero()
        fits = own[a] + b + low < len(h)
        places.append(own[a][fits])
        lags.append(b[fits] + low)
    return (np.concatenate(places), np.concatenate(lags)) if places else (grid, grid)


def reach(code: np.ndarray, at: np.ndarray, lag: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words from each place on (step 1) or back (step -1), most at the utmost, equal the words a lag later."""
    found, rows, n = np.zeros(len(at), np.int64), max(1, BLOCK // most), len(code)
    for k in range(0, len(at), rows):
        i = at[k : k + rows, None] + step * np.arange(most)
        inside = (i >= 0) & (i + lag[k : k + rows, None] < n)
        i[~inside] = 0
        other = np.where(inside, i + lag[k : k + rows, None], 0)
        same = inside & (code[i] == code[other])
        found[k : k + rows] = np.where(same.all(1), most, same.argmin(1))
    return found


def runs_in(code: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs in codes of segments that lie one behind the other."""
    found = [r for q in range(1, SMALL) for r in lag_runs(code, q, least) if primitive(code, r[0], q)]
    h, place, low = code.astype(np.uint64), np.arange(len(code)), SMALL
    for g in (1, 2):
        h = mixed(h[:-g], h[g:]) if len(h) > g else h[:0]
    while len(h) > low:
        g = low // 2
        i, q = matches(h, low, g)
        long = [r for r in found if r[1] - r[0] >= low] if len(i) else []
        if long:
            order = i.argsort(kind="stable")
            i, q = i[order], q[order]
            out = np.zeros(len(i), bool)
            for s, e, r in long:
                a, b = np.searchsorted(i, (s, e))
                out[a:b] |= (q[a:b] % r == 0) & (i[a:b] + q[a:b] <= e)
            i, q = i[~out], q[~out]
        if len(i):
            order = np.lexsort((i, q))
            i, q = i[order], q[order]
            head = np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1] + g)]
            last = i[np.r_[head[1:], True]]
            i, q = i[head], q[head]
            s = i - reach(code, i - 1, q, -1, g)
            e = last + g + reach(code, last + g, q, 1, g)
            fits = e - s >= np.maximum(q, least - q)
            for a, b, lag in zip(s[fits].tolist(), e[fits].tolist(), q[fits].tolist(), strict=True):
                if np.array_equal(code[a:b], code[a + lag : b + lag]):
                    found.append((a, b + lag, lag))
                else:  # equal hashes of different blocks: this lag is compared word by word
                    found += [r for r in lag_runs(code, lag, least) if primitive(code, r[0], lag)]
        h = mixed(h[:-g], h[g:]) if len(h) > g else h[:0]
        low *= 2
    return sorted({*found})


def runs_of(texts: list[list[bytes]], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """The (start, length, period) of each list of words, by start, then period."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not size.sum():
        return out
    word = pa.array(chain.from_iterable(texts), pa.large_binary(), size=int(size.sum())).dictionary_encode().indices.to_numpy().astype(np.int64)
    at, code = survivors(np.arange(len(texts)).repeat(size), word, least)
    first = size.cumsum() - size
    for s, e, q in runs_in(code, least) if len(at) else []:
        k = int(np.searchsorted(first, at[s], side="right")) - 1
        out[k].append((int(at[s] - first[k]), e - s, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join(compress(words, (depth.cumsum()[:-1] == 0).tolist()))


def periodic_runs(docs: DataFrame, min_length: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: runs as (start, length, period) by start, then period; collapsed is the text without repeats."""
    if min_length < 2 * SMALL - 4:
        raise ValueError(f"min_length is at least {2 * SMALL - 4}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for part in slices(batches):
            texts = [t.split() for t in as_bytes(part)]  # bytes split at [\x20\x09-\x0D]+
            runs = runs_of(texts, min_length)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
            columns = [part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(rows, run_type), pa.array(map(collapsed, texts, runs), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted(text: Column, key: Column) -> Column:
    """The text; of a tenth of the keys, by crc32, its words from some place on become a block repeated three times or more.

    Everything derives from h = crc32(key as text) and g = floor(h / 10): of n words those from a = g % n on repeat with
    period 1 + floor((n - a) / (3 + g % 8)). Texts without a word stay.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words).cast("long")
    a = g % F.nullif(n, F.lit(0))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    times = F.ceil((n - a) / p)
    block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(block, times.cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(text)
