"""Byte-level BPE with word ends: encoding through a pair occurrence index, and decoding.

A task gathers the distinct words of the texts it holds that it has not met yet and encodes them together. One index maps
each mergeable pair to all its positions in those words. Active ranks are applied in ascending order: the positions of
the lowest rank are merged, and only the lists of the pairs that appear or vanish around them are updated. Words are
independent, so every word sees its own merges in exactly the order of the tokenizer.

The tokenizer file (its path is a parameter) is read by the driver and broadcast: its size is that of the vocabulary.
Texts are never shuffled; each row's work is proportional to its length. The memory of a task is a slice of texts, the
index of the new words in it, and a word cache of at most CACHE words.

Defined results: null and empty texts have no tokens; a text may be of any length; equal rows give equal results; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lumaframe.llm.common import slices

CACHE = 240_000
# Letters and numbers that Unicode assigned after version 16, which the tokenizer takes for symbols.
LATER_LETTERS = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
# Letters that got a lower case after Unicode 15.1, which Python 3.13 knows: first-last, then the first one's.
LATER_CASES = """
1C89-1C89:1C8A A7CB-A7CB:0264 A7CC-A7CC:A7CD A7CE-A7CE:A7CF A7D2-A7D2:A7D3 A7D4-A7D4:A7D5 A7DA-A7DA:A7DB A7DC-A7DC:019B
10D50-10D65:10D70 16EA0-16EB8:16EBB
"""
#: Bytes of text whose new words share an index.
INDEX_BYTES = 4 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """What encoding and decoding need of a tokenizer file; small enough to broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, self.end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters])
        self.last = np.array([ids[c + self.end] for c in letters])
        self.tokens = [""] * (1 + max(*ids.values(), *(t["id"] for t in spec["added_tokens"])))
        for token, k in ids.items():
            self.tokens[k] = token
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, k in self.added.items():
            self.tokens[k] = token
        merges = {ids[a] << 32 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in reversed([*enumerate(model["merges"])])}
        self.pairs = {rank: (pair >> 32, pair & 0xFFFFFFFF, new) for pair, (rank, new) in merges.items()}
        self.keys = np.array([*sorted(merges), 1 << 62])  # the last is found where a pair is beyond all others
        self.ranks = np.array([merges[k][0] for k in self.keys[:-1].tolist()])
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.numbers = [str(k) for k in range(len(self.tokens))]


def later_cases() -> dict[int, int]:
    ranges = [[int(x, 16) for x in re.split("[-:]", r)] for r in LATER_CASES.split()]
    return {c: to + c - first for first, last, to in ranges for c in range(first, last + 1)}


LOWER = later_cases()
WITHOUT_CASE = regex.compile(f"[{''.join(map(chr, LOWER))}]").search


def lower(text: str) -> str:
    """Lower case letter by letter: unlike str.lower, a sigma at a word's end is no special case."""
    if WITHOUT_CASE(text):
        text = text.translate(LOWER)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class Splitter:
    """Normalises a text and cuts it at white space, and what stands between into words.

    No word crosses white space, so texts are cut there first; an added token found in the raw text stands alone.
    """

    def __init__(self, vocab: Vocabulary):
        self.words = regex.compile(vocab.pattern).findall
        later = "".join(f"\\U{int(a, 16):08x}-\\U{int(b or a, 16):08x}" for a, _, b in (r.partition("-") for r in LATER_LETTERS.split()))
        older = vocab.pattern.replace("[^\\s\\p{L}\\p{N}]", "(?:[^\\s\\p{L}\\p{N}]|@)").replace("[\\p{L}]", "[\\p{L}--@]").replace("[\\p{N}]", "[\\p{N}--@]")
        self.older_words = regex.compile(older.replace("@", f"[{later}]"), regex.V1).findall
        self.later = regex.compile(f"[{later}]").search
        self.spaces = regex.compile(r"\s+").split
        self.added = vocab.added
        names = sorted(vocab.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.odd = regex.compile("[\x1c-\x1f]").search

    def inside(self, run: str) -> list[str]:
        """The words of what stands between white space."""
        if run.isalpha() and run.isascii() or run in self.added:
            return [run]
        return self.words(run) if not self.later(run) else self.older_words(run)

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        else:
            text = lower(unicodedata.normalize("NFC", text))
        if self.odd(text):  # str.split() cuts there too
            return [x for x in self.spaces(text) if x]
        return text.split()

    def __call__(self, text: str) -> list[str]:
        if self.split is None or not any(name in text for name in self.added):
            return self.plain(text)
        return [w for part in self.split(text) if part for w in ([part] if part in self.added else self.plain(part))]


def encode_words(words: list[str], vocab: Vocabulary) -> list[tuple[int, ...]]:
    """The ids of each word (none is empty), by one pair occurrence index over all of them."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    if not data:
        return []
    ends = np.cumsum([len(d) for d in data])
    raw = np.frombuffer(b"".join(data), np.uint8)
    symbol = vocab.inner[raw]
    symbol[ends - 1] = vocab.last[raw[ends - 1]]
    n = len(symbol)
    after = np.arange(1, n + 1)  # the next position of the same word, -1 at its end
    before = np.arange(-1, n - 1)
    after[ends - 1] = -1
    before[ends[:-1]] = -1
    occurs: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def index(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> None:
        """Lists the positions at under the ranks of the pairs there."""
        key = left << 32 | right
        place = vocab.keys.searchsorted(key)
        known = vocab.keys[place] == key
        at, rank = at[known], vocab.ranks[place[known]]
        if not len(at):
            return
        order = rank.argsort(kind="stable")
        at, rank = at[order], rank[order]
        cuts = [0, *((rank[1:] != rank[:-1]).nonzero()[0] + 1).tolist(), len(at)]
        for r, i, j in zip(rank[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
            if (there := occurs.get(r)) is None:
                occurs[r] = [at[i:j]]
                heapq.heappush(ranks, r)
            else:
                there.append(at[i:j])

    inner = (after >= 0).nonzero()[0]
    index(symbol[inner], symbol[inner + 1], inner)
    while ranks:
        rank = heapq.heappop(ranks)
        lists = occurs.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b, new = vocab.pairs[rank]
        nxt = after[at]
        valid = (nxt >= 0) & (symbol[at] == a) & (symbol[nxt] == b)
        at, nxt = at[valid], nxt[valid]
        if a == b and len(at) > 1:  # of overlapping pairs the first, the third and so on
            taken, last = [], -1
            for i, j in zip(at.tolist(), nxt.tolist(), strict=True):
                taken.append(i != last)
                last = j if i != last else -1
            at, nxt = at[taken], nxt[taken]
        if not len(at):
            continue
        symbol[at] = new
        symbol[nxt] = -1
        behind = after[nxt]
        after[at] = behind
        after[nxt] = -1
        right = behind >= 0
        behind, first = behind[right], at[right]
        before[behind] = first
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        index(np.concatenate((symbol[first], symbol[ahead])), np.concatenate((symbol[behind], symbol[after[ahead]])), np.concatenate((first, ahead)))
    left = symbol >= 0
    cuts = np.cumsum(left)[ends - 1].tolist()
    kept = symbol[left].tolist()
    return [tuple(kept[i:j]) for i, j in zip([0, *cuts], cuts, strict=False)]


class Encoder:
    """Encodes lists of texts; remembers words, and of what stands between white space the ids (or their digits) and what they decode to."""

    def __init__(self, vocab: Vocabulary, cache: int = CACHE, digits: bool = False):
        self.vocab, self.limit, self.split, self.digits = vocab, cache, Splitter(vocab), digits
        self.known: dict[str, tuple[int, ...]] = {}
        self.runs: dict[str, tuple[tuple[int, ...] | str, int, str]] = {}

    def found(self, texts: list[str | None]) -> list[list[tuple[tuple[int, ...] | str, int, str]]]:
        """For each text its runs: (ids, or their digits with spaces between; their number; their tokens with spaces between)."""
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.known) > self.limit:
            self.known = {}
        if len(self.runs) > self.limit:
            self.runs = {}
        known, runs = self.known, self.runs
        new_runs = set().union(*cut).difference(runs)
        words = {run: self.split.inside(run) for run in new_runs}
        new = set(chain.from_iterable(words.values())).difference(known)
        for name in new & self.vocab.added.keys():
            known[name] = (self.vocab.added[name],)
            new.discard(name)
        fresh = list(new)
        known.update(zip(fresh, encode_words(fresh, self.vocab), strict=True))
        find, number = known.__getitem__, self.vocab.numbers.__getitem__
        for run, parts in words.items():
            ids = find(parts[0]) if len(parts) == 1 else tuple(chain.from_iterable(map(find, parts)))
            runs[run] = (" ".join(map(number, ids)) if self.digits else ids, len(ids), decode(ids, self.vocab))
        return [[*map(runs.__getitem__, x)] for x in cut]

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        return [list(chain.from_iterable(r[0] for r in x)) for x in self.found(texts)]


def decode(ids, vocab: Vocabulary) -> str:
    """The tokenizer file names no decoder, so its tokens are joined by one space."""
    return " ".join(map(vocab.tokens.__getitem__, ids))


def encoded(docs: DataFrame, path: str, digests: bool = False, cache: int = CACHE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row, or with digests SHA-256 of the two in place of them.

    Smaller caches and indexes take less memory and more time.
    """
    typed = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches):
        vocab = shared.value
        encode = Encoder(vocab, cache, digits=digests)
        for part in slices(batches, limit=index_bytes):
            n, first, second = [], [], []
            for runs in encode.found(part.column("text").to_pylist()):
                ids, many, tokens = zip(*runs, strict=True) if runs else ((),) * 3
                n.append(sum(many))
                first.append(sha256(" ".join(ids).encode()).hexdigest() if digests else [*chain.from_iterable(ids)])
                second.append(sha256(" ".join(tokens).encode()).hexdigest() if digests else " ".join(tokens))
            n, first, second = pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, first, second], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {typed}, n_tokens long, {kinds}")
