"""Removal of long repeated byte strings by sorted suffixes.

Every byte goes that is covered by a string of `length` bytes that also starts elsewhere, in the same text or another.

Suffixes. Sorting one suffix per byte would move hundreds of times the input. Each string of `length` bytes has one anchor
instead: the place in it where the hash of GRAM bytes is least (the leftmost of equal ones). That depends on the string
alone, so equal strings have their anchors at the same place, and only suffixes that start at anchors need sorting (about
one in 170 bytes). An anchor owns a run of string starts; what these strings cover is its stretch of text.

1. A pass over the texts writes one row of hashes per anchor. Anchors whose leading bytes (the gram) occur once are done.
   Equal stretches are counted before anything else moves, so a group of copies is one suffix with a number.
2. One copy of each stretch is cut out of its text. Suffixes are range-partitioned by their leading bytes with sampled
   splitters, and every bucket is sorted by multikey quicksort on eight-byte digits (from the anchor on, then the text
   before it, backwards).
3. Repeats come from the bytes that sorted neighbours have in common: forward from the anchor and backward from it. A suffix
   that stands for several repeats whole, as its equal neighbours. Where three or more suffixes have a gram, a string
   may equal one that is no neighbour; only those that share enough with a neighbour to allow it are looked up by hash and
   then compared byte by byte.
4. A string may repeat across a bucket's boundary only if it shares, from its anchor on, what splitters look at with the
   bucket's first or last suffix (or less, if the string ends before): such strings are compared with those of other buckets
   by hash, packed into one row per bucket and part of the hashes.
5. The runs of repeated strings go back to all copies of their stretch, and their bytes are taken out of the texts. Stretches
   with more than HOT copies meet those by broadcast (if they are few enough), so no task gets all rows of one.

A passage in many different contexts spreads over buckets, as beyond the leading bytes the splitters look at a hash of the
stretch. A bucket is a few megabytes.

Defined results: a null text is empty; texts under `length` bytes stay whole; strings are judged on the input, so all copies
go, the first too; equal rows are copies of each other; an empty table gives an empty result; texts may be of any length;
columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.common import as_bytes, bounded, forget, once, saved, slices

GRAM = 48
#: String starts that are looked at together; longer texts are cut (their strings still overlap the cuts).
SEGMENT = 1 << 21
PLACE_BITS = 28
BASE = 0x9E3779B97F4A7C15 | 1
#: Leading bytes of a suffix that splitters look at. Beyond them a hash of the stretch splits, so no group is too large for buckets.
LEAD = 64
#: Copies of a stretch from which on its rows are kept out of shuffles by it.
HOT = 256
#: Bytes of suffixes in a bucket.
BUCKET_BYTES = 4 << 20


@cache
def _powers(n: int, inverse: bool) -> np.ndarray:
    step = np.uint64(pow(BASE, -1, 1 << 64) if inverse else BASE)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, step, np.uint64)])


def powers(n: int, inverse: bool = False) -> np.ndarray:
    return _powers(1 << max(12, (n - 1).bit_length()), inverse)[:n]


class PrefixHash:
    """Polynomial hashes, modulo 2**64, of any stretches of some bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=self.sums[1:])
        self.inverse = powers(n + 1, True)

    def of(self, start, stop) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of size values: running minima from both ends of blocks of that size."""
    n = len(values)
    blocks = np.full(-(-n // size) * size, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - size + 1], ahead[size - 1 : n])


def anchors(text: bytes, length: int) -> list[tuple[np.ndarray, ...]]:
    """For each segment of the text: (place of the anchor, first and last string start that it owns, gram hash, stretch hash)."""
    out = []
    mask = np.uint64((1 << PLACE_BITS) - 1)
    gram = min(GRAM, length)
    for begin in range(0, len(text) - length + 1, SEGMENT):
        data = np.frombuffer(text[begin : begin + SEGMENT + length - 1], np.uint8)
        hashes = PrefixHash(data)
        grams = hashes.windows(gram)
        packed = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_least(packed, length - gram + 1) & mask).astype(np.int64)
        first = np.r_[0, (np.diff(anchor) != 0).nonzero()[0] + 1]
        last = np.r_[first[1:] - 1, len(anchor) - 1]
        at = anchor[first]
        stretch = hashes.of(first, last + length) + (at - first).astype(np.uint64) * np.uint64(BASE) + (last - first).astype(np.uint64)
        out.append((at + begin, first + begin, last + begin, grams[at], mix(stretch)))
    return out


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, body, gram, stretch, at, first, last) for each anchor; body is a hash of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            found = [(row, *f) for row, t in enumerate(as_bytes(part)) for f in anchors(t, length)]
            row = pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64))
            at, first, last, gram, stretch = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(1, 6))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(row), part.column("body").take(row), pa.array(gram.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(at), pa.array(first), pa.array(last)],
                names=["doc_id", "body", "gram", "stretch", "at", "first", "last"],
            )

    source = docs.select("doc_id", F.xxhash64("text").alias("body"), "text")
    return source.mapInArrow(run, f"doc_id {kind}, body long, gram long, stretch long, at long, first long, last long")


def multikey_quicksort(digits: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """The order of the rows of digits, compared digit by digit: three-way partitions, equal ones go on to the next digit."""
    out, work = [], [(np.arange(len(digits)) if rows is None else rows, 0)]
    while work:
        own, depth = work.pop()
        if len(own) < 2 or depth == digits.shape[1]:
            out.append(own)
            continue
        d = digits[own, depth]
        pivot = np.partition(d, len(d) // 2)[len(d) // 2]
        work += [(part, deeper) for part, deeper in ((own[d > pivot], depth), (own[d == pivot], depth + 1), (own[d < pivot], depth)) if len(part)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def sort_keys(stretches: list[bytes], before: list[int]) -> np.ndarray:
    """A row of bytes for each stretch: the suffix from its anchor on, filled up with zeros, then the text before it, backwards."""
    wide, deep = max(len(s) - b for s, b in zip(stretches, before, strict=True)), max(before)
    width = -(-(wide + deep) // 8) * 8
    joined = b"".join((s[b:].ljust(wide, b"\0") + s[:b][::-1]).ljust(width, b"\0") for s, b in zip(stretches, before, strict=True))
    return np.frombuffer(joined, np.uint8).reshape(len(stretches), width)


def shared_lead(keys: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many bytes each row of keys shares from the start with the row of other (or with the one row other)."""
    if not keys.shape[1]:
        return np.zeros(len(keys), np.int64)
    different = keys != other
    return np.where(different.any(axis=1), different.argmax(axis=1), keys.shape[1])


def neighbours(keys: np.ndarray, order: np.ndarray, ahead: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that each suffix in order shares with the next: from the anchor on and before it.

    keys are those of sort_keys(), ahead and before the true lengths of the two parts of each row.
    """
    wide = int(ahead.max())
    forth, back = np.zeros(max(len(order) - 1, 0), np.int64), np.zeros(max(len(order) - 1, 0), np.int64)
    for k in range(0, len(forth), 4096):
        a, b = order[k : k + 4097][:-1], order[k : k + 4097][1:]
        forth[k : k + len(a)] = np.minimum(shared_lead(keys[a, :wide], keys[b, :wide]), np.minimum(ahead[a], ahead[b]))
        back[k : k + len(a)] = np.minimum(shared_lead(keys[a, wide:], keys[b, wide:]), np.minimum(before[a], before[b]))
    return forth, back


def equal_strings(data: np.ndarray, start: np.ndarray, order: np.ndarray, same: np.ndarray, length: int) -> np.ndarray:
    """same, where the strings of neighbours in order have equal bytes as well as equal hashes."""
    at = same.nonzero()[0]
    for k in range(0, len(at), 2048):
        i = at[k : k + 2048]
        x, y = (data[start[order[j]][:, None] + np.arange(length)] for j in (i, i + 1))
        same[i] = (x == y).all(axis=1)
    return same


def compare_bucket(stretches: list[bytes], before: np.ndarray, owned: np.ndarray, several: np.ndarray, length: int):
    """Which strings of a bucket's stretches repeat in it.

    before: bytes of each stretch that precede its anchor; owned: string starts in each; several: it stands for several copies.
    Returns the strings' (row, number in the row, repeats here) and of those that may repeat across the bucket's boundary
    (place among the strings, hash); of equal ones one asks.
    """
    gram = min(GRAM, length)
    ahead = np.fromiter(map(len, stretches), np.int64, len(stretches)) - before
    keys = sort_keys(stretches, before.tolist())
    order = multikey_quicksort(keys.view(">u8"))
    forth, back = neighbours(keys, order, ahead, before)
    group = np.zeros(len(order), np.int64)
    group[order] = np.r_[0, np.cumsum(forth < gram)]
    # strings of each row by their distance from the anchor: a neighbour has those between length - forth and back
    row = np.repeat(np.arange(len(stretches), dtype=np.int32), owned)
    number = np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(owned) - owned).astype(np.int32), owned)
    off = before.astype(np.int32)[row] - number
    repeats, most = several[row], np.zeros(len(stretches), np.int64)
    for rows in (order[:-1], order[1:]):
        low, high = np.full(len(stretches), length + 1, np.int32), np.full(len(stretches), -1, np.int32)
        low[rows], high[rows] = length - forth, back
        repeats |= (off >= low[row]) & (off <= high[row])
        most[rows] = np.maximum(most[rows], forth)
    reach = np.zeros(len(order), np.int64)
    for outer, edge in ((0, order[0]), (int(group.max()), order[-1])):
        own = (group == outer).nonzero()[0]
        reach[own] = np.maximum(reach[own], shared_lead(keys[own], keys[edge]))
    # beyond neighbours: strings that may equal another of a group of three or more, in groups where one is still open
    may = (most[row] >= length - off) & (np.bincount(group)[group] > 2)[row]
    may &= (np.bincount(group[row], may & ~repeats, int(group.max()) + 1) > 0)[group][row]
    asks = reach[row] >= np.minimum(length - off, LEAD)
    some = (may | asks).nonzero()[0]
    if not len(some):
        return row, number, repeats, some, np.zeros(0, np.uint64)
    held, place = np.unique(row[some], return_inverse=True)
    parts = [stretches[k] for k in held.tolist()]
    data = np.frombuffer(b"".join(parts), np.uint8)
    start = np.cumsum([0, *map(len, parts)])[place] + number[some]
    value = PrefixHash(data).of(start, start + length)
    own = group[row[some]]
    sort = np.lexsort((own, value))
    same = equal_strings(data, start, sort, (value[sort][1:] == value[sort][:-1]) & (own[sort][1:] == own[sort][:-1]), length)
    met, leads = np.zeros(len(some), bool), np.ones(len(some), bool)
    met[sort] = np.r_[False, same] | np.r_[same, False]
    leads[sort] = ~np.r_[False, same]
    repeats[some] |= met
    ask = leads & asks[some]
    return row, number, repeats, some[ask], value[ask]


def runs_of(row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins strings that follow each other in a row (in order of row and number): (first place in the arrays, first, last number)."""
    if not len(row):
        return (np.zeros(0, np.int64),) * 3
    new = np.r_[True, (np.diff(row) != 0) | (np.diff(number) != 1)].nonzero()[0]
    last = np.r_[new[1:] - 1, len(row) - 1]
    return new, number[new], number[last]


LISTS = ["kinds", "grams", "numbers", "values", "open"]


def compared(cut: DataFrame, length: int, parts: int) -> DataFrame:
    """Sorts the suffixes of cut (gram, kind, before, owned, n, stretch) in buckets.

    Returns rows (gram, kind, low, high), numbers of the strings of a stretch that repeat, with part null, and for each part of the
    hashes of strings to compare across boundaries one row of arrays LISTS; open is false where the string is known to go.
    """
    names = ["gram", "kind", "low", "high", "part", *LISTS]

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        gram, kind, before, owned, n = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "kind", "before", "owned", "n"))
        row, number, repeats, ask, value = compare_bucket(whole.column("stretch").to_pylist(), before, owned, n > 1, length)
        done = repeats.nonzero()[0]
        at, low, high = runs_of(row[done], number[done])
        taken = row[done][at]
        empty = [pa.nulls(len(at), t) for t in (pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (gram[taken], kind[taken], low, high)), *empty], names=names)
        part = (value % np.uint64(parts)).astype(np.int64)
        order = part.argsort(kind="stable")
        ask, value = ask[order], value[order]
        some, sizes = np.unique(part, return_counts=True)
        cuts = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (kind[row[ask]], gram[row[ask]], number[ask].astype(np.int64), value.view(np.int64), ~repeats[ask])]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), pa.int64())] * 4, pa.array(some), *lists], names=names)

    lists = "kinds array<long>, grams array<long>, numbers array<long>, values array<long>, open array<boolean>"
    return cut.select("gram", "kind", "before", "owned", "n", "stretch").mapInArrow(run, f"gram long, kind long, low long, high long, part long, {lists}")


def across(found: DataFrame, parts: int) -> DataFrame:
    """(gram, kind, low, high): the open strings among the arrays of compared() that another bucket holds too."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        kind, gram, number, value, open_ = (whole.column(c).flatten().to_numpy(zero_copy_only=False) for c in LISTS)
        sort = np.lexsort((gram, value))
        same = (value[sort][1:] == value[sort][:-1]) & (gram[sort][1:] == gram[sort][:-1])
        met = np.zeros(len(value), bool)
        met[sort] = np.r_[False, same] | np.r_[same, False]
        rows = (met & open_).nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (gram, kind, number, number)], names=["gram", "kind", "low", "high"])

    asked = found.where("part is not null").select("part", *LISTS).repartition(parts, "part").select(*LISTS)
    return asked.mapInArrow(run, "gram long, kind long, low long, high long")


def cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (doc_id, body, gram, kind, at, first, last, n) as suffixes: (gram, kind, before, owned, n, stretch)."""
    lists = wanted.groupBy("doc_id", "body").agg(F.collect_list(F.struct("gram", "kind", "at", "first", "last", "n")).alias("anchors"))
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("b"), "text")
    texts = once(texts, ["d", "b"], texts.select("d", "b"))
    both = texts.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")))

    def run(batches):
        for part in slices(batches):
            lists, texts = part.column("anchors"), as_bytes(part)
            flat = lists.flatten()
            gram, kind, at, first, last, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(6))
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            stretch = [texts[r][a : b + length] for r, a, b in zip(row.tolist(), first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (gram, kind, at - first, last - first + 1, n)), pa.array(stretch, pa.binary())], names=["gram", "kind", "before", "owned", "n", "stretch"])

    return both.select("text", "anchors").mapInArrow(run, "gram long, kind long, before long, owned long, n long, stretch binary")


def repeated_runs(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, body, start, stop): stretches of bytes that strings of `length` bytes with a copy elsewhere cover; they may overlap."""
    every = saved(anchor_rows(docs, length), "anchors")
    twice = saved(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "repeated-grams")
    some = saved(every.join(bounded(twice), "gram", "left_semi").withColumnRenamed("stretch", "kind"), "repeated-anchors")
    forget(every, twice)
    kinds = saved(some.groupBy("gram", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "body", "at", "first", "last")).alias("one")), "stretches")
    cut = saved(cut_out(docs, kinds.select("gram", "kind", "n", "one.*"), length), "suffixes")
    size = cut.agg(F.sum(F.octet_length("stretch"))).first()[0] or 0
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    lead = F.expr(f"substring(stretch, cast(before as int) + 1, {LEAD})")
    found = saved(compared(cut.repartitionByRange(buckets, lead, F.xxhash64("stretch")), length, buckets), "compared")
    forget(cut)
    runs = saved(found.where("part is null").select("gram", "kind", "low", "high").unionByName(across(found, buckets)), "runs")
    forget(found)
    keys = ["gram", "kind"]
    hot = bounded(saved(kinds.where(F.col("n") > HOT).select(*keys), "hot-stretches"))
    own = some.join(hot, keys, "left_anti").join(runs, keys).unionByName(some.join(hot, keys, "left_semi").join(bounded(saved(runs.join(hot, keys, "left_semi"), "hot-runs")), keys))
    return own.select("doc_id", "body", (F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + length).alias("stop"))


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of overlapping or touching stretches."""
    order = starts.argsort(kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], reach[np.r_[new[1:], True]]


def without_repeats(docs: DataFrame, length: int = 400, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is the rest as bytes, or with digest its SHA-256 as kept_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = repeated_runs(docs, length)
    lists = runs.groupBy("doc_id", "body").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    lists = lists.select(F.col("doc_id").alias("d"), F.col("body").alias("b"), "starts", "stops")
    texts = docs.select("doc_id", F.xxhash64("text").alias("body"), "text")
    both = texts.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")), "left").select("doc_id", "text", "starts", "stops")

    def run(batches):
        for part in slices(batches):
            out = []
            for text, a, b in zip(as_bytes(part), part.column("starts").to_pylist(), part.column("stops").to_pylist(), strict=True):
                starts, stops = merged(np.array(a), np.array(b)) if a else (np.zeros(0, np.int64),) * 2
                kept = b"".join(text[i:j] for i, j in zip([0, *stops.tolist()], [*starts.tolist(), len(text)], strict=True))
                out.append((len(text), int((stops - starts).sum()), len(starts), sha256(kept).hexdigest() if digest else kept))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", last])

    last = "kept_sha256" if digest else "kept"
    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {last} {'string' if digest else 'binary'}")
