"""Near copies by the similarity of their word shingles: every pair of texts whose Jaccard similarity reaches a threshold.

Candidates come from two indexes, and all are compared exactly: from the byte positions of SimHash fingerprints (see simhash.py), which links
texts that differ in little, and, as a SimHash of 64 bits guarantees no distance at a given similarity, from the shingles themselves. All texts
order their shingle hashes alike; two sets of similarity t share a hash among the first n - ceil(t n) + 1 of either
(prefix filter), so only these are posted. Hashes that look frequent in some of the sets are moved to the end of the order,
which keeps postings short and is right for any choice of them. What meets in postings is filtered by size, place and the
number of hashes shared, and then compared exactly.

A posting longer than MAX_POSTING offers each member one partner first: of the hubs of its long postings (the member that is in
most) the one that it shares most with. What is connected by then needs no more pairs. Where a posting's members are in several
components, they are posted anew by how they differ from what most of them hold, see long_links(). So a huge group of near copies costs
about one pair a member and hub, while no pair that could join two components is left out.

Equal shingle sets are one class from the start. What is written out is a fifth of the hashes (the prefixes); the whole
sets are made again from the few texts that candidates need. Defined results: words are cut as by simhash.fingerprint();
fewer words than a shingle make one shingle of what there is, and null and empty texts the empty one; equal rows get equal
results; an empty table gives an empty result; other columns are not looked at. A hash stands for its shingle (64 bits of
a running hash over the words' XXH64).
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lumaframe.llm.common import as_bytes, bounded, forget, once, saved, slices
from lumaframe.llm.decontaminate import WordHashes, window_hashes
from lumaframe.llm import simhash
from lumaframe.llm.simhash import components

MAX_POSTING = 64
#: How often a long posting is split by what its members differ in.
ROUNDS = 4
#: Members of a group that are looked at for its centre, about.
LOOKED_AT_IN_GROUP = 64
#: Numbers in all centres up to which they are sent to every task (32 MB); beyond, each member gets its centre by a join.
SENT_LONGS = 4 << 20
#: One set in so many is looked at for frequent hashes, which at least so many of those hold.
LOOKED_AT, OFTEN = 16, 8
#: Frequent hashes that are moved to the end of the order (any choice is right, more are faster).
MAX_FREQUENT = 1 << 20
SLACK = 1e-9


def shingles(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    words = text.lower().split()
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    h = window_hashes(ids, min(size, len(ids))) if len(ids) else np.zeros(1, np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h.view(np.int64))


def prefix_length(n: int, similarity: float) -> int:
    return n - ceil(similarity * n - SLACK) + 1


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def shingle_sets(docs: DataFrame, size: int, *keep: str) -> DataFrame:
    """(the columns keep, hashes) of docs, which has them and text."""

    def run(batches):
        hashes = WordHashes()
        for part in slices(batches):
            sets = [shingles(t, size, hashes) for t in as_bytes(part)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists(sets)], names=[*keep, "hashes"])

    source = docs.select(*keep, "text")
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema if f.name != "text")
    return source.mapInArrow(run, f"{kept}hashes array<long>")


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes that at least OFTEN of the texts looked at hold, the most frequent MAX_FREQUENT at most, ascending."""
    body = F.xxhash64("text")
    looked = docs.where(F.pmod(body, F.lit(LOOKED_AT)) == 0).groupBy(body.alias("body")).agg(F.first("text").alias("text"))
    counts = shingle_sets(looked, size).select(F.explode("hashes").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).select("key")
    return np.sort(top.toArrow().column("key").to_numpy())


def prefixes(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(doc_id, body, fp, sig, n, keys): body is a hash of the text, fp its SimHash, sig one of its n hashes, keys their prefix."""
    typed = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, size))

    def run(batches):
        hashes, last = WordHashes(), shared.value
        for part in slices(batches):
            texts = as_bytes(part)
            sets = [shingles(t, size, hashes) for t in texts]
            fps = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
            sigs = np.fromiter((xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            place = last.searchsorted(joined := np.concatenate(sets))
            late = (last[place.clip(max=len(last) - 1)] == joined) if len(last) else np.zeros(len(joined), bool)
            keys, at = [], 0
            for s in sets:
                own = late[at : at + len(s)]
                keys.append(np.concatenate((s[~own], s[own]))[: prefix_length(len(s), similarity)])
                at += len(s)
            columns = [pa.array(fps), pa.array(sigs), pa.array(np.fromiter(map(len, sets), np.int32, len(sets))), lists(keys)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), *columns], names=["doc_id", "body", "fp", "sig", "n", "keys"])

    return docs.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(run, f"doc_id {typed}, body long, fp long, sig long, n int, keys array<long>")


def postings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, sig, n, at) of hashes that at most MAX_POSTING distinct sets have in their prefixes, and of the others; a single one's are left out."""
    classes = rows.groupBy("sig").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    posts = classes.select("sig", "n", F.posexplode("keys").alias("at", "key"))
    sizes = saved(posts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "posting-sizes")
    posts = saved(posts.join(bounded(sizes, 1_000_000), "key"), "postings")
    forget(sizes)
    return posts.where(F.col("size") <= MAX_POSTING).drop("size"), posts.where(F.col("size") > MAX_POSTING).drop("size")


def possible(pairs: DataFrame, similarity: float, ordered: bool = True) -> DataFrame:
    """(a, b, shared, least) for pairs whose sizes and places allow the similarity; shared counts the postings they meet in.

    ordered: the smaller one becomes a; least is how many postings the pair must meet in.
    """
    a, b = F.col("a"), F.col("b")
    sizes = F.least(a["n"], b["n"]) >= similarity * F.greatest(a["n"], b["n"]) - SLACK
    most = F.least(a["at"], b["at"]) + F.least(a["n"] - a["at"], b["n"] - b["at"])
    need = similarity / (1 + similarity) * (a["n"] + b["n"]) - SLACK
    # beyond the prefix that ends first, no more can be shared than what its set has left
    left = F.ceil(similarity * F.greatest(a["n"], b["n"])) - 1
    found = pairs.where(sizes & (most >= need) & (a["sig"] != b["sig"]))
    first, second = (F.least("a.sig", "b.sig"), F.greatest("a.sig", "b.sig")) if ordered else (a["sig"], b["sig"])
    found = found.select(first.alias("a"), second.alias("b"), (need - left).alias("least"))
    return found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("least").alias("least"))


def texts_of(needed: DataFrame, rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(sig, text) of one text for each set in needed (sig, distinct, stored), and the tables to forget afterwards; rows are those of prefixes().

    Texts are smaller than their sets, so texts move, one for each set.
    """
    one = rows.select("sig", F.struct("doc_id", "body").alias("row")).join(bounded(needed), "sig", "left_semi").groupBy("sig").agg(F.min("row").alias("row"))
    one = saved(one.select("sig", F.col("row.doc_id").alias("_id"), F.col("row.body").alias("_body")), "needed-rows")
    keys = bounded(one)

    def among(found: DataFrame, body: Column) -> DataFrame:
        return found.join(keys, found["doc_id"].eqNullSafe(keys["_id"]) & (body == keys["_body"]))

    twins = among(rows.drop("sig"), F.col("body")).select("sig")
    texts = saved(once(among(docs, F.xxhash64(docs["text"])).select("sig", docs["text"]), ["sig"], twins), "needed-texts")
    return texts, (needed, one, texts)


def with_texts(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """The pairs (a, b) of a stored table with the texts x and y of the two, and the tables that this reads; rows are those of prefixes()."""
    needed = saved(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "needed")
    texts, read = texts_of(needed, rows, docs)
    both = pairs.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("sig").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y"), read


def sets_of(batch: pa.RecordBatch, size: int, hashes: WordHashes):
    """Parts of a batch of with_texts(), each with the sets of a and b in its rows."""
    last, own = None, None
    for part in slices(slices([batch], "x"), "y"):
        sets = []
        for sig, x, y in zip(part.column("b").to_pylist(), as_bytes(part, "x"), as_bytes(part, "y"), strict=True):
            if sig != last:  # rows of one b follow each other
                last, own = sig, shingles(y, size, hashes)
            sets.append((shingles(x, size, hashes), own))
        yield part, sets


def is_near(shared: int, n: int, m: int, similarity: float) -> bool:
    return shared >= similarity * (n + m - shared) - SLACK


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of a stored table that reach the similarity; rows are those of prefixes()."""
    both, read = with_texts(pairs, rows, docs)

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part, sets in sets_of(batch, size, hashes):
                near = [is_near(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity) for x, y in sets]
                yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    links = saved(both.mapInArrow(run, "a long, b long"), "links")
    forget(*read)
    return links


def centres(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(hub, centre, often, times) of stored groups (hub, sig): the shingles that over half of about LOOKED_AT_IN_GROUP members hold.

    often: shingles in which several of these differ from the centre, ascending, and how many do. Any centre and any counts are right;
    the better they are, the less the members' differences meet.
    """
    sizes = members.groupBy("hub").agg(F.count(F.lit(1)).alias("all"))
    place = F.pmod(F.xxhash64("hub", "sig"), F.lit(1 << 20))
    looked = members.join(bounded(sizes), "hub").where(place * F.col("all") < LOOKED_AT_IN_GROUP * (1 << 20)).select("hub", "sig").join(texts, "sig")

    def run(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        sets = [shingles(t, size, hashes) for t in as_bytes(table.combine_chunks())]
        each, n = np.unique(np.concatenate(sets), return_counts=True)
        inside = 2 * n > len(sets)
        times = np.where(inside, len(sets) - n, n)
        often = times > 1
        return pa.table({"hub": table.column("hub").slice(0, 1), "centre": lists([each[inside]]), "often": lists([each[often]]), "times": lists([times[often]])})

    return saved(looked.select("hub", "text").groupBy("hub").applyInArrow(run, "hub long, centre array<long>, often array<long>, times array<long>"), "centres")


def differences(members: DataFrame, texts: DataFrame, centre: DataFrame, size: int, similarity: float) -> DataFrame:
    """(hub, sig, n, d, r, own): how the set of each member (hub, sig) differs from its group's centre.

    n is the size of the set, d that of its difference D from the centre, r = d - c n with c = (1 - t) / (1 + t); sets x, y of similarity
    t differ in c (|x| + |y|) shingles at most. As they differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)|,
    two of r(x) + r(y) <= 0 are similar for certain, and others only if D(x) and D(y) share (r(x) + r(y)) / 2 or more.
    own: the start of D, rare ones first (all members order alike), as long as roles() may need.
    """
    c = (1 - similarity) / (1 + similarity)
    both = members.join(texts, "sig").select("hub", "sig", "text")
    longs = centre.agg(F.sum(F.size("centre") + 2 * F.size("often"))).first()[0] or 0
    held = None
    if longs <= SENT_LONGS:
        held = members.sparkSession.sparkContext.broadcast({r["hub"]: [np.array(r[f], np.int64) for f in ("centre", "often", "times")] for r in centre.collect()})
    else:
        both = both.join(centre, "hub", "left")
    nothing = [np.empty(0, np.int64)] * 3

    def middles(part: pa.RecordBatch) -> list[list[np.ndarray]]:
        if held is not None:
            return [held.value.get(h, nothing) for h in part.column("hub").to_pylist()]
        return [[np.asarray(part.column(f)[k].as_py() or [], np.int64) for f in ("centre", "often", "times")] for k in range(part.num_rows)]

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                own, n, d, r = [], [], [], []
                for text, (middle, often, times) in zip(as_bytes(part), middles(part), strict=True):
                    x = shingles(text, size, hashes)
                    differ = np.setxor1d(x, middle, assume_unique=True)
                    at = often.searchsorted(differ).clip(max=max(0, len(often) - 1))
                    known = (often[at] == differ) if len(often) else np.zeros(len(differ), bool)
                    count = np.where(known, times[at] if len(often) else 0, 0)
                    n.append(len(x))
                    d.append(len(differ))
                    r.append(len(differ) - c * len(x))
                    # in either role at least so many are shared, one always
                    shares = max(1, ceil(min(max(r[-1], 0), r[-1] - c * len(x) / similarity) - SLACK * len(x)))
                    own.append(differ[np.lexsort((differ, count))][: max(0, len(differ) - shares + 1)])
                columns = [part.column("hub"), part.column("sig"), pa.array(n, pa.int32()), pa.array(d, pa.int32()), pa.array(r, pa.float64()), lists(own)]
                yield pa.RecordBatch.from_arrays(columns, names=["hub", "sig", "n", "d", "r", "own"])

    return saved(both.mapInArrow(run, "hub long, sig long, n int, d int, r double, own array<long>"), "differences")


def roles(found: DataFrame, least: DataFrame, similarity: float) -> DataFrame:
    """(key, sig, n, component, d, at, r, small, large, bucket): the postings of differences(); least (hub, low) has the smallest r of each group.

    Of a similar pair with r(x) <= r(y) and r(x) + r(y) > 0, D(x) and D(y) share o = (r(x) + r(y)) / 2 or more, so the first
    |D| - o + 1 of either hold a common one. x, the small one, knows o >= r(x); y, the large one, that r(x) is low at
    least, over -r(y), and over r(y) - 2 c |x|, as D(x) must hold o, with |x| <= |y| / t. The first common one is
    at place i of D(x), with |D(x)| - i >= o: so x is looked for in buckets of r(y) up to 2 (|D(x)| - i) - r(x) only.
    """
    c = (1 - similarity) / (1 + similarity)
    share = lambda o: F.greatest(F.lit(1), F.ceil(o - SLACK))
    other = F.greatest(F.col("low"), -F.col("r"), F.col("r") - 2 * c / similarity * F.col("n"))
    rows = found.join(bounded(least), "hub").select("*", F.posexplode("own").alias("at", "hash"))
    rows = rows.withColumn("small", F.col("at") < F.col("d") - share(F.col("r")) + 1).withColumn("large", (F.col("r") > 0) & (F.col("at") < F.col("d") - share((other + F.col("r")) / 2) + 1))
    # by the size of the group's own sets, so that a set has a few buckets
    width = F.greatest(F.lit(1.0), F.col("wide") * c)
    bucket = lambda x: F.floor(x / width)
    last = bucket(2 * (F.col("d") - F.col("at")) - F.col("r") + SLACK)
    first = bucket(F.greatest("r", -F.col("r")) - SLACK)
    side = lambda small, at: F.struct(F.lit(small).alias("small"), at.alias("bucket"))
    places = F.concat(
        F.when(F.col("small") & (last >= first), F.transform(F.sequence(first, F.greatest(first, last)), lambda k: side(True, k))).otherwise(F.array().cast("array<struct<small:boolean,bucket:bigint>>")),
        F.when(F.col("large"), F.array(side(False, bucket(F.col("r"))))).otherwise(F.array().cast("array<struct<small:boolean,bucket:bigint>>")),
    )
    rows = rows.select("hub", "hash", "sig", "n", "component", "d", "at", "r", F.explode(places).alias("p"))
    return rows.select(F.xxhash64("hub", "hash", "p.bucket").alias("key"), "sig", "n", "component", "d", "at", "r", "p.small")


def hashed_pairs(rows: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b) of distinct sets whose SimHashes differ in max_bits at most: each set with the first of its fingerprint, and those with each other."""
    sets = saved(rows.select("fp", "sig").distinct(), "fingerprints")
    first = saved(sets.groupBy("fp").agg(F.min("sig").alias("first")), "first-of-fingerprints")
    same = sets.join(bounded(first), "fp").where("sig <> first").select(F.col("first").alias("a"), F.col("sig").alias("b"))
    links = simhash.near_links(first.select("fp"), max_bits)
    ends = [first.select(F.col("fp").alias(x), F.col("first").alias(f"_{x}")) for x in "ab"]
    near = links.join(ends[0], "a").join(ends[1], "b").where("_a <> _b")
    return same.unionByName(near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))


def near_links(rows: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b) between distinct sets; the links' components are those of all pairs that reach the similarity. rows: prefixes(), stored."""
    member = F.struct("sig", "n", "at")
    short, long = postings(rows)
    meet = short.groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("all")).select("all", F.posexplode("all").alias("i", "a"))
    pairs = meet.select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    more = long.groupBy("sig").agg(F.count(F.lit(1)).alias("more")).withColumnRenamed("sig", "a")  # postings the count has not seen
    counted = possible(pairs, similarity).join(more, "a", "left").where(F.col("shared") + F.coalesce("more", F.lit(0)) >= F.col("least")).select("a", "b")
    # the member of most long postings is likeliest to be near the others: the text that they are copies of, or one close to it
    degree = long.groupBy("sig").agg(F.count(F.lit(1)).alias("degree"))
    hubs = saved(long.join(degree, "sig").groupBy("key").agg(F.max_by(member, F.struct("degree", "sig")).alias("hub")), "hubs")
    starred = long.select("key", member.alias("own")).join(bounded(hubs), "key")
    partner = possible(starred.select(F.col("hub").alias("a"), F.col("own").alias("b")), similarity, ordered=False).groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    starred = partner.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = saved(counted.unionByName(starred).unionByName(hashed_pairs(rows)).distinct(), "candidates")
    links = verified(pairs, rows, docs, size, similarity)
    forget(hubs, pairs)
    return long_links(long.select("key", "sig", "n"), links, rows, docs, size, similarity)


def across(posts: DataFrame, other: DataFrame, offered: str, similarity: float) -> DataFrame:
    """(a, b) of posts and of other that share a key, are offered, are in different components and may be similar by their sizes."""
    a, b = posts.alias("a"), other.alias("b")
    fit = F.least("a.n", "b.n") >= similarity * F.greatest("a.n", "b.n") - SLACK
    meet = a.join(b, F.expr(f"a.key = b.key and a.component <> b.component and {offered}") & fit)
    return saved(meet.select(F.least("a.sig", "b.sig").alias("a"), F.greatest("a.sig", "b.sig").alias("b")).distinct(), "candidates")


def long_links(long: DataFrame, links: DataFrame, rows: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """links and those that long postings (key, sig, n) add to them.

    Each round drops postings whose members are in one component. The members of the others form groups, each around the member
    that is in most postings, and are looked at by how they differ from their group's centre, see differences(): the member closest to it
    is linked to all that are similar to it for certain, and the others are posted by roles(). Postings of few offers are compared;
    what is still long goes into the next round, around centres of its own, and after ROUNDS its members are compared.
    """
    for left in range(ROUNDS, -1, -1):
        known = components(links).select(F.col("node").alias("sig"), "component")
        mine = saved(long.join(known, "sig", "left").select("key", "sig", "n", F.coalesce("component", "sig").alias("component")), "long-members")
        ends = mine.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        split = saved(mine.join(ends.select("key"), "key"), "split-postings")
        if split.isEmpty():
            return links
        if not left:
            pairs = across(split, split, "a.sig < b.sig", similarity)
            return saved(links.unionByName(verified(pairs, rows, docs, size, similarity)), "links")
        degree = split.groupBy("sig").agg(F.count(F.lit(1)).alias("degree"))
        hubs = saved(split.join(degree, "sig").groupBy("key").agg(F.max_by("sig", F.struct("degree", "sig")).alias("hub")), "hubs")
        members = saved(split.join(bounded(hubs), "key").select("hub", "sig").distinct(), "group-members")
        texts, read = texts_of(saved(members.select("sig").distinct(), "needed"), rows, docs)
        centre = centres(members, texts, size)
        found = differences(members, texts, centre, size, similarity)
        forget(hubs, centre, *read)
        c = (1 - similarity) / (1 + similarity)
        least = saved(found.groupBy("hub").agg(F.min(F.struct("r", "sig")).alias("m"), F.max("n").alias("wide")).select("hub", F.col("m.r").alias("low"), F.col("m.sig").alias("closest"), "wide"), "closest")
        certain = found.join(bounded(least), "hub").where((F.col("r") + F.col("low") <= SLACK / 2) & (F.col("sig") != F.col("closest")))
        links = saved(links.unionByName(certain.select(F.col("sig").alias("a"), F.col("closest").alias("b"))), "links")
        known = components(links).select(F.col("node").alias("sig"), "component")
        member = found.join(known, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        posts = roles(member, least, similarity)
        of_key = [F.count_if("small").alias("smalls"), F.count_if(~F.col("small")).alias("larges")]
        sizes = posts.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), *of_key).where("low < high")
        sizes = saved(sizes.select("key", (F.col("smalls") * F.col("larges")).alias("offers")).where("offers > 0"), "posting-sizes")
        sized = posts.join(bounded(sizes, 1_000_000), "key")
        short = sized.where(F.col("offers") <= MAX_POSTING * MAX_POSTING)
        # the rest of neither difference may be too short for what the two must share
        offered = f"not b.small and (a.r, a.sig) < (b.r, b.sig) and least(a.d - a.at, b.d - b.at) >= (a.r + b.r) / 2 - {SLACK}"
        pairs = across(short.where("small"), short, offered, similarity)
        links = saved(links.unionByName(verified(pairs, rows, docs, size, similarity)), "links")
        long = saved(sized.where(F.col("offers") > MAX_POSTING * MAX_POSTING).select("key", "sig", "n").distinct(), "long-postings")
        forget(mine, split, members, found, least, sizes, pairs)
    return links


def near_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, body, root) for each row of docs: root is one of the group of texts that chains of similar pairs connect."""
    docs = docs.select("doc_id", "text")
    rows = saved(prefixes(docs, size, similarity), "prefixes")
    comp = components(near_links(rows, docs, size, similarity)).withColumnRenamed("node", "sig")
    found = rows.select("doc_id", "body", "sig").join(bounded(saved(comp, "groups-of-sets")), "sig", "left")
    return saved(found.select("doc_id", "body", F.coalesce("component", "sig").alias("root")), "groups")
