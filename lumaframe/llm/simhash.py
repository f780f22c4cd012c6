"""SimHash near-duplicate groups through an inverted index over byte positions.

A fingerprint is eight bytes, each at its position. Two fingerprints that differ in at most two bits share at least six
positional bytes. The index posts every distinct fingerprint under fourteen blocks of four positions, chosen so that any
three positions lie in exactly one block: who shares six bytes meets in three blocks, who shares five in one, who shares
seven in seven. Spark tallies in how many blocks each pair meets, pairs under the guaranteed number go, and the rest is
verified by the number of differing bits.

A posting longer than MAX_POSTING is split by further positions: among the four bytes outside the block two at least are
shared, so its members are posted anew under the block and two more bytes, and what is still long under two of the last
four half bytes. Such a posting holds at most 256 fingerprints whatever the corpus, so no pairs within a large group are made.

Exact copies are one fingerprint from the start (partial aggregation), so a group that holds a third of all rows is one
row here. Components come from alternating large-star and small-star steps on tables in the shared folder.

Defined results: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle make
one shingle of what there is; equal rows get equal results; an empty table gives an empty result; other columns are not
looked at. A null doc_id never names a component unless all of the group's ids are null; rows that share an id but not a
group stay in their own groups, which then have the same name.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lumaframe.llm.common import as_bytes, bounded, forget, once, saved, slices

MAX_POSTING = 64
#: The blocks of four of the eight positions: any three positions lie in one of them (their numbers' exclusive or is zero).
BLOCKS = [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
#: By the most differing bits: in how many blocks a pair meets at least.
MEETINGS = {0: 14, 1: 7, 2: 3}
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the ASCII-lower-cased words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, body, fp): fp is the fingerprint as a signed long, body a hash of the text."""
    typed = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(part)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), pa.array(fps)], names=["doc_id", "body", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(run, f"doc_id {typed}, body long, fp long")


def mask_of(positions, width: int = 8) -> int:
    """The bits of some positions (of width bits each) as a signed long."""
    return int(np.uint64(sum(((1 << width) - 1) << width * p for p in positions)).view(np.int64))


def blocks_of(fps: DataFrame) -> DataFrame:
    """(block, mask, value, fp): each fingerprint under each block; value is what the mask leaves of it."""
    masks = F.explode(F.array(*[F.lit(mask_of(b)) for b in BLOCKS]))
    found = fps.select("fp", masks.alias("block")).withColumn("mask", F.col("block"))
    return found.select("block", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def split(posts: DataFrame, width: int) -> DataFrame:
    """postings under two more of the four positions, width bits each, that are still open; they may differ in two."""
    closed = {8: BLOCKS, 4: [(*b, *more) for b in BLOCKS for more in combinations(sorted({*range(8)} - {*b}), 2)]}[width]
    further = {}
    for positions in closed:
        left = [p * 8 // width + k for p in range(8) if p not in positions for k in range(8 // width)]
        further[mask_of(positions)] = [mask_of(positions) | mask_of(two, width) for two in combinations(left, 2)]
    table = F.create_map(*[x for m, to in further.items() for x in (F.lit(m), F.array(*map(F.lit, to)))])
    found = posts.select("block", "fp", F.explode(table[F.col("mask")]).alias("mask"))
    return found.select("block", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def paired(posts: DataFrame) -> DataFrame:
    """(block, a, b) from short postings."""
    lists = posts.groupBy("block", "mask", "value").agg(F.sort_array(F.collect_set("fp")).alias("fps"))
    first = lists.select("block", "fps", F.posexplode("fps").alias("i", "a"))
    return first.select("block", "a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("b"))


def meetings(fps: DataFrame) -> DataFrame:
    """(block, a, b) for each block in whose postings a pair meets."""
    posts, found, open_widths = blocks_of(fps), None, [8, 4]
    while True:
        keys = ["block", "mask", "value"]
        sizes = saved(posts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "posting-sizes")
        short = sizes if not open_widths else sizes.where(F.col("n") <= MAX_POSTING)
        pairs = paired(posts.join(short.select(*keys), keys, "left_semi"))
        found = pairs if found is None else found.unionByName(pairs)
        long = sizes.where(F.col("n") > MAX_POSTING)
        if not open_widths or long.isEmpty():
            return found
        posts = saved(split(posts.join(long.select(*keys), keys, "left_semi"), open_widths.pop(0)), "split-postings")


def near_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints within max_bits (at most 2) of each other."""
    if max_bits not in MEETINGS:
        raise ValueError("the index guarantees pairs of up to two differing bits")
    tally = meetings(fps).distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return saved(tally.where((F.col("met") >= MEETINGS[max_bits]) & near).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): component is the smallest node reachable.

    Large-star links each node's larger neighbours to its smallest neighbour, small-star the smaller ones; repeated until
    nothing changes, which takes a number of rounds that grows with the logarithm of the longest chain.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # written out, so that the join below has a plain shuffle on either side and a hub's rows can be split
        least = saved(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        found = pairs.join(least, "a")
        if large:
            found = found.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            found = found.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        found = saved(found.where("a <> b").distinct(), "edges")
        forget(least)
        return found

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(edges)
    while before[0]:
        wide = star(both(edges), True)
        forget(edges)
        edges = star(wide.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False)
        forget(wide)
        if (now := mark(edges)) == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, body, fp, root, component_id) for each row of docs: root tells groups apart, component_id is the smallest doc_id in one."""
    prints = saved(fingerprints(docs, shingle), "fingerprints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    # ids name the components only when they are complete: a text without an id, or with that of another text, links like any other
    comp = components(near_links(classes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    rooted = saved(classes.join(comp, "fp", "left").select("fp", "node", F.coalesce("component", "fp").alias("root")), "roots")
    names = saved(rooted.groupBy("root").agg(F.min("node").alias("component_id")), "names")
    found = saved(rooted.select("fp", "root").join(names, "root"), "components")
    return prints.join(found, "fp").select("doc_id", "body", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with one row of each group (doc_id, body, root): the one with the smallest doc_id, then body; null ids come last.

    The rows that go are looked up, so texts stay where they are unless those are too many to broadcast.
    """
    mark = "_body_" + uuid.uuid4().hex
    rows = groups.select("root", "doc_id", "body").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "body")
    first = saved(rows.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1").select("root", "first"), "first-of-each")
    other = rows.join(first, "root").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("body") == F.col("first.body"))))
    gone = saved(other.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body")), "gone")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    keys = bounded(gone)
    stay = marked.join(keys, marked["doc_id"].eqNullSafe(keys["_id"]) & (marked[mark] == keys["_body"]), "left_anti")
    return once(stay, ["doc_id", mark], groups.select("doc_id", F.col("body").alias(mark))).select(*docs.columns)


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """docs with one document of each SimHash group."""
    return one_of_each(docs, saved(near_groups(docs, shingle, max_bits), "groups"))
