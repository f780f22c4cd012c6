"""Duplicate files by perceptual hash.

Members of one hash meet only its DUP_CANDIDATES + 1 smallest ids, so a hash that a third of all files share costs a row
per file and candidate, never all pairs. Near hashes meet in an index of slices of the 64 bits, some of which are equal
within five differing bits. Equal hashes are one entry there, and pairs are between hashes, not files; groups name each hash once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.functions import values as V
from lumaframe.operators.components import components


def candidates(qc: DataFrame, limit: int = S.DUP_CANDIDATES) -> DataFrame:
    """(file_id, other_id) with equal hash: for each file the `limit` other uncorrupted files of smallest id."""
    hashed = qc.where((F.col("dup_hash") != "") & F.col("dup_hash").isNotNull())
    sound = hashed.where(~V.has(F.col("flags"), S.CORRUPTED))
    first = Window.partitionBy("dup_hash").orderBy("other_id")
    few = sound.select("dup_hash", F.col("file_id").alias("other_id")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit + 1)
    # the limit + 1 smallest ids hold every file's first `limit` others: drop the file itself or else the last
    pairs = hashed.select("file_id", "dup_hash").join(few, "dup_hash").where("file_id <> other_id")
    own = few.select(F.col("other_id").alias("file_id"), F.lit(True).alias("among"))
    return pairs.join(own, "file_id", "left").where(F.coalesce("among", F.lit(False)) | (F.col("n") <= limit)).select("file_id", "other_id")


def times_apart(a: Column, b: Column) -> Column:
    return F.abs(F.unix_timestamp(a) - F.unix_timestamp(b))


def gated(pairs: DataFrame, qc: DataFrame) -> DataFrame:
    """The candidate pairs that device and time do not rule out, with both kinds of evidence left to compare pixels."""
    facts = qc.select("file_id", "device", V.shoot_time(F.col("shoot_key")).alias("t"))
    a = facts.select("file_id", F.col("device").alias("a_device"), F.col("t").alias("a_t"))
    b = facts.select(F.col("file_id").alias("other_id"), F.col("device").alias("b_device"), F.col("t").alias("b_t"))
    rows = pairs.join(a, "file_id").join(b, "other_id")
    other_device = (F.col("a_device") != "") & (F.col("b_device") != "") & (F.col("a_device") != F.col("b_device"))
    apart = F.coalesce(times_apart(F.col("a_t"), F.col("b_t")) > S.DUP_WINDOW_S, F.lit(False))
    return rows.where(~other_device & ~apart).select("file_id", "other_id")


def passing(pairs: DataFrame, diffs: DataFrame, files: DataFrame, dup_sim: float = 0.95) -> DataFrame:
    """Pairs whose pixel difference (file_id, other_id, diff) is small enough: 1 - dup_sim for images, none for videos."""
    most = F.when(F.col("kind") == S.VIDEO, F.lit(S.DUP_DIFF_VIDEO)).otherwise(F.lit(1.0 - dup_sim))
    rows = pairs.join(diffs, ["file_id", "other_id"]).join(files.select(F.col("id").alias("file_id"), "kind"), "file_id")
    return rows.where(F.col("diff") <= most + 1e-12).select("file_id", "other_id", "diff")


def duplicates(pairs: DataFrame, mode: str = "later") -> DataFrame:
    """(file_id): files with a passing partner of smaller id, or with mode 'mutual' with any partner."""
    rows = pairs if mode == "mutual" else pairs.where("other_id < file_id")
    return rows.select("file_id").distinct()


def hash_groups(qc: DataFrame, files: DataFrame) -> DataFrame:
    """(dup_hash, files, first_id, redundant_bytes) of hashes that several files have."""
    rows = qc.where("dup_hash <> ''").select("file_id", "dup_hash").join(files.select(F.col("id").alias("file_id"), "size"), "file_id")
    groups = rows.groupBy("dup_hash").agg(F.count(F.lit(1)).alias("files"), F.min("file_id").alias("first_id"), (F.sum("size") - F.min_by("size", "file_id")).alias("redundant_bytes"))
    return groups.where("files > 1")


def bands_for(hashes: int, most: int = S.MAX_HAMMING) -> int:
    """The least number of slices, from `most` + 2 on, whose postings tell more hashes apart than there are."""
    return next((b for b in range(most + 2, 2 * most + 3) if 1 << (64 * (b - most) // b) > hashes), 2 * most + 3)


def near_hashes(qc: DataFrame, most: int = S.MAX_HAMMING, bands: int | None = None) -> DataFrame:
    """(hash_a, hash_b, distance) of different hashes within `most` bits, hash_a < hash_b as text.

    The 64 bits are cut into `bands` slices, of which at least bands - most are equal in such a pair. Hashes are posted under every
    combination of that many slices; a pair is reported by the combination of its first equal slices, so nothing has to be made
    distinct afterwards. With seven bands a posting is chosen by 18 bits, with eight by 24 (and 56 postings a hash instead of 21); unless
    it is given, bands_for() the number of different hashes is taken, so postings do not grow with the library.
    """
    if bands is None:
        bands = bands_for(qc.select("dup_hash").distinct().count(), most)
    edges = [64 * k // bands for k in range(bands + 1)]
    cuts = [(at, stop - at) for at, stop in zip(edges, edges[1:], strict=False)]
    hashes = qc.select("dup_hash", V.hash_long(F.col("dup_hash")).alias("h")).where("h is not null").distinct()

    def slice_of(h: Column, k: int) -> Column:
        at, n = cuts[k]
        return F.shiftrightunsigned(h, at).bitwiseAND((1 << n) - 1)

    def posting(combo: tuple[int, ...]) -> Column:
        value = F.lit(0).cast("long")
        for k in combo:
            value = F.shiftleft(value, cuts[k][1]).bitwiseOR(slice_of(F.col("h"), k))
        return F.struct(F.array(*map(F.lit, combo)).alias("combo"), value.alias("value"))

    posts = hashes.select("dup_hash", "h", F.explode(F.array(*map(posting, combinations(range(bands), bands - most)))).alias("p")).select("dup_hash", "h", "p.combo", "p.value")
    a = posts.select(F.col("dup_hash").alias("hash_a"), F.col("h").alias("ha"), "combo", "value")
    b = posts.select(F.col("dup_hash").alias("hash_b"), F.col("h").alias("hb"), "combo", "value")
    different = F.col("ha").bitwiseXOR(F.col("hb"))
    equal = F.filter(F.array(*[F.when(slice_of(different, k) == 0, F.lit(k)) for k in range(bands)]), lambda k: k.isNotNull())
    pairs = a.join(b, ["combo", "value"]).where("hash_a < hash_b").where(F.bit_count(different) <= most)
    return pairs.where(F.slice(equal, 1, bands - most) == F.col("combo")).select("hash_a", "hash_b", F.bit_count(different).alias("distance"))


def near_pairs(qc: DataFrame, most: int = S.MAX_HAMMING) -> DataFrame:
    """(hash_a, hash_b, distance, files_a, files_b): near hashes with the number of files of each."""
    sizes = qc.where("dup_hash <> ''").groupBy("dup_hash").agg(F.count(F.lit(1)).alias("n"))
    pairs = near_hashes(qc, most)
    pairs = pairs.join(sizes.select(F.col("dup_hash").alias("hash_a"), F.col("n").alias("files_a")), "hash_a")
    return pairs.join(sizes.select(F.col("dup_hash").alias("hash_b"), F.col("n").alias("files_b")), "hash_b").select("hash_a", "hash_b", "distance", "files_a", "files_b")


def near_groups(qc: DataFrame, most: int = S.MAX_HAMMING) -> DataFrame:
    """(dup_hash, group_hash, files): every hash that files have, its group's smallest hash as text, and the files of the whole group.

    Groups are what chains of near hashes connect: a row for each hash with its group, not a row for each pair of members.
    """
    sizes = qc.where("dup_hash <> ''").groupBy("dup_hash").agg(F.count(F.lit(1)).alias("n"))
    links = near_hashes(qc, most).select(F.col("hash_a").alias("a"), F.col("hash_b").alias("b"))
    known = components(links).select(F.col("node").alias("dup_hash"), F.col("component").alias("group_hash"))
    rows = sizes.join(known, "dup_hash", "left").withColumn("group_hash", F.coalesce("group_hash", "dup_hash"))
    return rows.join(rows.groupBy("group_hash").agg(F.sum("n").alias("files")), "group_hash").select("dup_hash", "group_hash", "files")
