"""Counts: per folder, rolled up the tree, over the library, and for the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.functions import paths as P
from lumaframe.functions import values as V
from lumaframe.operators.review import with_marks
from lumaframe.session import cut

BITS = {"dup": S.DUP, "corrupted": S.CORRUPTED, "blank": S.BLANK, "lens_dirt": S.LENS_DIRT, "blur": S.BLUR, "exposure": S.EXPOSURE, "noise": S.NOISE, "shake": S.SHAKE}


def folder_counts(folders: DataFrame, files: DataFrame, reviews: DataFrame) -> DataFrame:
    """(folder_id, total, keep, reject) of each folder's own files; files join marks before anything moves by folder."""
    marked = with_marks(files.select("id", "folder_id"), reviews)
    counts = marked.groupBy("folder_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("decision") == S.KEEP).alias("keep"), F.count_if(F.col("decision") == S.REJECT).alias("reject"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "keep", "reject")]
    return folders.select(F.col("id").alias("folder_id")).join(counts, "folder_id", "left").select("folder_id", *zero)


def tree_counts(folders: DataFrame, counts: DataFrame) -> DataFrame:
    """FOLDER rows with total, keep, reject and pending of the whole subtree, and has_children.

    Files are counted per folder first, so what is repeated for each ancestor is one row per folder.
    """
    own = folders.join(counts, folders["id"] == counts["folder_id"], "left")
    up = own.select(F.explode(F.array_union(P.ancestors(F.col("rel_path")), F.array("rel_path"))).alias("path"), "total", "keep", "reject")
    sums = up.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("total", "keep", "reject")])
    children = folders.select(F.col("parent_id").alias("id")).distinct().withColumn("has_children", F.lit(True))
    return (
        folders.join(sums, folders["rel_path"] == sums["path"])
        .join(children, "id", "left")
        .select("id", "parent_id", "name", "rel_path", "depth", "total", "keep", "reject", (F.col("total") - F.col("keep") - F.col("reject")).alias("pending"), F.coalesce("has_children", F.lit(False)).alias("has_children"))
    )


def level_counts(folders: DataFrame, counts: DataFrame) -> DataFrame:
    """Subtotals by the first two path levels and over all (grouping says which)."""
    parts = F.split("rel_path", "/")
    own = folders.join(counts, folders["id"] == counts["folder_id"]).select(F.get(parts, F.lit(0)).alias("level1"), F.get(parts, F.lit(1)).alias("level2"), "total", "keep", "reject")
    return own.rollup("level1", "level2").agg(F.sum("total").alias("total"), F.sum("keep").alias("keep"), F.sum("reject").alias("reject"), F.grouping_id().cast("int").alias("grouping"))


def subfolders(tree: DataFrame, parent_id: int, claims: DataFrame | None = None) -> DataFrame:
    """The folders in one, by name whatever its case, with who claims them."""
    rows = tree.where(F.col("parent_id") == parent_id)
    if claims is not None:
        rows = rows.join(claims.select(F.col("folder_id").alias("id"), F.col("user_name").alias("claimed_by")), "id", "left")
    return rows.orderBy(F.lower("name"), "id")


def totals(files: DataFrame, reviews: DataFrame) -> DataFrame:
    """(files, keep, reject, pending): marks are counted whether or not their file is there."""
    marks = reviews.agg(F.count_if(F.col("decision") == S.KEEP).alias("keep"), F.count_if(F.col("decision") == S.REJECT).alias("reject"))
    one = files.agg(F.count(F.lit(1)).alias("files")).crossJoin(marks)  # one row each
    return one.select("files", "keep", "reject", (F.col("files") - F.col("keep") - F.col("reject")).alias("pending"))


def media_totals(files: DataFrame) -> DataFrame:
    here = F.col("present") == 1
    return files.agg(
        F.count_if(here & (F.col("kind") == S.IMAGE)).alias("photos"), F.count_if(here & (F.col("kind") == S.VIDEO)).alias("videos"),
        F.count_if(here & (F.col("processed") == 1)).alias("processed"), F.count_if(here & (F.col("processed") == 0)).alias("unprocessed"),
    )


def _bit_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), *[F.count_if(V.has(F.col("flags"), bit)).alias(name) for name, bit in BITS.items()]]


def qc_counts(files: DataFrame, qc: DataFrame, by_folder: bool = False) -> DataFrame:
    """Detector bits of present files, over all or per folder."""
    found = files.where("present = 1").select(F.col("id").alias("file_id"), "folder_id").join(qc.select("file_id", "flags"), "file_id")
    return found.groupBy("folder_id").agg(*_bit_counts()) if by_folder else found.agg(*_bit_counts())


def folder_progress(files: DataFrame, reviews: DataFrame, claims: DataFrame) -> DataFrame:
    """(folder_id, total, done, pending, claimer) of folders with something pending, over present files."""
    marked = with_marks(files.where("present = 1").select("id", "folder_id"), reviews)
    counts = marked.groupBy("folder_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("decision") != S.PENDING).alias("done"))
    counts = counts.withColumn("pending", F.col("total") - F.col("done")).where("pending > 0")
    return counts.join(claims.select("folder_id", F.col("user_name").alias("claimer")), "folder_id", "left")


def most_pending(progress: DataFrame, n: int = 8) -> DataFrame:
    return progress.orderBy(F.desc("pending"), F.desc("total"), "folder_id").limit(n)


def claim_summary(folders: DataFrame, claims: DataFrame, now_ms: int) -> DataFrame:
    """(folders, claims, stale, active, unclaimed) at a time."""
    held = claims.agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("claimed_at") < now_ms - S.STALE_MS).alias("stale"))
    one = folders.agg(F.count(F.lit(1)).alias("folders")).crossJoin(held)  # one row each
    active = F.col("claims") - F.col("stale")
    return one.select("folders", "claims", "stale", active.alias("active"), (F.col("folders") - active).alias("unclaimed"))


def stale_claims(claims: DataFrame, folders: DataFrame, now_ms: int, n: int = 100) -> DataFrame:
    """The oldest stale claims with their folders; idle_ms counts from the moment at which they became stale."""
    cutoff = now_ms - S.STALE_MS
    old = claims.where(F.col("claimed_at") < cutoff).join(folders.select(F.col("id").alias("folder_id"), "name", "rel_path"), "folder_id")
    return old.select("folder_id", "name", "rel_path", "user_name", "claimed_at", (F.lit(cutoff) - F.col("claimed_at")).alias("idle_ms")).orderBy("claimed_at", "folder_id").limit(n)


def mark_counts(files: DataFrame, reviews: DataFrame, user: str) -> DataFrame:
    """(folder_id, marked, mine): rows of the log's state, those with decision 0 too, of present files."""
    found = reviews.join(files.where("present = 1").select(F.col("id").alias("file_id"), "folder_id"), "file_id")
    return found.groupBy("folder_id").agg(F.count(F.lit(1)).alias("marked"), F.count_if(F.col("reviewer") == user).alias("mine"))


def done_counts(files: DataFrame, reviews: DataFrame) -> DataFrame:
    """(folder_id, files, done): present files, and those kept or rejected."""
    marked = with_marks(files.where("present = 1").select("id", "folder_id"), reviews)
    return marked.groupBy("folder_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("decision").isin(S.KEEP, S.REJECT)).alias("done"))


def active_reviewers(claims: DataFrame, known: DataFrame, now_ms: int, anonymous: str = "匿名") -> DataFrame:
    """(name, folder_id): who holds a claim or was seen in the last minutes; folder_id is the first claim, if any."""
    seen = known.where(F.col("last_used") >= now_ms - S.ACTIVE_MS).select("name", F.lit(None).cast("long").alias("folder_id"))
    both = claims.select(F.col("user_name").alias("name"), "folder_id").unionByName(seen)
    return both.where((F.trim("name") != "") & (F.col("name") != anonymous)).groupBy("name").agg(F.min("folder_id").alias("folder_id"))


def recent_names(uses: DataFrame, n: int = 20, anonymous: str = "匿名") -> DataFrame:
    """(name, last_used): the n names used last; of equal times the one that came in later, by its first record.

    uses: name, last_used, seq (the number of the record). Blank names and the anonymous one are not remembered.
    """
    named = uses.withColumn("name", F.trim("name")).where((F.col("name") != "") & (F.col("name") != anonymous))
    last = named.groupBy("name").agg(F.max("last_used").alias("last_used"), F.min("seq").alias("first"))
    return last.orderBy(F.desc("last_used"), F.desc("first")).limit(n).select("name", "last_used")


def issue_centre(files: DataFrame, failed: DataFrame, qc: DataFrame, scan_errors: DataFrame, n: int = 200) -> DataFrame:
    """(kind, text, n): failed derivatives, missing files (n of them by name, then one row for the rest), scan errors, corrupted files."""
    gone = files.where("present = 0")
    first = gone.orderBy("name", "id").limit(n).select(F.lit("missing").alias("kind"), F.col("rel_path").alias("text"), F.lit(1).cast("long").alias("n"))
    more = gone.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n).select(F.lit("missing_more").alias("kind"), F.lit("").alias("text"), (F.col("n") - n).alias("n"))
    broken = qc.agg(F.count_if(V.has(F.col("flags"), S.CORRUPTED)).alias("n")).where("n > 0").select(F.lit("corrupted").alias("kind"), F.lit("").alias("text"), "n")
    bad = failed.select(F.lit("failed").alias("kind"), F.col("rel_path").alias("text"), F.lit(1).cast("long").alias("n"))
    errors = scan_errors.select(F.lit("scan").alias("kind"), F.col("message").alias("text"), F.lit(1).cast("long").alias("n"))
    return bad.unionByName(first).unionByName(more).unionByName(errors).unionByName(broken)


def dashboard(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, json): each section's rows as one JSON array, in the order of their JSON. Sections are counts or short lists."""
    out = None
    for name, df in sorted(sections.items()):
        rows = df.select(F.to_json(F.struct(*df.columns)).alias("j")).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("j")), ","), F.lit("]")).alias("json"))
        one = rows.select(F.lit(name).alias("section"), "json")
        out = one if out is None else out.unionByName(one)
    return out


def numbered(df: DataFrame, *keys: str, name: str = "no") -> DataFrame:
    """df with consecutive numbers in the order of keys (which must tell rows apart) and no single-partition window.

    Rows are range-partitioned and written once; each partition's count gives the offset of the next.
    """
    parts = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))  # one row per partition
    inside = Window.partitionBy("_part").orderBy(*keys)
    return parts.withColumn("_n", F.row_number().over(inside)).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_n") + F.col("_offset")).drop("_part", "_n", "_offset")
