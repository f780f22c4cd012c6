"""Catalog snapshots: from listings to files and folders, and what changed since the last one.

Joins between snapshots are on rel_path (one row per path on either side, so no key is hot) and read only the columns that
they compare. Folders are few next to files and are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.functions import paths as P
from lumaframe.session import cut

SKIPPED = ("$RECYCLE.BIN", "System Volume Information")


def listed(listing: DataFrame, formats: DataFrame) -> DataFrame:
    """(rel_path, name, ext, size, mtime, kind, decoder, previewable) of the media in a listing (path, size, mtime).

    Drops everything under a segment that starts with '.' or is a system folder, and unknown extensions.
    """
    path = F.translate("path", "\\", "/")
    skip = F.exists(F.split(path, "/"), lambda s: s.startswith(".") | s.isin(*SKIPPED))
    rows = listing.select(path.alias("rel_path"), "size", "mtime").where(~skip)
    rows = rows.withColumn("name", P.base_name(F.col("rel_path"))).withColumn("ext", P.extension(F.col("rel_path")))
    return rows.join(F.broadcast(formats), "ext")


def catalog(media: DataFrame, folders: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """FILE rows of listed(): ids are carried over by rel_path, new ones are a hash of the path."""
    rows = media.withColumn("parent", P.parent(F.col("rel_path"))).join(folders.select(F.col("id").alias("folder_id"), F.col("rel_path").alias("parent")), "parent", "left")
    fresh = F.xxhash64("rel_path").bitwiseAND((1 << 63) - 1)
    if previous is None:
        rows = rows.withColumn("id", fresh).withColumn("was", F.lit(0))
    else:
        rows = rows.join(previous.select("rel_path", F.col("id").alias("old_id"), F.col("processed").alias("was")), "rel_path", "left").withColumn("id", F.coalesce("old_id", fresh))
    return rows.select(
        "id", "folder_id", "name", F.lower("name").alias("sort_key"), "rel_path", "ext", "size", "mtime", "kind", F.lit(1).alias("present"), F.coalesce("was", F.lit(0)).alias("processed"),
    )


def folder_tree(paths: DataFrame, directories: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """FOLDER rows for every folder above the rel_paths, the root, and the directories given (which may be empty ones)."""
    found = paths.select(F.explode(P.ancestors(F.col("rel_path"))).alias("rel_path")).distinct()
    if directories is not None:
        own = directories.select("rel_path").where("rel_path <> '.'")
        found = found.unionByName(own).unionByName(own.select(F.explode(P.ancestors(F.col("rel_path"))).alias("rel_path"))).distinct()
    rows = found.withColumn("id", F.xxhash64("rel_path").bitwiseAND((1 << 63) - 1))
    if previous is not None:
        rows = rows.join(previous.select("rel_path", F.col("id").alias("old")), "rel_path", "left").withColumn("id", F.coalesce("old", "id")).drop("old")
    above = rows.select(F.col("rel_path").alias("parent"), F.col("id").alias("parent_id"))
    rows = rows.withColumn("parent", F.when(F.col("rel_path") != P.ROOT, P.parent(F.col("rel_path"))))
    return rows.join(above, "parent", "left").select(
        "id", F.coalesce("parent_id", F.lit(0)).alias("parent_id"), P.base_name(F.col("rel_path")).alias("name"), "rel_path", P.depth(F.col("rel_path")).alias("depth")
    )


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(rel_path, old_id, new_id, state): added, removed, changed (size or mtime) or unchanged."""
    a = previous.select("rel_path", F.col("id").alias("old_id"), F.col("size").alias("a_size"), F.col("mtime").alias("a_mtime"))
    b = current.select("rel_path", F.col("id").alias("new_id"), F.col("size").alias("b_size"), F.col("mtime").alias("b_mtime"))
    same = (F.col("a_size") == F.col("b_size")) & (F.col("a_mtime") == F.col("b_mtime"))
    state = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, "rel_path", "full_outer").select("rel_path", "old_id", "new_id", state.alias("state"))


def removed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The rel_paths that the current snapshot no longer has."""
    return previous.select("rel_path").exceptAll(current.select("rel_path"))


def surviving_reviews(reviews: DataFrame, changes: DataFrame) -> DataFrame:
    """Marks without those of changed and removed files."""
    gone = changes.where(F.col("state").isin("changed", "removed")).select(F.col("old_id").alias("file_id"))
    return reviews.join(gone, "file_id", "left_anti")


def pruned(folders: DataFrame, seen: DataFrame) -> DataFrame:
    """The folders whose rel_path was seen."""
    return folders.join(seen.select("rel_path").distinct(), "rel_path", "left_semi")


def surviving_claims(claims: DataFrame, folders: DataFrame) -> DataFrame:
    return claims.join(folders.select(F.col("id").alias("folder_id")), "folder_id", "left_semi")


def refresh(previous: DataFrame, current: DataFrame, reviews: DataFrame, claims: DataFrame, qc: DataFrame, folders: DataFrame) -> dict[str, DataFrame]:
    """One scan: what changed, and the marks, claims and detector rows that outlive it, with a row of counts."""
    changes = diff(previous, current)
    counts = changes.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("added", "removed", "changed", "unchanged")])
    seen = current.select(F.explode(P.ancestors(F.col("rel_path"))).alias("rel_path"))
    left = pruned(folders, seen)
    gone = changes.where("state = 'removed'").select(F.col("old_id").alias("file_id"))
    return {
        "changes": changes, "reviews": surviving_reviews(reviews, changes), "folders": left, "claims": surviving_claims(claims, left),
        "qc": qc.join(gone, "file_id", "left_anti"), "counts": counts,
    }


def refresh_counts(previous: DataFrame, current: DataFrame, reviews: DataFrame, claims: DataFrame, qc: DataFrame, folders: DataFrame) -> DataFrame:
    """One row of what a scan did: files added, removed, changed and unchanged; marks and results dropped, folders and claims pruned."""
    found = refresh(previous, current, reviews, claims, qc, folders)
    gone = found["changes"].where(F.col("state").isin("changed", "removed")).select(F.col("old_id").alias("file_id"), "state")
    left = found["folders"].select(F.col("id").alias("folder_id"))
    one = found["counts"]
    for rows, name in (
        (reviews.join(gone, "file_id", "left_semi"), "marks_dropped"),
        (qc.join(gone.where("state = 'removed'"), "file_id", "left_semi"), "results_dropped"),
        (folders.select(F.col("id").alias("folder_id")).join(left, "folder_id", "left_anti"), "folders_pruned"),
        (claims.join(left, "folder_id", "left_anti"), "claims_pruned"),
    ):
        one = one.crossJoin(rows.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return one


def media_list(files: DataFrame, kind: int | None = None, folder_id: int | None = None, present_only: bool = True) -> DataFrame:
    """Files by id: of one kind or all media, of one folder or all."""
    keep: Column = F.col("kind").isin(S.IMAGE, S.VIDEO) if not kind or kind <= 0 else F.col("kind") == kind
    if folder_id is not None:
        keep = keep & (F.col("folder_id") == folder_id)
    if present_only:
        keep = keep & (F.col("present") == 1)
    return files.where(keep)


def subtree(folders: DataFrame, rel_path: str) -> DataFrame:
    """A folder and all below it, by path prefix."""
    return folders.where(P.is_under(F.col("rel_path"), rel_path))


def closure(folders: DataFrame) -> DataFrame:
    """(ancestor_id, folder_id) for every folder and each folder above it, itself included."""
    above = folders.select(F.col("id").alias("folder_id"), F.explode(F.array_union(P.ancestors(F.col("rel_path")), F.array("rel_path"))).alias("path"))
    return above.join(folders.select(F.col("id").alias("ancestor_id"), F.col("rel_path").alias("path")), "path").select("ancestor_id", "folder_id")


def closure_by_parents(folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ancestor_id, folder_id, distance) as closure() has it, from (id, parent_id) alone, and (id) of folders in or below a circle.

    Pointers double: after round k every folder knows its ancestors up to 2^k - 1 steps above and the one 2^k above, so a tree of depth
    d takes log2(d) rounds, however deep it is. A parent that is no folder (0 among them) ends the way up. A folder that meets itself is in
    a circle and its pointer goes, with those that lead there; these folders and all below are in the second table, not in the first.
    """
    ids = folders.select("id").distinct()
    parents = folders.select("id", "parent_id").distinct().join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    above = cut(ids.select(F.col("id").alias("ancestor_id"), F.col("id").alias("folder_id"), F.lit(0).cast("long").alias("distance")))
    jump = cut(parents.select(F.col("id").alias("folder_id"), F.col("parent_id").alias("top")))
    stuck, step = ids.where("false"), 1
    while not jump.isEmpty():
        known = above.select("ancestor_id", F.col("folder_id").alias("top"), "distance")
        further = cut(jump.join(known, "top").select("ancestor_id", "folder_id", (F.col("distance") + step).alias("distance")))
        circle = further.where("ancestor_id = folder_id").select(F.col("folder_id").alias("id")).distinct()
        if not circle.isEmpty():
            caught = jump.join(circle.select(F.col("id").alias("top")), "top", "left_semi").select(F.col("folder_id").alias("id"))
            stuck = cut(stuck.unionByName(circle).unionByName(caught).distinct())
            jump = jump.join(stuck.select(F.col("id").alias("folder_id")), "folder_id", "left_anti")
        above = cut(above.unionByName(further))
        jump = cut(jump.join(jump.select(F.col("folder_id").alias("top"), F.col("top").alias("next")), "top").select("folder_id", F.col("next").alias("top")))
        step *= 2
    below = above.join(stuck.select(F.col("id").alias("ancestor_id")), "ancestor_id", "left_semi").select(F.col("folder_id").alias("id"))
    circling = below.distinct()
    return above.join(circling.select(F.col("id").alias("folder_id")), "folder_id", "left_anti").select("ancestor_id", "folder_id", "distance"), circling


def subtree_by_parents(folders: DataFrame, folder_id: int) -> DataFrame:
    """A folder and all below it, by parent ids."""
    below = closure_by_parents(folders)[0].where(F.col("ancestor_id") == folder_id)
    return folders.join(below.select(F.col("folder_id").alias("id")), "id", "left_semi")
