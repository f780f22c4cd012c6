"""Marks: current state from the log of decisions, locks, and folder-wide edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.functions import values as V


def with_marks(files: DataFrame, reviews: DataFrame, qc: DataFrame | None = None) -> DataFrame:
    """Files with decision, reviewer (0 and '' if unmarked) and, if given, flags, detail and dup_hash."""
    marks = reviews.select(F.col("file_id").alias("id"), F.col("decision").alias("mark"), F.col("reviewer").alias("who"))
    out = files.join(marks, "id", "left")
    columns = [*files.columns, F.coalesce("mark", F.lit(0)).cast("int").alias("decision"), F.coalesce("who", F.lit("")).alias("reviewer")]
    if qc is not None:
        found = qc.select(F.col("file_id").alias("id"), F.col("flags").alias("q_flags"), F.col("detail").alias("q_detail"), F.col("dup_hash").alias("q_hash"))
        out = out.join(found, "id", "left")
        columns += [F.coalesce("q_flags", F.lit(0)).cast("int").alias("flags"), F.coalesce("q_detail", F.lit("")).alias("detail"), F.coalesce("q_hash", F.lit("")).alias("dup_hash")]
    return out.select(*columns)


def lookup(marked: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of with_marks() whose id is in ids (id)."""
    return marked.join(ids.select("id").distinct(), "id", "left_semi")


FILTERS = {
    "all": F.lit,
    "keep": lambda _: F.col("decision") == S.KEEP,
    "reject": lambda _: F.col("decision") == S.REJECT,
    "pending": lambda _: F.col("decision") == S.PENDING,
    "image": lambda _: F.col("kind") == S.IMAGE,
    "video": lambda _: F.col("kind") == S.VIDEO,
    "dup": lambda _: V.has(F.col("flags"), S.DUP),
    "issue": lambda _: V.has(F.col("flags"), S.ISSUES),
}


def filtered(marked: DataFrame, name: str) -> DataFrame:
    """with_marks() under one of FILTERS; whether a file is present plays no part."""
    return marked.where(FILTERS[name](True))


def page(marked: DataFrame, folder_id: int, after: tuple[str, int] | None = None, limit: int = 60) -> DataFrame:
    """The next `limit` files of a folder by (sort_key, id) after the given pair; limits beyond 300 fall back to 60."""
    limit = limit if 0 < limit <= 300 else 60
    rows = marked.where(F.col("folder_id") == folder_id)
    if after:
        rows = rows.where((F.col("sort_key") > after[0]) | ((F.col("sort_key") == after[0]) & (F.col("id") > after[1])))
    return rows.orderBy("sort_key", "id").limit(limit)


def page_with_parent(marked: DataFrame, folders: DataFrame, folder_id: int, limit: int = 60, parent_limit: int = 200) -> DataFrame:
    """The first page of a folder and, tagged from_parent, up to parent_limit files of the folder above (none for the root)."""
    own = page(marked, folder_id, limit=limit).withColumn("from_parent", F.lit(False))
    above = folders.where((F.col("id") == folder_id) & (F.col("parent_id") != 0)).select(F.col("parent_id").alias("folder_id"))
    upper = marked.join(above, "folder_id", "left_semi").orderBy("sort_key", "id").limit(parent_limit).withColumn("from_parent", F.lit(True))
    return own.unionByName(upper)


def latest(events: DataFrame) -> DataFrame:
    """REVIEW rows from (ts_ms, seq, file_id, decision, user_name): the last change of each file.

    An event that repeats the value before it changes nothing, so reviewer and time are those of the first of a run of equal values.
    """
    own = Window.partitionBy("file_id").orderBy("ts_ms", "seq")
    changed = events.withColumn("before", F.lag("decision").over(own)).where(F.col("before").isNull() | (F.col("before") != F.col("decision")))
    last = changed.groupBy("file_id").agg(F.max_by(F.struct("decision", "user_name", "ts_ms"), F.struct("ts_ms", "seq")).alias("r"))
    return last.select("file_id", "r.decision", F.col("r.user_name").alias("reviewer"), F.floor(F.col("r.ts_ms") / 1000).cast("long").alias("updated_at"))


def editable(files: DataFrame, claims: DataFrame, user: str) -> DataFrame:
    """Files with can_edit: the file's own folder is not claimed, or by the user."""
    held = claims.select("folder_id", F.col("user_name").alias("holder"))
    return files.join(held, "folder_id", "left").withColumn("can_edit", F.coalesce(F.col("holder") == user, F.lit(True)))


def outcomes(edits: DataFrame, files: DataFrame, claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """edits (file_id, decision, user_name) with outcome: missing, blocked, same or changed."""
    rows = edits.join(files.select(F.col("id").alias("file_id"), "folder_id"), "file_id", "left")
    rows = rows.join(claims.select("folder_id", F.col("user_name").alias("holder")), "folder_id", "left")
    rows = rows.join(reviews.select("file_id", F.col("decision").alias("mark")), "file_id", "left")
    state = (
        F.when(F.col("folder_id").isNull(), "missing")
        .when(F.col("holder").isNotNull() & (F.col("holder") != F.col("user_name")), "blocked")
        .when(F.col("mark") == F.col("decision"), "same")
        .otherwise("changed")
    )
    return rows.select("file_id", "decision", "user_name", state.alias("outcome"))


def apply_edits(edits: DataFrame, files: DataFrame, claims: DataFrame, reviews: DataFrame, now_s: int) -> DataFrame:
    """REVIEW rows after the edits (one per file) that are neither blocked nor repeats."""
    done = outcomes(edits, files, claims, reviews).where("outcome = 'changed'")
    new = done.select("file_id", F.col("decision").cast("int"), F.col("user_name").alias("reviewer"), F.lit(now_s).cast("long").alias("updated_at"))
    return reviews.join(new.select("file_id"), "file_id", "left_anti").unionByName(new)


def _open_folder(files: DataFrame, claims: DataFrame, folder_id: int, user: str) -> DataFrame:
    """Ids of the present files of this level, none if someone else holds the folder."""
    other = claims.where((F.col("folder_id") == folder_id) & (F.col("user_name") != user)).select("folder_id")
    own = files.where((F.col("folder_id") == folder_id) & (F.col("present") == 1))
    return own.join(other, "folder_id", "left_anti").select(F.col("id").alias("file_id"))


def decide_folder(files: DataFrame, reviews: DataFrame, claims: DataFrame, folder_id: int, decision: int, user: str, now_s: int) -> DataFrame:
    """REVIEW rows after one decision for all present files of a folder (not those below)."""
    own = _open_folder(files, claims, folder_id, user)
    new = own.select("file_id", F.lit(decision).alias("decision"), F.lit(user).alias("reviewer"), F.lit(now_s).cast("long").alias("updated_at"))
    return reviews.join(own, "file_id", "left_anti").unionByName(new)


def clear_folder(files: DataFrame, reviews: DataFrame, claims: DataFrame, folder_id: int, user: str) -> DataFrame:
    """REVIEW rows without those of the present files of a folder (not those below); doing it again changes nothing."""
    return reviews.join(_open_folder(files, claims, folder_id, user), "file_id", "left_anti")
