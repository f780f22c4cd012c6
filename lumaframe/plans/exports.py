"""What an export takes along, where to, and its lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.functions import paths as P
from lumaframe.functions import values as V
from lumaframe.operators.catalog import subtree
from lumaframe.operators.review import with_marks
from lumaframe.operators.stats import numbered

ORDER = ("folder_id", "sort_key", "id")


def scope(folders: DataFrame, mode: str, rel_path: str = P.ROOT) -> DataFrame:
    """(folder_id) of the whole tree ('all'), a subtree ('recursive') or one folder ('one')."""
    found = folders if mode == "all" else subtree(folders, rel_path) if mode == "recursive" else folders.where(F.col("rel_path") == rel_path)
    return found.select(F.col("id").alias("folder_id"))


def kept(files: DataFrame, reviews: DataFrame, folders: DataFrame) -> DataFrame:
    """Present kept files of the folders (folder_id)."""
    marks = reviews.where(F.col("decision") == S.KEEP).select(F.col("file_id").alias("id"))
    return files.where("present = 1").join(folders, "folder_id", "left_semi").join(marks, "id", "left_semi").select(*files.columns)


def kept_ids(files: DataFrame, reviews: DataFrame, folders: DataFrame) -> DataFrame:
    """The ids of kept(), as an intersection of sets."""
    marked = reviews.where(F.col("decision") == S.KEEP).select(F.col("file_id").alias("id"))
    return marked.intersect(files.where("present = 1").join(folders, "folder_id", "left_semi").select("id"))


def in_scope(files: DataFrame, reviews: DataFrame, folders: DataFrame) -> DataFrame:
    """Present files of the folders with their mark; unmarked ones too."""
    return with_marks(files.where("present = 1").join(folders, "folder_id", "left_semi").select(*files.columns), reviews)


def rebased(rel_path, base: str):
    """The path below base; others stay whole."""
    if base == P.ROOT:
        return rel_path
    return F.when(rel_path.startswith(base + "/"), F.substring(rel_path, len(base) + 2, 1 << 20)).otherwise(rel_path)


def copy_plan(files: DataFrame, destination: DataFrame, base: str = P.ROOT) -> DataFrame:
    """(id, rel, size, status): illegal paths, what the destination (rel_path, size) has already, and what to copy."""
    rows = files.select("id", rebased(F.col("rel_path"), base).alias("rel"), "size")
    rows = rows.join(destination.select(F.col("rel_path").alias("rel"), F.col("size").alias("there")), "rel", "left")
    status = F.when(P.escapes(F.col("rel")), "illegal").when((F.col("there") == F.col("size")) & (F.col("there") > 0), "exists").otherwise("copy")
    return rows.select("id", "rel", "size", status.alias("status"))


def copy_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def manifest(marked: DataFrame, folders: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """(no, folder, name, mark, export_status, size_mb) of in_scope() in export order."""
    rows = numbered(marked.select(*ORDER, "name", "decision", "size"), *ORDER)
    rows = rows.join(folders.select(F.col("id").alias("folder_id"), F.col("rel_path").alias("folder")), "folder_id")
    state = F.lit("")
    if status is not None:
        rows = rows.join(status.select("id", F.col("status").alias("state")), "id", "left")
        state = F.coalesce("state", F.lit(""))
    return rows.select("no", P.csv_safe(F.col("folder")).alias("folder"), P.csv_safe(F.col("name")).alias("name"), V.decision_text(F.col("decision"), "未标记").alias("mark"), state.alias("export_status"), V.megabytes(F.col("size")).alias("size_mb"))


def manifest_summary(marked: DataFrame) -> DataFrame:
    keep = F.col("decision") == S.KEEP
    return marked.agg(
        F.count_if(keep).alias("keep"), F.count_if(F.col("decision") == S.REJECT).alias("reject"), F.count_if(F.col("decision") == S.PENDING).alias("unmarked"),
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.when(keep, F.col("size"))), F.lit(0)).alias("kept_bytes"),
    )


def issues(files: DataFrame, qc: DataFrame, reviews: DataFrame, folders: DataFrame, version: int) -> DataFrame:
    """(id, rel_path, name, issues, mark) of present files of the folders with flags of this version."""
    found = qc.where((F.col("flags") != 0) & (F.col("qc_version") == version)).select(F.col("file_id").alias("id"), "flags", "detail")
    rows = in_scope(files, reviews, folders).join(found, "id")
    return rows.select("id", "rel_path", "name", F.concat_ws("、", V.issue_texts(F.col("flags"), F.col("detail"))).alias("issues"), V.decision_text(F.col("decision")).alias("mark"))


def review_list(reviews: DataFrame, files: DataFrame) -> DataFrame:
    """(rel_path, decision, decision_text, reviewer, updated_at) of marks whose file is in the catalog; updated_at is local time, '' if unknown."""
    when = F.when(F.col("updated_at") > 0, F.date_format(F.timestamp_seconds("updated_at"), "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit(""))
    rows = reviews.join(files.select(F.col("id").alias("file_id"), "rel_path"), "file_id")
    return rows.select(P.csv_safe(F.col("rel_path")).alias("rel_path"), "decision", V.decision_text(F.col("decision")).alias("decision_text"), P.csv_safe(F.col("reviewer")).alias("reviewer"), when.alias("updated_at"))
