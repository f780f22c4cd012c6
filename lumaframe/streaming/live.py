"""Structured Streaming twins: windows, ingest and sinks; stateful operators are in state.py. Watermarks and what is late are this library's choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.functions import paths as P
from lumaframe.operators.frames import METRIC_NAMES, frame_features, shifts
from lumaframe.streaming.replay import outcomes
from lumaframe.streaming.state import keyed, stale_alerts
from lumaframe.streaming.table_log import add_into, current, upsert_into, version

__all__ = ["keyed", "stale_alerts", "current", "upsert_into"]


def expanded_activity(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Activity of a user becomes one event per folder the user holds; for use inside foreachBatch, where claims is a table."""
    own = claims.select(F.col("folder_id").alias("held"), "user_name")
    acts = events.where("op = 'activity'").join(own, "user_name").withColumn("folder_id", F.col("held")).select(*events.columns)
    return events.where("op <> 'activity'").unionByName(acts)


def active_users(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """(window, users): how many names were seen in the last five minutes, every ten seconds, exactly; events: ts, user_name.

    Names are counted once a window by a first aggregation, whose state is a row for each name and window.
    """
    names = events.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes", "10 seconds").alias("window"), "user_name").agg(F.count(F.lit(1)).alias("n"))
    return names.groupBy("window").agg(F.count(F.lit(1)).alias("users"))


def marks_per_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(window, user_name, decision, n); events: ts, user_name, decision. Later events than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "user_name", "decision").agg(F.count(F.lit(1)).alias("n"))


def burst_sessions(photos: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(session_window, device, anchor_id, members); photos: ts in whole seconds, device, file_id.

    Times are whole seconds, so a gap of two and a half seconds parts what is three away and keeps what is two away.
    """
    return photos.withWatermark("ts", late).groupBy(F.session_window("ts", "2500 milliseconds"), "device").agg(F.min("file_id").alias("anchor_id"), F.count(F.lit(1)).alias("members"))


def once_a_second(notes: DataFrame, late: str = "5 seconds") -> DataFrame:
    """(window, n): one row for each second with notes."""
    return notes.withWatermark("ts", late).groupBy(F.window("ts", "1 second")).agg(F.count(F.lit(1)).alias("n"))


def new_only(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """Files (ts, rel_path, size, mtime) that were not seen within the watermark."""
    return files.withWatermark("ts", late).dropDuplicatesWithinWatermark(["rel_path", "size", "mtime"])


def store_marks(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for keyed(events, "lock", "folder_id"): outcomes of the marks, and the last decision of each file.

    The stream's state is who holds each folder; decisions are read from and kept in the table current(spark, path + "/marks").
    Outcomes of batch n lie in path/outcomes/batch=n.
    """

    def write(batch: DataFrame, number: int) -> None:
        stored = current(batch.sparkSession, f"{path}/marks")
        batch.persist()
        rows = outcomes(batch, stored)
        if version(batch.sparkSession, f"{path}/marks") < number:  # else the table holds this batch already, and so do its outcomes
            rows.write.mode("overwrite").parquet(f"{path}/outcomes/batch={number}")
            kept = rows.where("outcome <> 'blocked'").select("file_id", "decision", "user_name", F.struct("ts_ms", "seq").alias("at"))
            upsert_into(f"{path}/marks", ["file_id"], "at")(kept, number)
        batch.unpersist()

    return write


def mark_changes(decided: DataFrame, folders: DataFrame) -> DataFrame:
    """(rel_path, keep, reject) by which the marks of state.decisions() change the counts of each folder and of all above it.

    A changed mark takes its file out of the count that it was in and adds it to the other; what stays or is blocked changes nothing.
    Marks are added up per folder before its ancestors are named, so an ancestor gets a row for each folder that changed.
    """
    of = lambda column, code: F.when(F.col(column) == code, 1).otherwise(0)
    own = decided.where("outcome = 'changed'").groupBy("folder_id").agg(
        F.sum(of("decision", S.KEEP) - of("before", S.KEEP)).alias("keep"), F.sum(of("decision", S.REJECT) - of("before", S.REJECT)).alias("reject")
    )
    paths = own.join(folders.select(F.col("id").alias("folder_id"), "rel_path"), "folder_id")
    up = paths.select(F.explode(F.array_union(P.ancestors(F.col("rel_path")), F.array("rel_path"))).alias("rel_path"), "keep", "reject")
    return up.groupBy("rel_path").agg(F.sum("keep").alias("keep"), F.sum("reject").alias("reject"))


def count_marks(path: str, folders: DataFrame) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for state.decisions(): keeps the counts of every folder's subtree up, a few changed rows a batch."""
    add = add_into(path, ["rel_path"], ["keep", "reject"])
    return lambda batch, number: add(mark_changes(batch, folders), number)


def tree_now(tree: DataFrame, path: str) -> DataFrame:
    """The tree of stats.tree_counts() as it was when the stream began, with what count_marks(path) has changed since."""
    changed = current(tree.sparkSession, path)
    if changed is None:
        return tree
    changed = changed.select("rel_path", F.col("keep").alias("_keep"), F.col("reject").alias("_reject"))
    now = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
    rows = tree.join(changed, "rel_path", "left").select("id", "parent_id", "name", "rel_path", "depth", "total", now("keep"), now("reject"), "has_children")
    return rows.withColumn("pending", F.col("total") - F.col("keep") - F.col("reject")).select(*tree.columns)


def file_results(metrics: DataFrame, shaking: DataFrame) -> DataFrame:
    """(file_id, frames, flags, METRICS of the first frame) from frame_metrics() of whole files and verdict.shake() of them.

    A file of one frame is judged like an image; of several like a clip: by the share of frames with each fault, and shake.
    """
    from lumaframe.operators import verdict

    judged = verdict.image_verdicts(metrics)
    has = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    t = S.Thresholds()
    hits = judged.where("not corrupted").select(
        "file_id", "frame_idx", has(S.BLANK).alias("blank"), has(S.LENS_DIRT).alias("dirt"), has(S.BLUR).alias("blur"), has(S.NOISE).alias("noise"), "dup_hash",
        verdict.under(F.col("exp_mean"), F.col("clip_low"), t).alias("under"), verdict.over(F.col("exp_mean"), F.col("clip_high"), t).alias("over"),
    )
    votes = verdict.video_votes(hits).select("file_id", F.col("flags").alias("voted"))
    shaken = shaking.where("shake").select("file_id", F.lit(S.SHAKE).alias("shaken"))
    first = judged.groupBy("file_id").agg(F.count(F.lit(1)).alias("frames"), F.min_by(F.struct("flags", *METRIC_NAMES), "frame_idx").alias("first"))
    rows = first.join(votes, "file_id", "left").join(shaken, "file_id", "left")
    clip = F.coalesce("voted", F.lit(S.CORRUPTED)).bitwiseOR(F.coalesce("shaken", F.lit(0)))
    flags = F.when(F.col("frames") > 1, clip).otherwise(F.col("first.flags")).cast("int")
    return rows.select("file_id", "frames", flags.alias("flags"), *[F.col(f"first.{c}") for c in METRIC_NAMES])


def _stored_results(features: DataFrame, facts: DataFrame, stored: str, qc_version: int, number: int) -> None:
    """Judges whole files by their features, with the size and mtime in facts, and stores the results."""
    from lumaframe.operators import verdict

    found = file_results(features, verdict.shake(shifts(features.select("file_id", "frame_idx", "rows", "cols"))))
    rows = found.join(facts, "file_id").withColumn("qc_version", F.lit(qc_version)).withColumn("batch", F.lit(number).cast("long"))
    upsert_into(stored, ["file_id"], "batch")(rows, number)


def ingest(stored: str, qc_version: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that measures new frames (FRAME rows with size and mtime) and stores what it makes of each file so far.

    The features of all frames are kept in the table stored + "/frames", so a clip whose frames come in several batches is judged by
    all that have come. Frames that were measured before with the same size, mtime and version are passed over; with another, the
    file's earlier frames no longer count.
    """
    frames = f"{stored}/frames"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if version(spark, stored) >= number:
            return
        files = batch.select("file_id", "size", "mtime").distinct()
        fresh = batch
        done = current(spark, frames)
        same = ["file_id", "size", "mtime"]
        if done is not None and version(spark, frames) < number:
            fresh = batch.join(done.where(F.col("qc_version") == qc_version).select(*same, "frame_idx"), [*same, "frame_idx"], "left_anti")
        if version(spark, frames) < number:
            features = frame_features(fresh, S.COSTLY_EVERY, ["size", "mtime"]).withColumn("qc_version", F.lit(qc_version)).withColumn("batch", F.lit(number).cast("long"))
            upsert_into(frames, ["file_id", "frame_idx"], "batch")(features, number)
        known = current(spark, frames).where(F.col("qc_version") == qc_version)
        changed = known.where(F.col("batch") == number).select(*same).distinct()
        _stored_results(known.join(files.join(changed, same, "left_semi"), same, "left_semi"), changed, stored, qc_version, number)

    return write


def ingest_clips(stored: str, qc_version: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for state.clips(): stores the results of clips, with how many frames there were and whether these were all."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        facts = batch.groupBy("file_id").agg(F.max(F.struct("mtime", "size", "complete")).alias("f")).select("file_id", "f.size", "f.mtime", "f.complete")
        last = batch.join(facts, ["file_id", "size", "mtime", "complete"], "left_semi")
        _stored_results(last, facts, stored, qc_version, number)
        batch.unpersist()

    return write
