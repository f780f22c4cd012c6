"""What to render and transcode, and how far that is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import paths as P
from lumaframe.functions import values as V

# What browsers play as it is.
PLAYABLE = ("h264", "avc1", "vp8", "vp9", "av1", "theora")
PLAYABLE_AUDIO = ("", "aac", "mp3", "opus")


def preview_plan(probe: DataFrame, short_side: int = 1600) -> DataFrame:
    """(file_id, w, h, need): size of the preview; orientations 5 to 8 turn the image first."""
    turned = F.col("orientation").between(5, 8)
    w, h = F.when(turned, F.col("h")).otherwise(F.col("w")), F.when(turned, F.col("w")).otherwise(F.col("h"))
    return probe.select("file_id", V.fitted(w, h, short_side).alias("s")).select("file_id", "s.w", "s.h", "s.need")


def playable(codec, acodec):
    return F.lower(codec).isin(*PLAYABLE) & F.lower(F.coalesce(acodec, F.lit(""))).isin(*PLAYABLE_AUDIO)


def transcode_plan(probe: DataFrame, short_side: int = 720) -> DataFrame:
    """(file_id, playable, w, h): even sizes for what cannot be played, the source's for what can."""
    rows = probe.withColumn("playable", playable(F.col("codec"), F.col("acodec"))).withColumn("s", V.fitted(F.col("w"), F.col("h"), short_side, even=True))
    return rows.select("file_id", "playable", F.when(F.col("playable"), F.col("w")).otherwise(F.col("s.w")).alias("w"), F.when(F.col("playable"), F.col("h")).otherwise(F.col("s.h")).alias("h"))


def derivative_status(videos: DataFrame, probe: DataFrame, artifacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """(file_id, status) in order of precedence: failed probe, skipped as playable, done, the job's state, pending."""
    rows = videos.select(F.col("id").alias("file_id")).join(probe.select("file_id", "ok", "codec", "acodec"), "file_id", "left")
    rows = rows.join(artifacts.select("file_id").distinct().withColumn("made", F.lit(True)), "file_id", "left").join(jobs.select("file_id", "job"), "file_id", "left")
    status = (
        F.when(~F.col("ok"), "failed")
        .when(F.col("ok") & playable(F.col("codec"), F.col("acodec")), "skipped")
        .when(F.col("made"), "done")
        .when(F.col("job").isNotNull(), F.col("job"))
        .otherwise("pending")
    )
    return rows.select("file_id", status.alias("status"))


def tally(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def processed(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """FILE rows with processed raised to 1 where an artifact exists; it never falls back."""
    made = artifacts.select(F.col("file_id").alias("id")).distinct().withColumn("made", F.lit(1))
    return files.join(made, "id", "left").withColumn("processed", F.greatest("processed", F.coalesce("made", F.lit(0)))).select(*files.columns)


def cache_keys(files: DataFrame, tag: str, ext: str = "mp4") -> DataFrame:
    key = P.cache_key(F.col("rel_path"), F.col("size"), F.col("mtime"), tag)
    return files.select("id", key.alias("cache_key"), P.cache_path(key, ext).alias("cache_path"))
