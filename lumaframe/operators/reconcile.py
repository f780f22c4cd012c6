"""Verdicts cross-checked between photos of one camera: bursts and lens dirt.

A camera can own most of a library, so sessions are found per (device, day) after one shuffle: a session that runs over
midnight is joined to the next day's first one by comparing only the days' edges. Lens dirt compares distinct boxes of a
device (a box sits on an 8 by 8 grid, so there are at most 784), never files with files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.functions import values as V


def timed(qc: DataFrame, normalize_exif: bool = False) -> DataFrame:
    """(file_id, device, h, t) of what can be in a burst: known device, not corrupt, a hash and a readable time."""
    rows = qc.select("file_id", "device", "flags", V.hash_long(F.col("dup_hash")).alias("h"), F.unix_timestamp(V.shoot_time(F.col("shoot_key"), normalize_exif)).alias("t"))
    return rows.where((F.col("device") != "") & ~V.has(F.col("flags"), S.CORRUPTED) & F.col("h").isNotNull() & F.col("t").isNotNull()).drop("flags")


def bursts(qc: DataFrame, gap_s: int = S.BURST_GAP_S, normalize_exif: bool = False) -> DataFrame:
    """(file_id, device, h, t, start): start is the time of the first photo of the chain whose steps are at most gap_s."""
    rows = timed(qc, normalize_exif).withColumn("day", F.floor(F.col("t") / 86400))
    own = Window.partitionBy("device", "day").orderBy("t", "file_id")
    rows = rows.withColumn("new", F.coalesce(F.col("t") - F.lag("t").over(own) > gap_s, F.lit(True)))
    rows = rows.withColumn("start", F.max(F.when(F.col("new"), F.col("t"))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # days are few: find how far back the session reaches with which each day begins
    edges = rows.groupBy("device", "day").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max("start").alias("last_start"))
    days = Window.partitionBy("device").orderBy("day")
    linked = (F.col("day") == F.lag("day").over(days) + 1) & (F.col("first") - F.lag("last").over(days) <= gap_s)
    edges = edges.withColumn("linked", F.coalesce(linked, F.lit(False)))
    edges = edges.withColumn("before", F.lag("last_start").over(days)).withColumn("whole", F.col("last_start") == F.col("first"))
    # a day that is one session passes on where it began itself: take the nearest earlier day that ends a chain of such days
    edges = edges.withColumn("through", F.lag(F.col("whole") & F.col("linked")).over(days))
    anchor = F.when(F.col("linked") & ~F.coalesce("through", F.lit(False)), F.col("before")).when(~F.col("linked"), F.lit(None))
    edges = edges.withColumn("anchor", F.last(anchor, ignorenulls=True).over(days.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    heads = edges.where("linked").select("device", "day", F.col("first").alias("head"), "anchor")
    joined = rows.join(heads, ["device", "day"], "left")
    return joined.select("file_id", "device", "h", "t", F.when(F.col("start") == F.col("head"), F.col("anchor")).otherwise(F.col("start")).alias("start"))


def burst_clusters(qc: DataFrame, **options) -> DataFrame:
    """(file_id, device, start, anchor_id, members) of chains of two photos and more."""
    rows = bursts(qc, **options)
    groups = rows.groupBy("device", "start").agg(F.min("file_id").alias("anchor_id"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return rows.join(groups, ["device", "start"]).select("file_id", "device", "start", "anchor_id", "members", "h")


def burst_pairs(qc: DataFrame, most: int = S.MAX_HAMMING, **options) -> DataFrame:
    """(file_id, anchor_id, distance): photos near the first file of their burst."""
    rows = burst_clusters(qc, **options)
    heads = rows.where("file_id = anchor_id").select("anchor_id", F.col("h").alias("anchor_h"))
    near = rows.where("file_id <> anchor_id").join(heads, "anchor_id").withColumn("distance", V.hamming(F.col("h"), F.col("anchor_h")))
    return near.where(F.col("distance") <= most).select("file_id", "anchor_id", "distance")


def unconfirmed_dirt(qc: DataFrame) -> DataFrame:
    """(file_id): files of a device with three or more sound ones whose lens dirt no other sound file of it confirms."""
    sound = qc.where((F.col("device") != "") & ~V.has(F.col("flags"), S.CORRUPTED))
    boxes = sound.select("file_id", "device", F.explode(V.parsed_detail(F.col("detail"))["lensDirt"]["boxes"]).alias("box"))
    kinds = boxes.groupBy("device", "box").agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi"))
    other = kinds.select("device", F.col("box").alias("box_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    # boxes of one device against each other: both sides have one row per distinct box
    near = kinds.join(other, "device").where(V.iou(F.col("box"), F.col("box_b")) >= S.MIN_IOU)
    met = near.groupBy("device", "box").agg(F.min("lo_b").alias("lo"), F.max("hi_b").alias("hi"))
    confirmed = boxes.join(met, ["device", "box"]).where((F.col("lo") != F.col("file_id")) | (F.col("hi") != F.col("file_id"))).select("file_id").distinct()
    groups = sound.groupBy("device").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= S.DIRT_MIN_GROUP).select("device")
    flagged = sound.where(V.has(F.col("flags"), S.LENS_DIRT)).select("file_id", "device")
    with_boxes = boxes.select("file_id").distinct()
    return flagged.join(groups, "device", "left_semi").join(with_boxes, "file_id", "left_semi").join(confirmed, "file_id", "left_anti").select("file_id")


def reconciled(qc: DataFrame, version: int, diffs: DataFrame | None = None, dup_sim: float = 0.95, **options) -> DataFrame:
    """(file_id, old_flags, new_flags) of the files whose flags change.

    Burst partners get the duplicate bit, unconfirmed dirt loses its bit; then pairs that pixels (file_id, other_id, diff) tell
    apart lose the duplicate bit, even one set before. A pair without a comparison keeps it.
    """
    current = qc.where(F.col("qc_version") == version)
    pairs = burst_pairs(current, **options)
    add = pairs.select("file_id", F.lit(S.DUP).alias("add"))
    if diffs is not None:
        apart = pairs.join(diffs.select("file_id", F.col("other_id").alias("anchor_id"), "diff"), ["file_id", "anchor_id"]).where(F.col("diff") > 1 - dup_sim)
        apart = apart.select("file_id", F.lit(True).alias("apart"))
    dirt = unconfirmed_dirt(current).select("file_id", F.lit(S.LENS_DIRT).alias("clear"))
    rows = current.select("file_id", "flags").join(add, "file_id", "left").join(dirt, "file_id", "left")
    new = V.set_then_clear(F.col("flags"), F.coalesce("add", F.lit(0)), F.coalesce("clear", F.lit(0)))
    if diffs is not None:
        rows = rows.join(apart, "file_id", "left")
        new = F.when(F.coalesce("apart", F.lit(False)), new.bitwiseAND(~S.DUP)).otherwise(new)
    return rows.select("file_id", F.col("flags").alias("old_flags"), new.alias("new_flags")).where("old_flags <> new_flags")
