"""From metrics to flags: images, votes of video frames, camera shake, and stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.functions import values as V
from lumaframe.schemas import Thresholds


def work_list(files: DataFrame, qc: DataFrame, version: int) -> DataFrame:
    """Files without a result of this version for their size and time."""
    done = qc.where(F.col("qc_version") == version).select(F.col("file_id").alias("id"), "size", "mtime")
    return files.join(done, ["id", "size", "mtime"], "left_anti").select(*files.columns)


def decoded(qc: DataFrame) -> DataFrame:
    """(file_id, one boolean per bit from the flags column, boxes, under, over): the detail gives boxes and direction only."""
    detail = V.parsed_detail(F.col("detail"))
    names = {"dup": S.DUP, "corrupted": S.CORRUPTED, "blank": S.BLANK, "lens_dirt": S.LENS_DIRT, "blur": S.BLUR, "exposure": S.EXPOSURE, "noise": S.NOISE, "shake": S.SHAKE, "ai": S.AI_SUSPECT}
    return qc.select(
        "file_id", *[V.has(F.col("flags"), bit).alias(n) for n, bit in names.items()], detail["lensDirt"]["boxes"].alias("boxes"),
        F.coalesce(detail["exposure"]["under"], F.lit(False)).alias("under"), F.coalesce(detail["exposure"]["over"], F.lit(False)).alias("over"),
    )


def under(mean: Column, low: Column, t: Thresholds) -> Column:
    return (mean < t.exp_under) & (low > S.CLIP_LOW_SHARE)


def over(mean: Column, high: Column, t: Thresholds) -> Column:
    return (mean > t.exp_over) & (high > S.CLIP_HIGH_SHARE)


def _bit(hit: Column, bit: int) -> Column:
    return F.when(hit, F.lit(bit)).otherwise(F.lit(0))


def image_flags(corrupted: Column, gray_std: Column, mean: Column, low: Column, high: Column, lap_std: Column, noise: Column, dirty: Column, t: Thresholds) -> Column:
    """A corrupted file has that bit alone; a blank one is not called blurred."""
    blank = gray_std < t.blank_std
    bits = (
        _bit(blank, S.BLANK) + _bit(dirty, S.LENS_DIRT) + _bit(~blank & (lap_std < t.blur_lap_std), S.BLUR)
        + _bit(under(mean, low, t) | over(mean, high, t), S.EXPOSURE) + _bit(noise > t.noise_floor, S.NOISE)
    )
    return F.when(corrupted, F.lit(S.CORRUPTED)).otherwise(bits).cast("int")


def image_verdicts(metrics: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """metrics (file_id and METRICS) with flags and a detail struct that holds only what is set."""
    c = F.col
    flags = image_flags(c("corrupted"), c("gray_std"), c("exp_mean"), c("clip_low"), c("clip_high"), c("lap_std"), c("noise_floor"), F.size("dirt_boxes") > 0, t)
    rows = metrics.withColumn("flags", flags)

    def when(bit: int, value: Column) -> Column:
        return F.when(V.has(c("flags"), bit), value)

    conf = lambda x: F.struct(x.alias("conf"))
    detail = F.struct(
        c("flags").alias("flags"), F.when(~c("corrupted"), c("dup_hash")).alias("dupHash"), when(S.BLANK, conf(c("gray_std"))).alias("blank"),
        when(S.LENS_DIRT, F.struct(c("dirt_conf").alias("conf"), c("dirt_boxes").alias("boxes"))).alias("lensDirt"),
        F.when(c("corrupted"), F.lit(True)).alias("corrupted"), when(S.BLUR, conf(c("lap_std"))).alias("blur"),
        when(S.EXPOSURE, F.struct(under(c("exp_mean"), c("clip_low"), t).alias("under"), over(c("exp_mean"), c("clip_high"), t).alias("over"),
                                  c("exp_mean").alias("mean"), c("clip_low").alias("clipLow"), c("clip_high").alias("clipHigh"))).alias("exposure"),
        when(S.NOISE, conf(c("noise_floor"))).alias("noise"),
    )
    return rows.withColumn("detail", V.detail_json(detail))


def every(n: int) -> Column:
    return F.col("frame_idx") % n == 0


def video_votes(hits: DataFrame) -> DataFrame:
    """(file_id, shares, flags, under, dirt_frame, dup_hash) from frames (file_id, frame_idx, blank, dirt, under, over, blur, noise, dup_hash).

    A bit is set when more than VOTE_SHARE of the sampled frames have it: all frames, or every fifth for blur and noise. Where under-
    and over-exposed frames are as many, under wins. The boxes are those of the last frame with dirt, the hash that of the first frame.
    """
    sampled = every(S.COSTLY_EVERY)

    def share(hit: Column, among: Column | None = None) -> Column:
        value = F.when(hit, 1.0).otherwise(0.0)
        return F.coalesce(F.avg(value if among is None else F.when(among, value)), F.lit(0.0))

    votes = hits.groupBy("file_id").agg(
        share(F.col("blank")).alias("blank"), share(F.col("dirt")).alias("dirt"), share(F.col("under") | F.col("over")).alias("exposure"),
        share(F.col("blur") & ~F.col("blank"), sampled).alias("blur"), share(F.col("noise"), sampled).alias("noise"),
        (F.count_if("under") >= F.count_if("over")).alias("under"),
        F.max(F.when(F.col("dirt"), F.col("frame_idx"))).alias("dirt_frame"), F.min_by("dup_hash", "frame_idx").alias("dup_hash"),
    )
    flags = sum((_bit(F.col(n) > S.VOTE_SHARE, b) for n, b in (("blank", S.BLANK), ("dirt", S.LENS_DIRT), ("exposure", S.EXPOSURE), ("blur", S.BLUR), ("noise", S.NOISE))), F.lit(0))
    return votes.withColumn("flags", flags.cast("int"))


def with_corrupted(files: DataFrame, votes: DataFrame) -> DataFrame:
    """(file_id, flags): files without any frame are corrupted and nothing else."""
    return files.select(F.col("id").alias("file_id")).join(votes.select("file_id", "flags"), "file_id", "left").select("file_id", F.coalesce("flags", F.lit(S.CORRUPTED)).alias("flags"))


def shake(shifts: DataFrame, most_distance: float = 25.0, least_frames: int = 8, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """(file_id, frames, amp, flip_rate, shake) from (file_id, frame_idx, dy, dx, dist): the shift of a frame against the one before.

    Where the frames do not match (a cut) the last shift is carried on. A flip is a change of sign of the step on either axis.
    """
    own = Window.partitionBy("file_id").orderBy("frame_idx")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    usable = F.when((F.col("dist") <= most_distance) & (F.col("frame_idx") > 0), F.struct("dy", "dx"))
    rows = shifts.withColumn("off", F.coalesce(F.last(usable, ignorenulls=True).over(so_far), F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"))))
    rows = rows.withColumn("vy", F.col("off.dy") - F.lag("off.dy").over(own)).withColumn("vx", F.col("off.dx") - F.lag("off.dx").over(own))
    rows = rows.withColumn("flip", (F.col("vy") * F.lag("vy").over(own) < 0) | (F.col("vx") * F.lag("vx").over(own) < 0))

    def upper_median(v: str) -> Column:
        steps = F.sort_array(F.collect_list(F.abs(v)))  # one clip's steps: two a second
        return F.coalesce(F.get(steps, F.floor(F.size(steps) / 2).cast("int")), F.lit(0))

    found = rows.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("frames"), F.greatest(upper_median("vy"), upper_median("vx")).cast("double").alias("amp"), F.count_if("flip").alias("flips"), F.count("vy").alias("steps")
    )
    rate = F.when(F.col("steps") > 1, F.col("flips") / (F.col("steps") - 1)).otherwise(F.lit(0.0))
    hit = (F.col("frames") >= least_frames) & (F.col("amp") > t.shake_rms) & (rate > 0.5)
    return found.select("file_id", "frames", "amp", rate.alias("flip_rate"), hit.alias("shake"))


def ai_frames(images: DataFrame) -> DataFrame:
    """The rows that ai_votes() looks at, for a scorer to be spared the others; a file's first AI_FRAMES are known only when all are scored."""
    return images.where(every(S.AI_EVERY))


def ai_votes(scores: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """(file_id, blur, noise, dirt, suspect): mean over the first AI_FRAMES of every AI_EVERY-th frame."""
    own = Window.partitionBy("file_id").orderBy("frame_idx")
    few = scores.where(every(S.AI_EVERY)).withColumn("n", F.row_number().over(own)).where(F.col("n") <= S.AI_FRAMES)
    mean = few.groupBy("file_id").agg(*[F.avg(c).alias(c) for c in ("blur", "noise", "dirt")])
    return mean.withColumn("suspect", (F.col("blur") > t.ai_blur) | (F.col("noise") > t.ai_noise) | (F.col("dirt") > t.ai_dirt))


def saved(old: DataFrame, new: DataFrame) -> DataFrame:
    """QC rows after an upsert by file_id; a new row without a detail becomes an empty one."""
    rows = new.withColumn("flags", F.coalesce("flags", F.lit(0))).withColumn("detail", F.coalesce("detail", F.lit("")))
    return old.join(new.select("file_id"), "file_id", "left_anti").unionByName(rows)


def updated_flags(qc: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_id, old_flags, new_flags) of the given (file_id, flags) that differ from what is stored."""
    new = changes.select("file_id", F.col("flags").alias("new_flags"))
    return qc.select("file_id", F.col("flags").alias("old_flags")).join(new, "file_id").where("old_flags <> new_flags")
