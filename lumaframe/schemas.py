"""Schemas, codes, constants and thresholds of the media catalog."""

from __future__ import annotations

import struct
from dataclasses import asdict, astuple, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

FOLDER = "id long, parent_id long, name string, rel_path string, depth int"
FILE = "id long, folder_id long, name string, sort_key string, rel_path string, ext string, size long, mtime long, kind int, present int, processed int"
REVIEW = "file_id long, decision int, reviewer string, updated_at long"
CLAIM = "folder_id long, user_name string, claimed_at long"
QC = "file_id long, flags int, detail string, dup_hash string, device string, shoot_key string, size long, mtime long, qc_version int, updated_at long"
KNOWN_USER = "name string, last_used long"
FRAME = "file_id long, frame_idx int, w int, h int, gray binary"
AUDIT = "ts string, ip string, user string, action string, result string, ua string, _corrupt_record string"
BOX = "struct<x: double, y: double, w: double, h: double>"
DETAIL = (
    f"flags int, dupHash string, blank struct<conf: double>, lensDirt struct<conf: double, boxes: array<{BOX}>>, corrupted boolean, "
    "blur struct<conf: double>, exposure struct<under: boolean, over: boolean, mean: double, clipLow: double, clipHigh: double>, "
    "noise struct<conf: double>, shake struct<amp: double>, ai struct<scores: struct<blur: double, noise: double, dirt: double>, patches: int>"
)
METRICS = (
    f"corrupted boolean, gray_std double, exp_mean double, clip_low double, clip_high double, lap_std double, noise_floor double, "
    f"dirt_conf double, dirt_boxes array<{BOX}>, dup_hash string"
)

# Codes of kinds, decisions and detector bits.
OTHER, IMAGE, VIDEO = 0, 1, 2
PENDING, KEEP, REJECT = 0, 1, 2
DUP, CORRUPTED, BLANK, LENS_DIRT, BLUR, EXPOSURE, NOISE, SHAKE, AI_SUSPECT = (1 << k for k in range(9))
ISSUES = CORRUPTED | BLANK | LENS_DIRT | BLUR | EXPOSURE | NOISE | SHAKE | AI_SUSPECT

# Sizes, limits and gaps of the detectors.
GRAY_SIDE = 64
DETAIL_SIDE = 1024
NOISE_CELL = 16
FRAMES_PER_SECOND = 2
COSTLY_EVERY = 5
AI_EVERY, AI_FRAMES = 100, 5
VOTE_SHARE = 0.3
MAX_HAMMING = 5
PIXEL_DELTA = 25
DUP_DIFF_VIDEO = 0.0
DUP_WINDOW_S = 10
BURST_GAP_S = 2
MIN_IOU = 0.5
DIRT_MIN_GROUP = 3
CLIP_LOW_SHARE, CLIP_HIGH_SHARE = 0.35, 0.80
DARK, BRIGHT = 8, 247
DUP_CANDIDATES = 20
STALE_MS = 30 * 60 * 1000
ACTIVE_MS = 5 * 60 * 1000
ALGORITHM_VERSION = 5

# The extensions of the format registry, by decoder.
PLAIN_IMAGES = "jpg jpeg png gif bmp webp tif tiff ico dds tga ppm pgm pbm sgi pcx xbm xpm sun dpx exr"
VIDEOS = "mp4 mov avi mkv webm m4v mpg mpeg ts flv mts m2ts mxf vob wmv asf 3gp ogv f4v m2v"
RAW_IMAGES = "cr2 cr3 nef arw dng raf rw2 orf srw pef mrw erf sr2 kdc dcr rwz heic heif avif jxl psd"


def formats(spark: SparkSession) -> DataFrame:
    """The registry (ext, kind, decoder, previewable): 62 rows, so joins broadcast it."""
    groups = ((PLAIN_IMAGES, IMAGE, "ffmpeg"), (VIDEOS, VIDEO, "ffmpeg"), (RAW_IMAGES, IMAGE, "magick"))
    rows = [(f".{ext}", kind, decoder, True) for names, kind, decoder in groups for ext in names.split()]
    return spark.createDataFrame(rows, "ext string, kind int, decoder string, previewable boolean")


@dataclass(frozen=True)
class Thresholds:
    blur_lap_std: float = 15.0
    noise_floor: float = 5.0
    blank_std: float = 8.0
    exp_under: float = 100.0
    exp_over: float = 150.0
    shake_rms: float = 1.5
    dup_sim: float = 0.95
    ai_blur: float = 0.86
    ai_noise: float = 0.29
    ai_dirt: float = 0.66


# The least and greatest setting of each threshold.
LIMITS = {
    "blur_lap_std": (5, 60), "noise_floor": (1, 20), "blank_std": (2, 30), "exp_under": (30, 160), "exp_over": (90, 220),
    "shake_rms": (0.3, 6), "dup_sim": (0.5, 1), "ai_blur": (0.05, 0.99), "ai_noise": (0.05, 0.99), "ai_dirt": (0.05, 0.99),
}


def clamped(t: Thresholds) -> Thresholds:
    return replace(t, **{k: float(min(max(v, LIMITS[k][0]), LIMITS[k][1])) for k, v in asdict(t).items()})


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def version(t: Thresholds, ai_model: str | None = None) -> int:
    """The fingerprint under which results are stored; ai_model is the model's hash if scoring is on."""
    found = ALGORITHM_VERSION
    if t != Thresholds():
        found += fnv1a(struct.pack(f"<{len(fields(t))}d", *astuple(t))) % 1_000_000_000
        found += found == ALGORITHM_VERSION
    if ai_model is None:
        return found
    return 1_000_000_001 + fnv1a(struct.pack("<Q", found) + b"ai-on" + ai_model.encode()) % 999_999_999
