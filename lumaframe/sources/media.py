"""Reading media trees, images, capture data, catalog tables and the audit log."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.functions import values as V
from lumaframe.operators.frames import to_gray

HEAD = 256 * 1024


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of all files below root; the contents are not read. Spark passes over names that start with '_'."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/") + "/")
    path = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?/+", "/")
    return files.select("length", "modificationTime", path.alias("p")).select(
        F.when(F.col("p").startswith(base), F.expr(f"substring(p, {len(root.rstrip('/')) + 2})")).otherwise(F.col("p")).alias("path"),
        F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"),
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, frame_idx, w, h, gray) of images the JVM can decode; gray is NULL for a broken one."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for origin, height, width, n, data in part.itertuples(index=False):
                gray = None
                if height > 0:
                    x = np.frombuffer(data, np.uint8).reshape(height, width, n)
                    gray = (x[..., 0] if n == 1 else to_gray(x[..., 2::-1])).tobytes()  # stored as BGR
                out.append((origin, 0, max(width, 0), max(height, 0), gray))
            yield pd.DataFrame(out, columns=["origin", "frame_idx", "w", "h", "gray"])

    return raw.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "origin string, frame_idx int, w int, h int, gray binary")


Rasters = np.ndarray | Iterable[np.ndarray] | None


def decode(files: DataFrame, decoder: Callable[[bytes], Rasters]) -> DataFrame:
    """(path, frame_idx, n_frames, w, h, gray) of files (path, content) by a decoder for formats the JVM cannot read.

    It returns one raster or the rasters of a clip one after the other. A file that it cannot decode, or not to its end, is left out;
    it is not called corrupted. A task holds the frames of one file.
    """

    def of(content: bytes) -> list[np.ndarray]:
        found = decoder(content)
        return [] if found is None else [found] if isinstance(found, np.ndarray) else [*found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "frame_idx", "n_frames", "w", "h", "gray"]
        for part in batches:
            for path, content in part.itertuples(index=False):
                try:
                    rasters = of(content)
                except Exception:  # whatever a foreign decoder raises about one file
                    rasters = []
                yield pd.DataFrame([(path, k, len(rasters), r.shape[1], r.shape[0], r.astype(np.uint8).tobytes()) for k, r in enumerate(rasters)], columns=columns)

    return files.select("path", "content").mapInPandas(run, "path string, frame_idx int, n_frames int, w int, h int, gray binary")


#: Frames of one clip that stay in one task.
FRAME_RANGE = 64
# The magic word of a YUV4MPEG2 file and of each of its frames, and its colour spaces of one byte a sample.
Y4M, Y4M_FRAME = "YUV4MPEG2", "FRAME\n"
Y4M_420, Y4M_422, Y4M_444, Y4M_MONO = ("", "420", "420jpeg", "420mpeg2", "420paldv"), ("422",), ("444",), ("mono",)


def y4m_frames(files: DataFrame, per_second: float | None = None) -> DataFrame:
    """The columns of files (path, content, and more) but content, with frame_idx, n_frames, w, h, gray for each frame of a YUV4MPEG2 clip.

    All in Spark's own functions: the header gives the size of a frame, so its luma is a substring of the file. Frames are dealt out by
    clip and range of FRAME_RANGE, so one long clip is measured by many tasks. per_second thins a clip to so many frames a second
    (the first of each interval). A file that is no such clip, or of another colour space, is left out; a last frame that is cut off
    does not count; a frame without its mark has no gray, so it is corrupted.
    """
    kept = [c for c in files.columns if c != "content"]
    head = F.regexp_extract(F.decode(F.substring("content", 1, 512), "ISO-8859-1"), rf"^{Y4M}( [^\n]*)\n", 1)
    number = lambda pattern: F.regexp_extract("_head", pattern, 1).try_cast("long")
    w, h, colour = F.col("w"), F.col("h"), F.regexp_extract("_head", r" C(\S+)", 1)
    half = lambda x: F.expr(f"({x} + 1) div 2")
    chroma = F.when(colour.isin(*Y4M_420), 2 * half("w") * half("h")).when(colour.isin(*Y4M_422), 2 * half("w") * h).when(colour.isin(*Y4M_444), 2 * w * h).when(colour.isin(*Y4M_MONO), F.lit(0))
    rows = files.withColumn("_head", head).where("_head <> ''").withColumn("w", number(r" W(\d+)")).withColumn("h", number(r" H(\d+)"))
    rows = rows.withColumn("_bytes", len(Y4M_FRAME) + w * h + chroma).where("_bytes > 6 and w > 0 and h > 0")
    rows = rows.withColumn("_start", F.length("_head") + len(Y4M) + 1)
    rows = rows.withColumn("_all", F.expr("(length(content) - _start) div _bytes"))
    step = F.lit(1)
    if per_second:
        rate = number(r" F(\d+):") / F.nullif(number(r" F\d+:(\d+)"), F.lit(0))
        step = F.greatest(F.lit(1), F.floor(F.coalesce(rate, F.lit(1.0)) / per_second))
    rows = rows.withColumn("_step", step.cast("long")).where("_all > 0").withColumn("n_frames", F.expr("cast((_all + _step - 1) div _step as int)"))
    each = rows.withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)))
    at = "cast(_start + frame_idx * _step * _bytes as int)"
    gray = F.expr(f"case when substring(content, {at} + 1, {len(Y4M_FRAME)}) = encode('{Y4M_FRAME[:-1]}\\n', 'UTF-8') then substring(content, {at} + {len(Y4M_FRAME) + 1}, cast(w * h as int)) end")
    found = each.select(*kept, "frame_idx", "n_frames", w.cast("int").alias("w"), h.cast("int").alias("h"), gray.alias("gray"))
    # a number of its own, or the ranges would be put together by their few bytes
    return found.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", F.floor(F.col("frame_idx") / FRAME_RANGE))


def clip_stream(spark: SparkSession, root: str, per_second: float | None = None, files_per_batch: int = 100) -> DataFrame:
    """(file_id, path, size, mtime, frame_idx, n_frames, w, h, gray): a stream of the frames of new *.y4m files below root."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = source.option("pathGlobFilter", "*.y4m").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(root)
    known = files.select(F.xxhash64("path").bitwiseAND((1 << 63) - 1).alias("file_id"), "path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")
    return y4m_frames(known, per_second)


# TIFF tags of maker, model, the EXIF directory and the time of capture; bytes of each field type.
MAKE, MODEL, EXIF, TAKEN = 0x010F, 0x0110, 0x8769, 0x9003
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
MOST_ENTRIES = 512


def _directory(tiff: bytes, at: int, order: str) -> dict[int, bytes | int]:
    """Text and offset fields of a TIFF directory; entries that point outside are passed over."""
    out: dict[int, bytes | int] = {}
    if at < 8 or at + 2 > len(tiff):
        return out
    for k in range(min(struct.unpack_from(order + "H", tiff, at)[0], MOST_ENTRIES)):
        entry = at + 2 + 12 * k
        if entry + 12 > len(tiff):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
        size = TYPE_BYTES.get(kind, 0) * count
        start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
        if not size or start + size > len(tiff):
            continue
        if kind == 2:
            out[tag] = tiff[start : start + size].split(b"\0")[0].strip()
        elif kind == 4 and count == 1:
            out[tag] = struct.unpack_from(order + "I", tiff, start)[0]
    return out


def capture_tags(head: bytes | None) -> tuple[str, str]:
    """(device, time of capture as written) from the first bytes of a JPEG; '' where there is none."""
    if not head or head[:2] != b"\xff\xd8":
        return "", ""
    at = 2
    while at + 4 <= len(head) and head[at] == 0xFF:
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0" and body[6:8] in (b"II", b"MM"):
            tiff, order = body[6:], "<" if body[6:8] == b"II" else ">"
            if len(tiff) < 8:
                return "", ""
            first = _directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
            inner = _directory(tiff, first[EXIF], order) if isinstance(first.get(EXIF), int) else {}
            text = [x.decode("utf-8", "replace") if isinstance(x, bytes) else "" for x in (first.get(MODEL) or first.get(MAKE), inner.get(TAKEN))]
            return text[0], text[1]
        if marker in (0xD9, 0xDA):
            break
        at += 2 + size
    return "", ""


def read_capture(files: DataFrame) -> DataFrame:
    """(path, device, shoot_key) of files (path, content): EXIF in the first 256 KiB, else the time in the file name."""

    @F.pandas_udf("struct<device: string, taken: string>")
    def tags(head: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([capture_tags(h) for h in head], columns=["device", "taken"])

    rows = files.select("path", tags(F.expr(f"substring(content, 1, {HEAD})")).alias("t"))
    from_name = V.capture_time(F.substring_index("path", "/", -1))
    return rows.select("path", "t.device", F.when(F.col("t.taken") != "", F.col("t.taken")).otherwise(from_name).alias("shoot_key"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A catalog table with its fixed schema (one of schemas.FOLDER, FILE, REVIEW, CLAIM, QC, KNOWN_USER)."""
    return spark.read.schema(schema).parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit log; a line that is no JSON is kept in _corrupt_record."""
    return spark.read.schema(S.AUDIT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
