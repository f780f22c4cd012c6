"""Metrics of gray frames, in Arrow batches; pixels are never shuffled except for pairs of stored frames that must be compared.

Functions on arrays look at rasters in the last two axes, so a batch of frames of one size is measured at once. Decisions are
made afterwards, in verdict.py, so thresholds can change without reading pixels again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumaframe import schemas as S

GRID = 8
#: Pixels that are measured at once (a larger frame comes alone).
PIXELS = 1 << 18
INSIDE = (-2, -1)
#: Pairs of files up to which the pairs go to the frames.
FEW_PAIRS = 200_000


@cache
def dct_rows(n: int = S.GRAY_SIDE, rows: int = 8) -> np.ndarray:
    """The first rows of the orthonormal DCT-II matrix."""
    k = np.arange(rows)[:, None]
    m = np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] = np.sqrt(1 / n)
    return m


def perceptual_hashes(gray: np.ndarray) -> list[str]:
    """Of each raster: bit i is set if low frequency i (row by row) is above the upper median of all but the first."""
    c = dct_rows(gray.shape[-1])
    flat = (c @ gray.astype(float) @ c.T).reshape(-1, GRID * GRID)
    above = flat > np.partition(flat[:, 1:], 31, axis=1)[:, 31:32]
    return [f"{x:016x}" for x in np.packbits(above, axis=1, bitorder="little").view("<u8").ravel().tolist()]


def perceptual_hash(gray: np.ndarray) -> str:
    return perceptual_hashes(gray[None])[0]


def deviation(x: np.ndarray, axis=None) -> np.ndarray:
    """Population deviation as the root of E[x*x] - E[x]*E[x], never below zero."""
    x = x.astype(float)
    return np.sqrt(np.maximum((x * x).mean(axis=axis) - x.mean(axis=axis) ** 2, 0))


def spread(total: np.ndarray, squares: np.ndarray, n: int) -> np.ndarray:
    """deviation() from sums of n values and of their squares."""
    return np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0))


def sharpness(gray: np.ndarray) -> np.ndarray:
    """Deviation of the 4-neighbour Laplacian over inner pixels."""
    g = gray.astype(np.int16 if gray.dtype == np.uint8 else float)
    if min(g.shape[-2:]) < 3:
        return np.zeros(g.shape[:-2])
    inner = 4 * g[..., 1:-1, 1:-1]
    for side in (g[..., 1:-1, :-2], g[..., 1:-1, 2:], g[..., :-2, 1:-1], g[..., 2:, 1:-1]):
        inner -= side
    flat = inner.astype(float).reshape(*g.shape[:-2], -1)
    return spread(flat.sum(axis=-1), np.einsum("...i,...i->...", flat, flat), flat.shape[-1])


def cell_sums(gray: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the pixels and of their squares over each whole square cell."""
    h, w = gray.shape[-2] // side, gray.shape[-1] // side
    # a cell of bytes sums up exactly in single precision if it has so few pixels
    x = gray[..., : h * side, : w * side].astype(np.float32 if gray.dtype == np.uint8 and side <= 16 else float)
    # a few cells at once, as a product with one matrix is faster than sums of short rows, but not with a wide one
    wide = next(k for k in (8, 4, 2, 1) if w % k == 0)
    across = np.repeat(np.eye(wide, dtype=x.dtype), side, axis=0)

    def summed(y: np.ndarray) -> np.ndarray:
        rows = (y.reshape(-1, wide * side) @ across).reshape(-1, h, side, w)
        total = rows[:, :, 0].copy()
        for k in range(1, side):
            total += rows[:, :, k]
        return total.reshape(*gray.shape[:-2], h, w).astype(float)

    return summed(x), summed(x * x)


def noise_floor(gray: np.ndarray) -> np.ndarray:
    """The deviation of the cell that a tenth of all cells are flatter than."""
    lead = gray.shape[:-2]
    if min(gray.shape[-2:]) < 2 * S.NOISE_CELL:
        return np.zeros(lead)
    flat = spread(*cell_sums(gray, S.NOISE_CELL), S.NOISE_CELL**2)
    flat = flat.reshape(*lead, flat.shape[-2] * flat.shape[-1])
    at = flat.shape[-1] // 10
    return np.partition(flat, at, axis=-1)[..., at]


@cache
def neighbours() -> np.ndarray:
    """One where two grid cells touch, at a side or a corner."""
    near = np.eye(GRID) + np.eye(GRID, k=1) + np.eye(GRID, k=-1)
    return np.kron(near, near) - np.eye(GRID * GRID)


def lens_dirt(gray: np.ndarray, sums: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[float, list[tuple[float, float, float, float]]]]:
    """(confidence, boxes) of each raster: a compact patch of smooth grid cells that stand out from the cells around them.

    sums: cell_sums() of the rasters, if known.
    """
    side = gray.shape[-2] // GRID
    total, squares = (x[:, :GRID, :GRID] for x in sums or cell_sums(gray, side))
    mean, dev = total / side**2, spread(total, squares, side**2)
    beside = neighbours()
    around = (mean.reshape(-1, GRID * GRID) @ beside / beside.sum(axis=0)).reshape(mean.shape)
    smooth_below = np.maximum(4.0, 0.35 * deviation(dev, axis=INSIDE))[:, None, None]
    bad = (dev < smooth_below) & (np.abs(mean - around) > 25.0)
    found = [(0.0, [])] * len(mean)
    for k in (bad.sum(axis=INSIDE) >= 3).nonzero()[0].tolist():
        ys, xs = bad[k].nonzero()
        n, top, left, high, wide = len(ys), int(ys.min()), int(xs.min()), int(np.ptp(ys)) + 1, int(np.ptp(xs)) + 1
        if min(high, wide) >= 2 and high * wide < 0.6 * GRID * GRID and n >= 0.5 * high * wide:
            found[k] = (n / GRID**2, [(left / GRID, top / GRID, wide / GRID, high / GRID)])
    return found


def resized(gray: np.ndarray, w: int, h: int) -> np.ndarray:
    """Area averages when a side shrinks, nearest pixels when it grows."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        """The axis before the last at the new size n."""
        old = x.shape[-2]
        if n >= old:
            return x[..., np.arange(n) * old // n, :]
        sums = np.concatenate([np.zeros_like(x[..., :1, :]), np.cumsum(x, axis=-2)], axis=-2)
        edges = np.arange(n + 1) * old / n
        low = edges.astype(int).clip(max=old - 1)
        return np.diff(sums[..., low, :] + (edges - low)[:, None] * x[..., low, :], axis=-2) * n / old

    if gray.shape[-2:] == (h, w):
        return gray
    return np.rint(along(along(gray.astype(float), h).swapaxes(-1, -2), w).swapaxes(-1, -2)).clip(0, 255).astype(np.uint8)


def to_gray(rgb: np.ndarray) -> np.ndarray:
    """Luma of an H x W x 3 raster."""
    return np.rint(rgb[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def scaled_size(w: int, h: int) -> tuple[int, int]:
    long = max(w, h)
    if long <= S.DETAIL_SIDE:
        return w, h
    return tuple(max(8, int(x * S.DETAIL_SIDE / long + 0.5)) for x in (w, h))


METRIC_NAMES = ["corrupted", "gray_std", "exp_mean", "clip_low", "clip_high", "lap_std", "noise_floor", "dirt_conf", "dirt_boxes", "dup_hash"]
BOXES = pa.list_(pa.struct([(x, pa.float64()) for x in "xywh"]))


def measured(gray: np.ndarray, costly: np.ndarray, wanted: list[str]) -> dict[str, list | np.ndarray]:
    """The wanted metrics of rasters of one size: of the small ones and, where costly, of the detailed ones (those have a value for each costly raster)."""
    small, found = resized(gray, S.GRAY_SIDE, S.GRAY_SIDE), {}
    n, need = S.GRAY_SIDE**2, set(wanted)
    if need & {"gray_std", "exp_mean", "dirt_conf", "dirt_boxes"}:
        sums = cell_sums(small, S.GRAY_SIDE // GRID)
        total, squares = (x.sum(axis=INSIDE) for x in sums)
        found |= {"gray_std": spread(total, squares, n), "exp_mean": total / n}
    if need & {"dirt_conf", "dirt_boxes"}:
        dirt = lens_dirt(small, sums)
        found |= {"dirt_conf": [c for c, _ in dirt], "dirt_boxes": [[dict(zip("xywh", b, strict=True)) for b in own] for _, own in dirt]}
    if "clip_low" in need:
        found["clip_low"] = (small <= S.DARK).mean(axis=INSIDE)
    if "clip_high" in need:
        found["clip_high"] = (small >= S.BRIGHT).mean(axis=INSIDE)
    if need & {"lap_std", "noise_floor"} and costly.any():
        detail = resized(gray if costly.all() else gray[costly], *scaled_size(gray.shape[2], gray.shape[1]))
        found |= {name: f(detail) for name, f in (("lap_std", sharpness), ("noise_floor", noise_floor)) if name in need}
    if "dup_hash" in need:
        found["dup_hash"] = perceptual_hashes(small)
    return {name: found[name] for name in wanted if name in found}


def _stack(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each of some places on as rows; not copied if they follow one another."""
    if (np.diff(at) == n).all():
        return data[at[0] : at[-1] + n].reshape(-1, n)
    return np.stack([data[x : x + n] for x in at.tolist()])


def by_size(part: pa.RecordBatch, column: str = "gray", depth: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, stack) of a batch's rasters (w, h, column) of one size, PIXELS at a time; those whose bytes are not w x h x depth are left out."""
    gray = part.column(column).cast(pa.large_binary())
    if not len(gray) or gray.buffers()[2] is None:
        return
    starts = np.frombuffer(gray.buffers()[1], np.int64)[gray.offset : gray.offset + len(gray) + 1]
    data = np.frombuffer(gray.buffers()[2], np.uint8)
    w, h = (pc.fill_null(part.column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in "wh")
    sound = gray.is_valid().to_numpy(zero_copy_only=False) & (w > 0) & (h > 0) & (np.diff(starts) == w * h * depth)
    for wide, high in np.unique(np.stack([w[sound], h[sound]], axis=1), axis=0).tolist():
        own, n = (sound & (w == wide) & (h == high)).nonzero()[0], wide * high
        step = max(1, PIXELS // n)
        for k in range(0, len(own), step):
            places = own[k : k + step]
            stack = _stack(data, starts[places], n * depth)
            yield places, stack.reshape(-1, high, wide) if depth == 1 else stack.reshape(-1, high, wide, depth)


def _metrics(part: pa.RecordBatch, stacks: list[tuple[np.ndarray, np.ndarray]], costly_every: int, wanted: list[str]) -> list[pa.Array]:
    """The wanted metrics of a batch of frames; null (no boxes, an empty hash) where there is no raster."""
    n, index = part.num_rows, part.column("frame_idx")
    costly = index.is_valid().to_numpy(zero_copy_only=False) & (pc.fill_null(index, 0).to_numpy(zero_copy_only=False) % costly_every == 0)
    sound = np.zeros(n, bool)
    values = {name: [[]] * n if name == "dirt_boxes" else [""] * n if name == "dup_hash" else np.zeros(n) for name in wanted}
    for places, stack in stacks:
        sound[places] = True
        for name, own in measured(stack, costly[places], wanted).items():
            if name in ("dirt_boxes", "dup_hash"):
                for k, x in zip(places.tolist(), own, strict=True):
                    values[name][k] = x
            else:
                values[name][places[costly[places]] if name in ("lap_std", "noise_floor") else places] = own
    known = {"lap_std": sound & costly, "noise_floor": sound & costly}

    def column(name: str) -> pa.Array:
        if name == "corrupted":
            return pa.array(~sound)
        if name == "dirt_boxes":
            return pa.array(values[name], BOXES)
        return pa.array(values[name], pa.string()) if name == "dup_hash" else pa.array(values[name], mask=~known.get(name, sound))

    return [column(name) for name in wanted]


def _framed(frames: DataFrame, *keep: str) -> DataFrame:
    return frames.select(F.col("file_id").cast("long"), F.col("frame_idx").cast("int"), *keep, "w", "h", "gray")


def frame_metrics(frames: DataFrame, costly_every: int = 1, wanted: list[str] | None = None) -> DataFrame:
    """(file_id, frame_idx, METRICS, or the wanted ones of them) of each frame; a frame whose bytes are not w x h is corrupted."""
    wanted = list(wanted or METRIC_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            columns = _metrics(part, list(by_size(part)), costly_every, wanted)
            yield pa.RecordBatch.from_arrays([part.column("file_id"), part.column("frame_idx"), *columns], names=["file_id", "frame_idx", *wanted])

    types = StructType.fromDDL(S.METRICS)
    return _framed(frames).mapInArrow(run, f"file_id long, frame_idx int, {', '.join(f'{c} {types[c].dataType.simpleString()}' for c in wanted)}")


def _lists(parts: list[np.ndarray | None]) -> pa.ListArray:
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in parts)], dtype=np.int32)
    none = np.fromiter((x is None for x in parts), bool, len(parts))
    values = [x for x in parts if x is not None]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0)), mask=pa.array(none))


def _projected(n: int, stacks: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    """Means of each row and each column of each of n rasters."""
    rows, cols = [None] * n, [None] * n
    for places, stack in stacks:
        for k, row, col in zip(places.tolist(), stack.mean(axis=2), stack.mean(axis=1), strict=True):
            rows[k], cols[k] = row, col
    return [_lists(rows), _lists(cols)]


def projections(frames: DataFrame) -> DataFrame:
    """(file_id, frame_idx, rows, cols): means of each row and each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            columns = _projected(part.num_rows, list(by_size(part)))
            yield pa.RecordBatch.from_arrays([part.column("file_id"), part.column("frame_idx"), *columns], names=["file_id", "frame_idx", "rows", "cols"])

    return _framed(frames).mapInArrow(run, "file_id long, frame_idx int, rows array<double>, cols array<double>")


def frame_features(frames: DataFrame, costly_every: int = 1, keep: list[str] | None = None) -> DataFrame:
    """(file_id, frame_idx, keep, METRICS, rows, cols): frame_metrics() and projections() in one look at the pixels; columns in keep pass."""
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            stacks = list(by_size(part))
            columns = [*_metrics(part, stacks, costly_every, METRIC_NAMES), *_projected(part.num_rows, stacks)]
            head = ["file_id", "frame_idx", *keep]
            yield pa.RecordBatch.from_arrays([*map(part.column, head), *columns], names=[*head, *METRIC_NAMES, "rows", "cols"])

    kept = "".join(f"{c} {frames.schema[c].dataType.simpleString()}, " for c in keep)
    return _framed(frames, *keep).mapInArrow(run, f"file_id long, frame_idx int, {kept}{S.METRICS}, rows array<double>, cols array<double>")


def smooth(x: np.ndarray) -> np.ndarray:
    """Means of three neighbours in the last axis; the ends stay."""
    out = x.astype(float).copy()
    out[..., 1:-1] = (x[..., :-2] + x[..., 1:-1] + x[..., 2:]) / 3
    return out


def best_shifts(a: np.ndarray, b: np.ndarray, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(offset, mean distance) of the best match of each row of b against that of a, within most steps either way; the first of equal ones."""
    a, b = smooth(a), smooth(b)
    n = min(a.shape[1], b.shape[1])
    dist = np.full((2 * most + 1, len(a)), np.inf)
    for k, d in enumerate(range(-most, most + 1)):
        lo, hi = max(0, -d), min(n, n - d)
        if hi > lo:
            dist[k] = np.abs(a[:, lo:hi] - b[:, lo + d : hi + d]).mean(axis=1)
    best = np.round(dist, 9).argmin(axis=0)  # what differs by rounding only is equal
    least = dist[best, np.arange(len(a))]
    return np.where(np.isfinite(least), best - most, 0), least


def shift(a: np.ndarray, b: np.ndarray, most: int = 8) -> tuple[int, float]:
    """best_shifts() of one pair."""
    d, dist = best_shifts(np.asarray(a)[None], np.asarray(b)[None], most)
    return int(d[0]), float(dist[0])


def _matched(before: pa.ListArray, now: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """best_shifts() of pairs of arrays, all of one pair of lengths at a time; 0 where one is missing."""
    d, dist = np.zeros(len(now), np.int32), np.zeros(len(now))
    known = before.is_valid().to_numpy(zero_copy_only=False) & now.is_valid().to_numpy(zero_copy_only=False)
    starts = [x.offsets.to_numpy() for x in (before, now)]
    values = [x.values.to_numpy(zero_copy_only=False) for x in (before, now)]
    long = [np.diff(x) for x in starts]
    for n, m in np.unique(np.stack([x[known] for x in long], axis=1), axis=0).tolist():
        own = (known & (long[0] == n) & (long[1] == m)).nonzero()[0]
        a, b = (v[at[own][:, None] + np.arange(size)] for v, at, size in zip(values, starts, (n, m), strict=True))
        d[own], dist[own] = best_shifts(a, b)
    return d, dist


def shifts(projected: DataFrame) -> DataFrame:
    """(file_id, frame_idx, dy, dx, dist) of each frame against the one before; the first frame of a file stands still."""
    from pyspark.sql import Window

    own = Window.partitionBy("file_id").orderBy("frame_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for k in range(0, part.num_rows, 1024):
                some = part.slice(k, 1024)
                (dy, ey), (dx, ex) = (_matched(some.column(a), some.column(b)) for a, b in (("r0", "rows"), ("c0", "cols")))
                columns = [some.column("file_id"), some.column("frame_idx"), *map(pa.array, (dy, dx, np.maximum(ey, ex)))]
                yield pa.RecordBatch.from_arrays(columns, names=["file_id", "frame_idx", "dy", "dx", "dist"])

    rows = projected.withColumn("r0", F.lag("rows").over(own)).withColumn("c0", F.lag("cols").over(own))
    typed = "".join(f"{c} {projected.schema[c].dataType.simpleString()}, " for c in ("file_id", "frame_idx"))
    return rows.select("file_id", "frame_idx", "r0", "rows", "c0", "cols").mapInArrow(run, f"{typed}dy int, dx int, dist double")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each two rows of bytes: the share that differs by more than PIXEL_DELTA."""
    hits = np.packbits(np.maximum(a, b) - np.minimum(a, b) > S.PIXEL_DELTA, axis=1)
    return np.bitwise_count(hits).sum(axis=1) / a.shape[1]


def pixel_differences(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """(file_id, other_id, diff): mean share of pixels that differ by more than PIXEL_DELTA, over the frames both files have.

    For frames that are stored; those that are made or decoded anyway are better made where they are compared, by differences_of().
    Pixels are never broadcast: Spark judges frames made in Python by the columns that they are made from. With up to FEW_PAIRS pairs, the
    pairs are sent to the frames, and only frames of files in a pair move; with more, frames are shuffled. A pair without a common
    frame has no row.
    """
    pairs = pairs.select("file_id", "other_id")
    named = frames.select("file_id", "frame_idx", F.col("gray").alias("a"))
    others = frames.select(F.col("file_id").alias("other_id"), "frame_idx", F.col("gray").alias("b"))
    if pairs.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS:
        named = named.join(F.broadcast(pairs), "file_id")
        others = others.join(F.broadcast(pairs.select("other_id").distinct()), "other_id", "left_semi")
    else:
        named = named.hint("merge").join(pairs, "file_id")

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        found = np.full(len(a), np.nan)
        groups: dict[int, list[int]] = {}
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            if x and y and len(x) == len(y):
                groups.setdefault(len(x), []).append(k)
        for n, own in groups.items():
            step = max(1, PIXELS // n)
            for k in range(0, len(own), step):
                part = own[k : k + step]
                found[part] = differing(*(np.frombuffer(b"".join(s.iat[j] for j in part), np.uint8).reshape(-1, n) for s in (a, b)))
        return pd.Series(found).astype(object).where(~np.isnan(found), None)

    both = named.join(others.hint("merge"), ["other_id", "frame_idx"])
    return both.select("file_id", "other_id", share("a", "b").alias("d")).groupBy("file_id", "other_id").agg(F.avg("d").alias("diff")).where("diff is not null")


Decoder = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _runs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, place) of the count[k] places from first[k] on, for one k after the other."""
    k = np.repeat(np.arange(len(count)), count)
    return k, np.arange(len(k)) - (np.cumsum(count) - count - first)[k]


def _compared(pairs: pa.RecordBatch, others: list[str], decode: Decoder) -> pa.RecordBatch:
    """(file_id, other_id, diff) of pairs (file_id, other_id, a_ and b_ of the other columns of the files), each file of which is decoded once."""
    sides = {"file_id": "a_", "other_id": "b_"}
    ids = np.concatenate([pairs.column(c).to_numpy(zero_copy_only=False) for c in sides])
    files, first, own = np.unique(ids, return_index=True, return_inverse=True)
    what = [pa.concat_arrays([pairs.column(side + c) for side in sides.values()]).take(pa.array(first)) for c in others]
    made = [x for x in decode(iter([pa.RecordBatch.from_arrays([pa.array(files), *what], names=["file_id", *others])])) if x.num_rows]
    total, frames = np.zeros(len(pairs)), np.zeros(len(pairs))
    if made:
        table = pa.Table.from_batches(made).combine_chunks()
        gray = pc.fill_null(table.column("gray").cast(pa.large_binary()), pa.scalar(b"", pa.large_binary())).combine_chunks()
        starts = np.frombuffer(gray.buffers()[1], np.int64)[gray.offset : gray.offset + len(gray) + 1]
        data, long = np.frombuffer(gray.buffers()[2] or b"", np.uint8), np.diff(starts)
        # frames in the order of (file, moment), where a moment stands for a frame_idx
        file_id, index = (table.column(c).to_numpy() for c in ("file_id", "frame_idx"))
        places = ((long > 0) & table.column("frame_idx").is_valid().to_numpy() & np.isin(file_id, files)).nonzero()[0]
        of, (moments, moment) = np.searchsorted(files, file_id[places]), np.unique(index[places], return_inverse=True)
        order = np.argsort(of * len(moments) + moment, kind="stable")
        places, of, moment = places[order], of[order], moment[order]
        start, end = (np.searchsorted(of, own[: len(pairs)], x) for x in ("left", "right"))
        pair, a = _runs(start, end - start)
        start, end = (np.searchsorted(of * len(moments) + moment, own[len(pairs) :][pair] * len(moments) + moment[a], x) for x in ("left", "right"))
        k, b = _runs(start, end - start)
        pair, a, b = pair[k], places[a[k]], places[b]
        for n in np.unique(long[a[long[a] == long[b]]]).tolist():
            alike, places = ((long[a] == n) & (long[b] == n)).nonzero()[0], (long == n).nonzero()[0]
            pixels, step = _stack(data, starts[places], n), max(1, PIXELS // n)
            for some in (alike[k : k + step] for k in range(0, len(alike), step)):
                share = differing(*(pixels[np.searchsorted(places, x[some])] for x in (a, b)))
                total += np.bincount(pair[some], share, len(pairs))
                frames += np.bincount(pair[some], minlength=len(pairs))
    known = pa.array(frames.nonzero()[0])
    diff = pa.array(total / np.maximum(frames, 1))
    return pa.RecordBatch.from_arrays([x.take(known) for x in (pairs.column("file_id"), pairs.column("other_id"), diff)], names=["file_id", "other_id", "diff"])


def differences_of(pairs: DataFrame, files: DataFrame, decode: Decoder, at_once: int = 64) -> DataFrame:
    """pixel_differences(pairs, files.mapInArrow(decode, FRAME)), with the frames made where they are compared: rows of files move, pixels never do.

    files has one row for each file_id (of several rows one is taken). Pairs are dealt out by ranges of (other_id, file_id), so that the
    pairs of one other file are together, however many there are, and it is decoded once for `at_once` of them. All frames of so many
    pairs are in a task's memory.
    """
    others = [c for c in files.columns if c != "file_id"]

    def side(name: str, prefix: str) -> DataFrame:
        return files.select(F.col("file_id").cast("long").alias(name), *[F.col(c).alias(prefix + c) for c in others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part in (x for x in batches if x.num_rows):
            ids = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("file_id", "other_id")], axis=1)
            new = np.concatenate([[last is None or (ids[0] != last).any()], (ids[1:] != ids[:-1]).any(axis=1)])
            last, part = ids[-1], part.filter(pa.array(new))
            for k in range(0, part.num_rows, at_once):
                yield _compared(part.slice(k, at_once), others, decode)

    # Spark would judge the files by what it reads of a table, and broadcast too many
    pairs = pairs.select(F.col("file_id").cast("long"), F.col("other_id").cast("long")).hint("merge").join(side("file_id", "a_"), "file_id")
    pairs = pairs.hint("merge").join(side("other_id", "b_"), "other_id")
    tasks = 4 * pairs.sparkSession.sparkContext.defaultParallelism
    dealt = pairs.repartitionByRange(tasks, "other_id", "file_id").sortWithinPartitions("other_id", "file_id")
    return dealt.mapInArrow(run, "file_id long, other_id long, diff double")


#: Crops are CROP pixels wide and high, ACROSS of them across and down.
CROP, ACROSS = 224, 3


@lru_cache(maxsize=1024)
def crop_places(h: int, w: int, side: int = CROP, grid: int = ACROSS) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(h, w, tops, lefts, of): the size of a raster once it is enlarged, where its different crops begin, and which of them each of the grid * grid is."""
    scale = max(1, side / min(h, w))
    high, wide = (max(side, round(x * scale)) if scale > 1 else x for x in (h, w))
    tops, lefts = (np.unique(np.linspace(0, x - side, grid).astype(int), return_inverse=True) for x in (high, wide))
    return high, wide, tops[0], lefts[0], (tops[1][:, None] * len(lefts[0]) + lefts[1]).ravel()


def distinct_crops(rgb: np.ndarray, side: int = CROP, grid: int = ACROSS) -> tuple[np.ndarray, np.ndarray]:
    """(crops, of): those of crops() that lie at different places, and which of them each of the grid * grid is."""
    h, w = rgb.shape[:2]
    high, wide, tops, lefts, of = crop_places(h, w, side, grid)
    # the pixel that each of the enlarged raster shows
    ys, xs = np.arange(high) * h // high, np.arange(wide) * w // wide
    out = np.empty((len(tops) * len(lefts), 3, side, side), np.float32)
    for k, (y, x) in enumerate((y, x) for y in tops for x in lefts):
        down, right = ys[y : y + side], xs[x : x + side]
        part = rgb[down[0] : down[-1] + 1, right[0] : right[-1] + 1, :3].transpose(2, 0, 1).astype(np.float32) / 255
        if (high, wide) == (h, w):
            out[k] = part
        else:
            part.take(right - right[0], axis=2).take(down - down[0], axis=1, out=out[k], mode="clip")
    return out, of


def own_crops(rgb: np.ndarray, side: int = CROP, grid: int = ACROSS) -> tuple[np.ndarray, np.ndarray] | None:
    """distinct_crops() of each of a stack of rasters, with every pixel once; None if some crop shows a pixel of it more often than another."""
    h, w = rgb.shape[1:3]
    high, wide, tops, lefts, of = crop_places(h, w, side, grid)
    down, right = high // h, wide // w
    if high % h or wide % w or side % down or side % right or (tops % down).any() or (lefts % right).any():
        return None
    out = np.empty((len(rgb), len(tops) * len(lefts), 3, side // down, side // right), np.float32)
    for k, (y, x) in enumerate((y // down, x // right) for y in tops for x in lefts):
        for c in range(3):
            out[:, k, c] = rgb[:, y : y + side // down, x : x + side // right, c]
    out /= 255
    return out, of


def crops(rgb: np.ndarray, side: int = CROP, grid: int = ACROSS) -> np.ndarray:
    """(grid * grid, 3, side, side) in [0, 1]: patches spread evenly over a raster, which is enlarged first if it is smaller."""
    found, of = distinct_crops(rgb, side, grid)
    return found[of]


#: Takes crops (n, 3, CROP, CROP). One whose results do not change when each pixel is repeated as often says so by a true attribute any_size
#: and gets the crops of small rasters in their own pixels.
Scorer = Callable[[np.ndarray], np.ndarray]


def stub_scorer(batch: np.ndarray) -> np.ndarray:
    """Deterministic logits (blur, noise, other, dirt) for tests: there is no model in this repository."""
    flat = batch.reshape(len(batch), -1)
    mean, dev = np.empty(len(flat)), np.empty(len(flat))
    step = max(1, (1 << 17) // flat.shape[1])  # what stays in the processor's cache
    for k in range(0, len(flat), step):
        x = flat[k : k + step].astype(np.float64)
        mean[k : k + step] = x.mean(axis=1)
        x -= mean[k : k + step, None]
        dev[k : k + step] = np.sqrt(np.einsum("ij,ij->i", x, x) / x.shape[1])  # np.dot would start threads beside Spark's
    return np.stack([1 - 10 * dev, 10 * dev - 3, mean, 2 - 8 * mean], axis=1)


stub_scorer.any_size = True  # a mean and a deviation


_SCORERS: dict[str, Scorer] = {}


def scorer_of(name: str, make_scorer: Callable[[], Scorer]) -> Scorer:
    """The scorer that this worker process keeps under a name; made the first time, when one of another name goes."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = make_scorer()
    return _SCORERS[name]


def scored(images: DataFrame, make_scorer: Callable[[], Scorer], at_once: int = 8, name: str | None = None, decode: Decoder | None = None) -> DataFrame:
    """(file_id, frame_idx, blur, noise, dirt) of rasters (file_id, frame_idx, w, h, rgb): mean over the crops of the sigmoid of logits 0, 1 and 3.

    The scorer gets the crops of `at_once` images together, those at one place of an image once: all crops of a square one no larger than
    a crop are the same. A scorer of any size gets the crops of a small image without its enlargement, if that repeats all pixels of
    a crop as often, and of as many images as have the pixels of `at_once` large crops. The scorer is made once for each worker process, under `name` (by
    default one for each call), and serves all tasks that the process runs. An image that cannot be scored is left out: if the scorer fails on
    several, each of them is tried alone. With decode, images are rows of any columns, of which it makes such rasters in the task that scores them.
    """
    name = name or uuid.uuid4().hex

    def together(part: pa.RecordBatch, any_size: bool) -> Iterator[list[tuple]]:
        """What the scorer gets at once: lists of (places, crops (images, different crops, ...), of)."""
        held = []
        for places, stack in by_size(part, "rgb", 3):
            if small := own_crops(stack) if any_size else None:
                found, of = small
                step = at_once * CROP**2 // found[0, 0, 0].size
                yield from ([(places[k : k + step], found[k : k + step], of)] for k in range(0, len(places), step))
                continue
            for k, rgb in enumerate(stack):
                found, of = distinct_crops(rgb)
                held.append((places[k : k + 1], found[None], of))
                if len(held) == at_once:
                    yield held
                    held = []
        if held:
            yield held

    def judged(score: Scorer, held: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, marks) of what could be scored."""
        try:
            logits = np.asarray(score(np.concatenate([x.reshape(-1, *x.shape[2:]) for _, x, _ in held])))
        except Exception:  # whatever a foreign model raises
            alone = [(places[k : k + 1], x[k : k + 1], of) for places, x, of in held for k in range(len(places))]
            return [r for one in alone for r in judged(score, [one])] if len(alone) > 1 else []
        marks, at, out = 1 / (1 + np.exp(-logits[:, [0, 1, 3]])), 0, []
        for places, x, of in held:
            n, m = x.shape[:2]
            out.append((places, marks[at : at + n * m].reshape(n, m, -1)[:, of].mean(axis=1)))
            at += n * m
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer_of(name, make_scorer)
        for part in decode(batches) if decode else batches:
            for held in together(part, getattr(score, "any_size", False)):
                if found := judged(score, held):
                    places, marks = (np.concatenate(x) for x in zip(*found, strict=True))
                    own = [part.column(c).take(pa.array(places)) for c in ("file_id", "frame_idx")]
                    yield pa.RecordBatch.from_arrays([*own, *map(pa.array, marks.T.astype(float))], names=["file_id", "frame_idx", "blur", "noise", "dirt"])

    rows = images if decode else images.select(F.col("file_id").cast("long"), F.col("frame_idx").cast("int"), "w", "h", "rgb")
    return rows.mapInArrow(run, "file_id long, frame_idx int, blur double, noise double, dirt double")
