"""The detectors on rasters made by formula, and the rules between photos on hand-made rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.operators import calibrate, dedup, frames, reconcile, verdict
from lumaframe.operators.components import components
from lumaframe.queries import QUERIES

Y, X = np.mgrid[0:64, 0:64]
BIG_Y, BIG_X = np.mgrid[0:256, 0:256]
ZERO = np.zeros((64, 64), int)
RASTERS = {
    "black": ZERO, "ramp": X * 4 % 256, "white": ZERO + 255, "mid": 90 + (2 * X + Y) % 60, "document": np.where((X // 8 + Y // 8) % 2 == 0, 250, 60),
    "diagonal": (X + Y) * 2 % 256, "across": X * 4, "down": Y * 4, "dirt": np.where((X >= 20) & (X < 44) & (Y >= 20) & (Y < 44), 230, (7 * X + 13 * Y) % 200),
    "checker": np.where((BIG_X // 4 + BIG_Y // 4) % 2 == 0, 30, 220), "smooth": BIG_X * 255 // 256,
}


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(k, 0, int(r.shape[1]), int(r.shape[0]), bytearray(r.astype(np.uint8).tobytes())) for k, r in enumerate(RASTERS.values())] + [(99, 0, 64, 64, bytearray(b"short")), (98, 0, 0, 0, None)]
    found = verdict.image_verdicts(frames.frame_metrics(spark.createDataFrame(rows, S.FRAME))).collect()
    names = [*RASTERS]
    return {names[r["file_id"]] if r["file_id"] < 90 else str(r["file_id"]): r for r in found}


def test_flags(verdicts):
    flag = {k: r["flags"] for k, r in verdicts.items()}
    assert flag["black"] & S.BLANK and flag["black"] & S.EXPOSURE and not flag["black"] & S.BLUR
    assert not flag["ramp"] & S.BLANK and flag["white"] & S.EXPOSURE and not flag["mid"] & S.EXPOSURE and not flag["document"] & S.EXPOSURE
    assert flag["99"] == flag["98"] == S.CORRUPTED
    assert verdicts["checker"]["lap_std"] >= 15 > verdicts["smooth"]["lap_std"]
    assert flag["dirt"] & S.LENS_DIRT and len(verdicts["dirt"]["dirt_boxes"]) == 1
    box = verdicts["dirt"]["dirt_boxes"][0]
    assert abs(box["x"] + box["w"] / 2 - 0.5) < 0.15 and abs(box["y"] + box["h"] / 2 - 0.5) < 0.15
    assert '"under":true,"over":false' in verdicts["black"]["detail"] and '"under":false,"over":true' in verdicts["white"]["detail"]
    assert verdicts["99"]["detail"] == '{"flags":2,"corrupted":true}'


def test_hash(verdicts):
    assert verdicts["across"]["dup_hash"] != verdicts["down"]["dup_hash"]
    assert frames.perceptual_hash(RASTERS["diagonal"]) == verdicts["diagonal"]["dup_hash"]
    g = RASTERS["dirt"].astype(float)
    n = np.arange(64)
    full = np.array([[np.cos(np.pi * (2 * x + 1) * u / 128) for x in n] for u in n]) * np.sqrt(np.where(n == 0, 1, 2) / 64)[:, None]
    block = (full @ g @ full.T)[:8, :8].ravel()
    middle = sorted(block[1:])[31]
    assert int(verdicts["dirt"]["dup_hash"], 16) == sum(1 << i for i in range(64) if block[i] > middle)


def test_noise():
    y, x = np.mgrid[0:512, 0:512]
    clean = np.where(y < 256, 128, 200)
    noisy = (clean + (1103515245 * x + 12345 * y) % 51 - 25).clip(0, 255)
    assert frames.noise_floor(clean) <= 5 < frames.noise_floor(noisy) and frames.noise_floor(clean[:20]) == 0


def test_shift_and_resize():
    rng = np.random.default_rng(1)
    a = rng.random(100) * 255
    assert frames.shift(a, np.roll(a, 3))[0] == 3 and frames.shift(a, a) == (0, 0.0) and frames.shift(a, np.roll(a, -5))[0] == -5
    g = rng.integers(0, 255, (128, 192)).astype(np.uint8)
    assert np.abs(frames.resized(g, 96, 64).astype(float) - g.reshape(64, 2, 96, 2).mean(axis=(1, 3))).max() <= 1
    assert frames.resized(g, 192, 128) is g and frames.resized(g, 200, 130).shape == (130, 200)
    assert frames.crops(np.zeros((100, 300, 3), np.uint8)).shape == (9, 3, 224, 224)


def test_shaking_clip(spark):
    rng = np.random.default_rng(2)
    scene = rng.integers(0, 255, (80, 80))
    rows = []
    for k in range(12):
        d = 3 if k % 2 else 0
        rows.append((1, k, 64, 64, bytearray(scene[8 + d : 72 + d, 8:72].astype(np.uint8).tobytes())))
        rows.append((2, k, 64, 64, bytearray(scene[8:72, 8:72].astype(np.uint8).tobytes())))
    found = {r["file_id"]: r for r in verdict.shake(frames.shifts(frames.projections(spark.createDataFrame(rows, S.FRAME)))).collect()}
    assert found[1]["shake"] and found[1]["amp"] == 6 and found[1]["flip_rate"] == 1 and not found[2]["shake"]


def test_pixel_differences(spark):
    a, b = np.zeros((64, 64), np.uint8), np.zeros((64, 64), np.uint8)
    b[:16] = 200
    rows = [(1, 0, 64, 64, bytearray(a.tobytes())), (2, 0, 64, 64, bytearray(a.tobytes())), (3, 0, 64, 64, bytearray(b.tobytes())), (4, 1, 64, 64, bytearray(b.tobytes()))]
    pairs = spark.createDataFrame([(2, 1), (3, 1), (4, 1)], "file_id long, other_id long")
    got = {(r[0], r[1]): r[2] for r in frames.pixel_differences(pairs, spark.createDataFrame(rows, S.FRAME)).collect()}
    assert got == {(2, 1): 0.0, (3, 1): 0.25}


def test_scores(spark):
    rows = [(1, k * 50, 32, 32, bytearray(bytes([k * 10]) * 3072)) for k in range(20)] + [(2, 0, 32, 32, bytearray(b"bad"))]
    scores = frames.scored(spark.createDataFrame(rows, "file_id long, frame_idx int, w int, h int, rgb binary"), lambda: frames.stub_scorer)
    got = verdict.ai_votes(scores).collect()
    used = [r for r in scores.collect() if r["frame_idx"] in (0, 100, 200, 300, 400)]
    assert [r["file_id"] for r in got] == [1] and got[0]["dirt"] == pytest.approx(np.mean([r["dirt"] for r in used]))


def test_scores_of_several_images_at_once(spark):
    """All rows equal one image at a time in NumPy; an image on which the model fails takes no other with it."""
    rng = np.random.default_rng(4)
    images = {k: rng.integers(0, 256, (20 + k, 30, 3)).astype(np.uint8) for k in range(11)}
    images[5][:] = 255

    def make():
        def score(batch):
            assert len(batch) <= 4 * 9
            if (batch.reshape(len(batch), -1).min(axis=1) == 1).any():
                raise ValueError("white")
            return frames.stub_scorer(batch)

        return score

    rows = [(k, 0, x.shape[1], x.shape[0], bytearray(x.tobytes())) for k, x in images.items()] + [(20, 0, 0, 0, bytearray()), (21, 0, 5, 5, None)]
    got = {r["file_id"]: (r["blur"], r["noise"], r["dirt"]) for r in frames.scored(spark.createDataFrame(rows, "file_id long, frame_idx int, w int, h int, rgb binary").coalesce(1), make, at_once=4).collect()}
    assert sorted(got) == [k for k in range(11) if k != 5]
    for k, row in got.items():
        logits = frames.stub_scorer(frames.crops(images[k]))[:, [0, 1, 3]]
        assert row == pytest.approx((1 / (1 + np.exp(-logits))).mean(axis=0).tolist(), rel=1e-6)


def test_scorer_is_made_once():
    made = []
    make = lambda: made.append(1) or frames.stub_scorer
    assert frames.scorer_of("one", make) is frames.scorer_of("one", make) and len(made) == 1
    frames.scorer_of("two", make)
    assert len(made) == 2 and list(frames._SCORERS) == ["two"]


BASE = 0x0F0F0F0F0F0F0F0F
NEAR, FAR = BASE ^ 0b1011, BASE ^ 0xFFFF000000000000


def qc_rows(spark, rows):
    """(file_id, flags, hash, device, shoot_key, boxes)"""
    full = []
    for i, flags, h, device, t, boxes in rows:
        inside = ",".join('{"x":%s,"y":%s,"w":%s,"h":%s}' % b for b in boxes)
        full.append((i, flags, f'{{"flags":{flags},"lensDirt":{{"conf":0.1,"boxes":[{inside}]}}}}' if boxes else "{}", f"{h:016x}", device, t, 1, 1, 5, 0))
    return spark.createDataFrame(full, S.QC)


def test_bursts(spark):
    day = "2026-09-26 10:00:"
    qc = qc_rows(spark, [(1, 0, BASE, "CamX", day + "00", []), (2, 0, NEAR, "CamX", day + "01", []), (3, 0, FAR, "CamX", day + "02", [])])
    assert [tuple(r) for r in reconcile.burst_pairs(qc).collect()] == [(2, 1, 3)]
    assert [tuple(r) for r in reconcile.reconciled(qc, 5).collect()] == [(2, 0, 1)]
    apart = spark.createDataFrame([(2, 1, 0.5)], "file_id long, other_id long, diff double")
    assert reconcile.reconciled(qc, 5, apart).count() == 0
    far = qc_rows(spark, [(1, 0, BASE, "CamX", day + "00", []), (2, 0, NEAR, "CamX", day + "30", [])])
    assert reconcile.burst_pairs(far).count() == 0
    broken = qc_rows(spark, [(1, 2, BASE, "CamX", day + "00", []), (2, 0, NEAR, "CamX", day + "01", [])])
    assert reconcile.burst_pairs(broken).count() == 0


def test_burst_over_midnight(spark):
    times = ["2026-01-01 23:59:58", "2026-01-01 23:59:59", "2026-01-02 00:00:01", "2026-01-02 00:00:03", "2026-01-02 00:00:06", "2026-01-03 00:00:05"]
    qc = qc_rows(spark, [(k, 0, BASE, "C", t, []) for k, t in enumerate(times)])
    got = {r["file_id"]: (r["anchor_id"], r["members"]) for r in reconcile.burst_clusters(qc).collect()}
    assert got == {k: (0, 4) for k in range(4)}


def test_lens_dirt(spark):
    middle, corner = (0.375, 0.375, 0.25, 0.25), (0.9, 0.1, 0.08, 0.08)
    x = [(1, 8, BASE, "CamX", "", [middle]), (2, 8, BASE, "CamX", "", [middle]), (3, 8, BASE, "CamX", "", [corner]), (4, 0, BASE, "CamX", "", [])]
    y = [(11, 8, BASE, "CamY", "", [middle]), (12, 0, BASE, "CamY", "", [])]
    z = [(21, 8, BASE, "CamZ", "", [middle]), (22, 0, BASE, "CamZ", "", []), (23, 2, BASE, "CamZ", "", [])]
    assert [tuple(r) for r in reconcile.reconciled(qc_rows(spark, x + y + z), 5).collect()] == [(3, 8, 0)]


def test_candidates_are_the_smallest_others(spark):
    qc = qc_rows(spark, [(k, 2 if k == 3 else 0, BASE if k < 40 else FAR, "", "", []) for k in range(41)])
    got = {}
    for r in dedup.candidates(qc).collect():
        got.setdefault(r["file_id"], []).append(r["other_id"])
    sound = [k for k in range(40) if k != 3]
    assert {k: sorted(v) for k, v in got.items()} == {k: [x for x in sound if x != k][:20] for k in range(40)}


def test_near_hashes_are_all_pairs_within_five_bits(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 8)]
    hashes = {b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(8)}
    qc = qc_rows(spark, [(k, 0, h, "", "", []) for k, h in enumerate(hashes)])
    want = {(f"{a:016x}", f"{b:016x}") for a in hashes for b in hashes if f"{a:016x}" < f"{b:016x}" and bin(a ^ b).count("1") <= 5}
    for bands in (6, 7, 8):
        got = [(r["hash_a"], r["hash_b"]) for r in dedup.near_hashes(qc, bands=bands).collect()]
        assert set(got) == want and len(got) == len(want)


def test_upsert_and_quantile_sketch(spark):
    old = qc_rows(spark, [(1, 4, BASE, "", "", []), (2, 0, BASE, "", "", [])])
    new = qc_rows(spark, [(2, 8, FAR, "", "", [])]).withColumn("flags", F.lit(None).cast("int")).withColumn("detail", F.lit(None).cast("string"))
    assert {r["file_id"]: (r["flags"], r["detail"]) for r in verdict.saved(old, new).collect()} == {1: (4, "{}"), 2: (0, "")}
    metrics = spark.range(1000).select(F.col("id").cast("double").alias("m"))
    exact, sketch = (calibrate.quantiles(metrics, ["m"], a).first() for a in (None, 1000))
    assert exact["p95"] == pytest.approx(949.05) and abs(sketch["p95"] - 949) <= 1


def linked(pairs):
    """{node: smallest node that it is connected to}."""
    to = {}
    for a, b in pairs:
        to.setdefault(a, {a}).add(b)
        to.setdefault(b, {b}).add(a)
    name = {}
    for start in sorted(to):
        todo = [start] if start not in name else []
        while todo:
            x = todo.pop()
            if x not in name:
                name[x] = start
                todo += to[x]
    return name


def test_components(spark):
    rng = np.random.default_rng(6)
    chain = [(k, k + 1) for k in range(1000, 1060)]
    star = [(5000, 5001 + k) for k in range(300)]
    some = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))]
    for pairs in (chain[::-1] + star + some + some[:9] + [(7000, 7000)], []):
        got = [(r["node"], r["component"]) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()]
        assert len(got) == len({n for n, _ in got}) and dict(got) == linked(pairs)


def test_near_groups(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    hashes = [b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(9)]
    qc = qc_rows(spark, [(k, 0, h, "", "", []) for k, h in enumerate(hashes + hashes[:5])])
    text = [f"{h:016x}" for h in hashes]
    name = linked([(a, b) for a in text for b in text if bin(int(a, 16) ^ int(b, 16)).count("1") <= 5])
    files = {}
    for h in text + text[:5]:
        files[name[h]] = files.get(name[h], 0) + 1
    got = {r["dup_hash"]: (r["group_hash"], r["files"]) for r in dedup.near_groups(qc).collect()}
    assert got == {h: (name[h], files[name[h]]) for h in text}
    assert [dedup.bands_for(n) for n in (0, 200_000, 300_000, 20_000_000, 10**9, 10**12)] == [7, 7, 8, 9, 10, 13]


def test_pixels_of_many_pairs_are_not_broadcast(spark):
    rows = [(k, 0, 8, 8, bytearray(bytes([k * 40]) * 64)) for k in range(4)]
    few = spark.createDataFrame(rows, S.FRAME).mapInPandas(lambda batches: batches, S.FRAME)
    pairs = spark.range(1, frames.FEW_PAIRS + 3).select(F.col("id").alias("file_id"), (F.col("id") - 1).alias("other_id"))
    for some, sent in ((pairs, 0), (pairs.where("file_id < 9"), 2)):
        found = frames.pixel_differences(some, few)
        assert {tuple(r) for r in found.collect()} == {(k, k - 1, 1.0) for k in (1, 2, 3)}
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("BroadcastHashJoin") == sent


def test_frames_made_where_they_are_compared(spark):
    """Rows equal those of stored frames: several frames a file, frames without a partner, other sizes, no bytes, files that are missing or not asked for."""
    rng = np.random.default_rng(8)
    scene = rng.integers(0, 60, (3, 9, 64)).astype(np.uint8)
    stored = {k: [(f, bytes((scene[f] + rng.integers(0, 40)).tobytes()[: 64 * (7 if k % 5 == 4 else 9)])) for f in range(3) if (k + f) % 4] for k in range(40)}
    stored[7], stored[8], stored[9] = [], [(0, None), (1, b"")], [(k, x[:64] if k == 1 else x) for k, x in stored[13]]
    stored[20] = [*stored[21], *stored[22]]
    rows = [(k, f, 64, 9, x) for k, own in stored.items() for f, x in own]

    def decode(batches):
        for part in batches:
            assert len(set(part.column("file_id").to_pylist())) == part.num_rows
            found = [(k, f, 64, 9, x) for k, p in zip(*(part.column(c).to_pylist() for c in ("file_id", "path")), strict=True) for f, x in stored[int(p[1:])]]
            columns = [pa.array([r[c] for r in found], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file_id", "frame_idx", "w", "h", "gray"])

    files = spark.createDataFrame([(k, f"p{k}") for k in stored], "file_id long, path string")
    pairs = [(k, 13) for k in stored] + [(k, k - 1) for k in stored] + [(5, 13), (99, 13), (5, 99)]
    some = spark.createDataFrame(pairs, "file_id long, other_id long")
    want = {(r["file_id"], r["other_id"]): r["diff"] for r in frames.pixel_differences(some, spark.createDataFrame(rows, S.FRAME)).collect()}
    for at_once in (1, 7, 100):
        got = [(r["file_id"], r["other_id"], r["diff"]) for r in frames.differences_of(some, files, decode, at_once).collect()]
        assert len(got) == len(want) > 40 and {(a, b): d for a, b, d in got} == pytest.approx(want)
    assert want[13, 13] == 0 and (7, 13) not in want and (8, 13) not in want


def test_pixels_of_pixel_diff_are_not_shuffled(spark):
    """Ids are dealt out, and nothing is after the frames are made; ranges take one pair after the other, so a file in all pairs is not one task."""
    found = QUERIES["pixel_diff"](spark, "/root/testdata/sf0.001")
    lines = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
    made = [k for k, x in enumerate(lines) if "MapIn" in x]
    moved = [k for k, x in enumerate(lines) if "Exchange" in x]
    assert len(made) == 1 and moved and min(moved) > made[0] and not any("gray" in lines[k] for k in moved)
    pairs = spark.range(1, 4001).select(F.col("id").alias("file_id"), F.lit(0).alias("other_id"))

    def decode(batches):
        for part in batches:
            n = part.num_rows
            columns = [part.column("file_id"), pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array([b"x"] * n)]
            yield pa.RecordBatch.from_arrays(columns, names=["file_id", "frame_idx", "w", "h", "gray"])

    dealt = frames.differences_of(pairs, spark.range(4001).select(F.col("id").alias("file_id")), decode, 100)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1000


def test_crops_at_one_place_are_scored_once(spark):
    """A square image no larger than a crop is one crop, and frames without a vote are not scored at all."""
    rng = np.random.default_rng(6)
    for h, w, n in ((32, 32, 1), (32, 40, 3), (224, 224, 1), (300, 240, 9)):
        rgb = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        found, of = frames.distinct_crops(rgb)
        ys, xs = (np.arange(max(x, round(x * 224 / min(h, w)))) * x // max(x, round(x * 224 / min(h, w))) for x in (h, w))
        big = rgb[ys][:, xs].transpose(2, 0, 1).astype(np.float32) / 255
        starts = [(y, x) for y in np.linspace(0, len(ys) - 224, 3).astype(int) for x in np.linspace(0, len(xs) - 224, 3).astype(int)]
        assert len(found) == n and np.array_equal(found[of], np.stack([big[:, y : y + 224, x : x + 224] for y, x in starts]))
    rows = [(1, k * 50, 32, 32, bytearray(bytes([k]) * 3072)) for k in range(6)]
    images = spark.createDataFrame(rows, "file_id long, frame_idx int, w int, h int, rgb binary").coalesce(1)

    def make():
        def score(batch):
            assert len(batch) == 3 and set((batch[:, 0, 0, 0] * 255).round()) == {0, 2, 4}
            return frames.stub_scorer(batch)

        return score

    assert frames.scored(verdict.ai_frames(images), make).count() == 3


def test_wanted_metrics_are_those_of_all(spark):
    rng = np.random.default_rng(7)
    sizes = [(64, 64), (64, 64), (20, 33), (64, 64), (90, 70), (64, 64)]
    rows = [(k, k, w, h, bytearray(rng.integers(0, 256, w * h).astype(np.uint8).tobytes())) for k, (w, h) in enumerate(sizes)]
    rows += [(6, 6, 64, 64, bytearray(b"short")), (7, 7, 64, 64, None), (8, 8, None, 64, bytearray(64))]
    some = spark.createDataFrame(rows, S.FRAME)
    every = {r["file_id"]: r.asDict() for r in frames.frame_metrics(some, costly_every=2).collect()}
    assert [k for k, r in every.items() if r["corrupted"]] == [6, 7, 8] and every[1]["lap_std"] is None and every[0]["lap_std"] > 0
    wanted = ["noise_floor", "dup_hash", "clip_low"]
    assert {r["file_id"]: r.asDict() for r in frames.frame_metrics(some, 2, wanted).collect()} == {k: {c: r[c] for c in ("file_id", "frame_idx", *wanted)} for k, r in every.items()}
    for k in range(6):
        gray = np.frombuffer(rows[k][4], np.uint8).reshape(sizes[k][1], sizes[k][0])
        small = frames.resized(gray, 64, 64).astype(float)
        assert every[k]["gray_std"] == pytest.approx(small.std()) and every[k]["exp_mean"] == small.mean() and every[k]["dup_hash"] == frames.perceptual_hash(small)
        if k % 2 == 0:
            lap = 4.0 * gray[1:-1, 1:-1] - gray[1:-1, :-2] - gray[1:-1, 2:] - gray[:-2, 1:-1] - gray[2:, 1:-1]
            cells = [gray[y : y + 16, x : x + 16].std() for y in range(0, gray.shape[0] - 15, 16) for x in range(0, gray.shape[1] - 15, 16)]
            assert every[k]["lap_std"] == pytest.approx(lap.std())
            assert every[k]["noise_floor"] == pytest.approx(sorted(cells)[len(cells) // 10] if min(gray.shape) >= 32 else 0)


def test_small_images_are_scored_in_their_own_pixels(spark):
    """For a scorer of any size the rows are those of enlarged crops; where pixels would not be repeated as often, crops are enlarged."""
    rng = np.random.default_rng(9)
    sizes = {(32, 32): (1, 32), (32, 64): (3, 32), (28, 56): (3, 28), (224, 300): (3, 224), (56, 59): None, (20, 30): None, (300, 240): (9, 224)}
    images = []
    for (h, w), own in sizes.items():
        stack = rng.integers(0, 256, (5, h, w, 3)).astype(np.uint8)
        small = frames.own_crops(stack)
        assert (small is None) == (own is None), (h, w)
        if own:
            found, of = small
            full = [frames.distinct_crops(x) for x in stack]
            assert found.shape == (5, own[0], 3, own[1], own[1]) and np.array_equal(of, full[0][1])
            assert np.array_equal(found.repeat(224 // own[1], axis=3).repeat(224 // own[1], axis=4), np.stack([x for x, _ in full]))
        images += [*stack]
    images[3][:], images[-1][:] = 255, 255

    def make(any_size):
        def score(batch):
            assert batch.shape[2] in ((28, 32, 224) if any_size else (224,)) and batch[0].size * len(batch) <= 4 * 9 * 3 * 224**2
            if (batch.reshape(len(batch), -1).min(axis=1) == 1).any():
                raise ValueError("white")
            return frames.stub_scorer(batch)

        score.any_size = any_size
        return lambda: score

    rows = [(k, 0, x.shape[1], x.shape[0], bytearray(x.tobytes())) for k, x in enumerate(images)] + [(90, 0, 32, 32, bytearray(5)), (91, 0, 32, 32, None)]
    some = spark.createDataFrame(rows, "file_id long, frame_idx int, w int, h int, rgb binary").coalesce(1)
    plain, small = ({r["file_id"]: tuple(r)[1:] for r in frames.scored(some, make(x), at_once=4).collect()} for x in (False, True))
    assert sorted(plain) == sorted(small) == [k for k in range(35) if k not in (3, 34)]
    assert all(small[k] == pytest.approx(plain[k], rel=1e-9) for k in plain)
    paths = some.select(F.col("file_id").alias("path"), "w", "h", "rgb")

    def decode(batches):
        for part in batches:
            names = ["file_id", "w", "h", "rgb", "frame_idx"]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([0] * part.num_rows, pa.int32())], names=names)

    assert {r["file_id"]: tuple(r)[1:] for r in frames.scored(paths, make(True), at_once=4, decode=decode).collect()} == small


def test_images_of_ai_scores_are_made_where_they_are_scored(spark):
    """One step in Python, and frames without a vote are left out before it."""
    lines = QUERIES["ai_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    made = [k for k, x in enumerate(lines) if "MapIn" in x]
    assert len(made) == 1 and any("% 100) = 0" in x for x in lines[made[0] :]) and not any("gray" in x or "rgb" in x for x in lines)
