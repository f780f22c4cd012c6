"""Detector results: duplicates, bursts, lens dirt, votes, shake, calibration, frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.functions import values as V
from lumaframe.operators import calibrate, dedup, frames, reconcile, verdict
from lumaframe.queries.registry import query

CANDIDATES = """
    , cand AS (SELECT file_id, other_id FROM (SELECT a.file_id, b.file_id AS other_id, row_number() OVER (PARTITION BY a.file_id ORDER BY b.file_id) AS n
                 FROM qc a JOIN qc b ON a.dup_hash = b.dup_hash AND a.file_id <> b.file_id WHERE a.dup_hash <> '' AND b.flags & 2 = 0) WHERE n <= 20)"""
GATED = f"""{CANDIDATES}
    , gate AS (SELECT c.file_id, c.other_id FROM cand c JOIN qc a ON a.file_id = c.file_id JOIN qc b ON b.file_id = c.other_id
               WHERE NOT (a.device <> '' AND b.device <> '' AND a.device <> b.device)
                 AND NOT coalesce(abs(epoch(try_strptime(a.shoot_key, '%Y-%m-%d %H:%M:%S')) - epoch(try_strptime(b.shoot_key, '%Y-%m-%d %H:%M:%S'))) > 10, false))"""


@query("qc", f"{CANDIDATES} SELECT file_id, other_id FROM cand")
def dup_candidates(v):
    return dedup.candidates(v("qc"))


@query("qc", f"{GATED} SELECT file_id, other_id FROM gate")
def dup_gated(v):
    return dedup.gated(dedup.candidates(v("qc")), v("qc"))


def _diffs(pairs):
    """A pixel difference for most pairs, by arithmetic: the tables have no pixels."""
    total = F.col("file_id") + F.col("other_id")
    return pairs.where(total % 11 != 0).select("file_id", "other_id", (total % 10 / 100.0).alias("diff"))


@query("qc file", f"""{CANDIDATES}
    SELECT DISTINCT c.file_id FROM cand c JOIN file f ON f.id = c.file_id
    WHERE (c.file_id + c.other_id) % 11 <> 0 AND c.other_id < c.file_id AND ((f.kind = 2 AND (c.file_id + c.other_id) % 10 = 0) OR (f.kind <> 2 AND (c.file_id + c.other_id) % 10 <= 5))""")
def dup_marked(v):
    pairs = dedup.candidates(v("qc"))
    return dedup.duplicates(dedup.passing(pairs, _diffs(pairs), v("file")))


@query("qc file", """
    SELECT q.dup_hash, count(*) AS files, min(q.file_id) AS first_id, CAST(sum(f.size) - arg_min(f.size, q.file_id) AS BIGINT) AS redundant_bytes
    FROM qc q JOIN file f ON f.id = q.file_id WHERE q.dup_hash <> '' GROUP BY q.dup_hash HAVING count(*) > 1""")  # fmt: skip
def dup_groups(v):
    return dedup.hash_groups(v("qc"), v("file"))


@query("qc", """
    , h AS (SELECT dup_hash, count(*) AS n, CAST('0x' || dup_hash AS UBIGINT) AS x FROM qc WHERE dup_hash <> '' GROUP BY dup_hash)
    SELECT a.dup_hash AS hash_a, b.dup_hash AS hash_b, CAST(bit_count(xor(a.x, b.x)) AS INT) AS distance, a.n AS files_a, b.n AS files_b
    FROM h a JOIN h b ON a.dup_hash < b.dup_hash AND bit_count(xor(a.x, b.x)) <= 5""")  # fmt: skip
def near_dup_pairs(v):
    return dedup.near_pairs(v("qc"))


@query("qc", """
    , h AS (SELECT dup_hash, count(*) AS n, CAST('0x' || dup_hash AS UBIGINT) AS x FROM qc WHERE dup_hash <> '' GROUP BY dup_hash),
    link AS (SELECT a.dup_hash AS a, b.dup_hash AS b FROM h a JOIN h b ON bit_count(xor(a.x, b.x)) <= 5),
    reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
    named AS (SELECT a AS dup_hash, min(b) AS group_hash FROM reach GROUP BY a)
    SELECT m.dup_hash, m.group_hash, CAST(sum(h.n) OVER (PARTITION BY m.group_hash) AS BIGINT) AS files FROM named m JOIN h ON h.dup_hash = m.dup_hash""")  # fmt: skip
def near_dup_groups(v):
    return dedup.near_groups(v("qc"))


BURSTS = """
    , timed AS (SELECT file_id, device, CAST('0x' || dup_hash AS UBIGINT) AS h, epoch(try_strptime(shoot_key, '%Y-%m-%d %H:%M:%S')) AS t
                FROM qc WHERE device <> '' AND flags & 2 = 0 AND dup_hash <> '' AND try_strptime(shoot_key, '%Y-%m-%d %H:%M:%S') IS NOT NULL {more}),
    steps AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY device ORDER BY t, file_id) <= 2 THEN 0 ELSE 1 END AS new FROM timed),
    chains AS (SELECT *, sum(new) OVER (PARTITION BY device ORDER BY t, file_id ROWS UNBOUNDED PRECEDING) AS c FROM steps),
    burst AS (SELECT *, min(file_id) OVER (PARTITION BY device, c) AS anchor_id, count(*) OVER (PARTITION BY device, c) AS members FROM chains)"""
PAIRS = """
    , pair AS (SELECT b.file_id, b.anchor_id, bit_count(xor(b.h, a.h)) AS distance FROM burst b JOIN burst a ON a.file_id = b.anchor_id
               WHERE b.members > 1 AND b.file_id <> b.anchor_id AND bit_count(xor(b.h, a.h)) <= 5)"""


@query("qc", BURSTS.replace("{more}", "") + " SELECT file_id, device, anchor_id, members FROM burst WHERE members > 1")
def burst_clusters(v):
    return reconcile.burst_clusters(v("qc")).select("file_id", "device", "anchor_id", "members")


@query("qc", BURSTS.replace("{more}", "") + PAIRS + " SELECT file_id, anchor_id, CAST(distance AS INT) AS distance FROM pair")
def burst_pairs(v):
    return reconcile.burst_pairs(v("qc"))


DIRT = """
    , sound AS (SELECT file_id, device, flags, CAST(json_extract(detail, '$.lensDirt.boxes[0].x') AS DOUBLE) AS x, CAST(json_extract(detail, '$.lensDirt.boxes[0].y') AS DOUBLE) AS y
                FROM qc WHERE device <> '' AND flags & 2 = 0 {more}),
    sized AS (SELECT device FROM sound GROUP BY device HAVING count(*) >= 3),
    dirt AS (SELECT a.file_id FROM sound a WHERE a.flags & 8 <> 0 AND a.x IS NOT NULL AND a.device IN (SELECT device FROM sized) AND NOT EXISTS (
               SELECT 1 FROM sound b WHERE b.device = a.device AND b.file_id <> a.file_id AND b.x IS NOT NULL
                 AND greatest(0.25 - abs(a.x - b.x), 0) * greatest(0.25 - abs(a.y - b.y), 0) / (0.125 - greatest(0.25 - abs(a.x - b.x), 0) * greatest(0.25 - abs(a.y - b.y), 0)) >= 0.5))"""


@query("qc", DIRT.replace("{more}", "") + " SELECT file_id FROM dirt")
def dirt_unconfirmed(v):
    return reconcile.unconfirmed_dirt(v("qc"))


@query("qc", BURSTS.replace("{more}", "AND qc_version = 5") + PAIRS + DIRT.replace("{more}", "AND qc_version = 5") + """
    , new AS (SELECT q.file_id, q.flags AS old_flags,
                CASE WHEN p.file_id IS NOT NULL AND (p.file_id + p.anchor_id) % 11 <> 0 AND (p.file_id + p.anchor_id) % 10 > 5
                     THEN ((q.flags | 1) & ~(CASE WHEN d.file_id IS NULL THEN 0 ELSE 8 END)) & ~1
                     ELSE (q.flags | CASE WHEN p.file_id IS NULL THEN 0 ELSE 1 END) & ~(CASE WHEN d.file_id IS NULL THEN 0 ELSE 8 END) END AS new_flags
              FROM qc q LEFT JOIN pair p ON p.file_id = q.file_id LEFT JOIN dirt d ON d.file_id = q.file_id WHERE q.qc_version = 5)
    SELECT file_id, old_flags, new_flags FROM new WHERE old_flags <> new_flags""")  # fmt: skip
def reconciled(v):
    qc = v("qc")
    pairs = reconcile.burst_pairs(qc.where(F.col("qc_version") == S.ALGORITHM_VERSION)).select("file_id", F.col("anchor_id").alias("other_id"))
    return reconcile.reconciled(qc, S.ALGORITHM_VERSION, _diffs(pairs))


@query("", """
    WITH v AS (SELECT vec_id, embedding AS e, list_sort(embedding[2:64])[32] AS mid FROM embeddings)
    SELECT vec_id, list_transform(e, lambda x: CASE WHEN x > mid THEN 1 ELSE 0 END) AS bits, mid AS middle FROM v""")  # fmt: skip
def hash_bits(v):
    """The median step of the perceptual hash over 64 values, the first left out of the median."""
    e = F.col("embedding")
    middle = F.get(F.sort_array(F.slice(e, 2, 63)), F.lit(31))
    return v("embeddings").select("vec_id", F.transform(e, lambda x: (x > middle).cast("int")).alias("bits"), middle.alias("middle"))


def _files(v):
    return v("orders").select((F.col("o_orderkey") + 1).alias("file_id"))


def _decoder(side: int = 64, rgb: bool = False):
    """A decoder of files (file_id) to one gray raster each, by a formula of the key, or to one whose bytes are those of the gray one three times."""
    y, x = (a.ravel() for a in np.mgrid[0:side, 0:side])
    # bytes wrap at 256 as the formula does, and x * y * k % 97 depends on k % 97
    rights, downs = (np.outer(np.arange(n), a).astype(np.uint8) for n, a in ((7, x), (5, y)))
    textures = (np.outer(np.arange(97), x * y) % 97).astype(np.uint8)

    def run(batches):
        for part in batches:
            for at in range(0, part.num_rows, 256):
                k = part.column("file_id").slice(at, 256).to_numpy(zero_copy_only=False) - 1
                pixels = rights[k % 7]
                pixels += downs[k % 5]
                pixels += (k * 37 % 256).astype(np.uint8)[:, None]
                rough = k % 3 == 0
                pixels[rough] += textures[k[rough] % 97]
                if rgb:
                    pixels = np.tile(pixels, 3)
                ends = pa.array(np.arange(len(k) + 1, dtype=np.int32) * pixels.shape[1])
                gray = pa.BinaryArray.from_buffers(pa.binary(), len(k), [None, ends.buffers()[1], pa.py_buffer(pixels)])
                size = pa.array(np.full(len(k), side, np.int32))
                columns = [pa.array(k + 1), pa.array(np.zeros(len(k), np.int32)), size, size, gray]
                yield pa.RecordBatch.from_arrays(columns, names=["file_id", "frame_idx", "w", "h", "rgb" if rgb else "gray"])

    return run


def _dealt(files):
    """Files dealt out, so that pixels are made where they are used."""
    return files.repartition(2 * files.sparkSession.sparkContext.defaultParallelism, "file_id")


def _rasters(v):
    """A gray raster for each file."""
    return _dealt(_files(v)).mapInArrow(_decoder(), S.FRAME)


#: The pixel formula in DuckDB, at a place given by SQL terms.
def _pixel(k: str, x: str, y: str) -> str:
    return f"(({x}) * ({k} % 7) + ({y}) * ({k} % 5) + {k} * 37 % 256 + CASE WHEN {k} % 3 = 0 THEN ({x}) * ({y}) * {k} % 97 ELSE 0 END) % 256"


GRID = "(SELECT CAST(i AS BIGINT) AS y FROM range(64) t(i)) ys, (SELECT CAST(i AS BIGINT) AS x FROM range(64) t(i)) xs"
AROUND = " - ".join(["4 * g", *(_pixel("k", x, y) for x, y in (("x - 1", "y"), ("x + 1", "y"), ("x", "y - 1"), ("x", "y + 1")))])


@query("", f"""
    WITH p AS (SELECT o_orderkey AS k, x, y, {_pixel('o_orderkey', 'x', 'y')} AS g FROM orders, {GRID}),
    q AS (SELECT k, x, y, g, CASE WHEN x BETWEEN 1 AND 62 AND y BETWEEN 1 AND 62 THEN {AROUND} END AS lap FROM p),
    cell AS (SELECT k, x // 16 AS cx, y // 16 AS cy, sqrt(greatest(avg(g * g) - avg(g) * avg(g), 0)) AS dev FROM p GROUP BY ALL),
    noise AS (SELECT k, list_sort(list(dev))[2] AS noise_floor FROM cell GROUP BY k)
    SELECT q.k + 1 AS file_id, 0 AS frame_idx, false AS corrupted, round(sqrt(greatest(avg(g * g) - avg(g) * avg(g), 0)), 6) AS gray_std, avg(g) AS exp_mean,
           avg(CASE WHEN g <= 8 THEN 1.0::DOUBLE ELSE 0 END) AS clip_low, avg(CASE WHEN g >= 247 THEN 1.0::DOUBLE ELSE 0 END) AS clip_high,
           round(sqrt(greatest(avg(lap * lap) - avg(lap) * avg(lap), 0)), 6) AS lap_std, round(any_value(noise_floor), 6) AS noise_floor
    FROM q JOIN noise USING (k) GROUP BY q.k""")  # fmt: skip
def frame_metrics(v):
    rows = frames.frame_metrics(_rasters(v), wanted=frames.METRIC_NAMES[:7])
    return rows.withColumns({c: F.round(c, 6) for c in ("gray_std", "lap_std", "noise_floor")})


@query()
def frame_marks(v):
    """Lens dirt and perceptual hash of each raster."""
    return frames.frame_metrics(_rasters(v), wanted=["dirt_conf", "dup_hash"])


@query("", f"""
    WITH pair AS (SELECT a.o_orderkey AS k, b.o_orderkey AS m FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey - a.o_orderkey % 3 AND a.o_orderkey % 3 <> 0)
    SELECT k + 1 AS file_id, m + 1 AS other_id, avg(CASE WHEN abs({_pixel('k', 'x', 'y')} - {_pixel('m', 'x', 'y')}) > 25 THEN 1.0::DOUBLE ELSE 0 END) AS diff
    FROM pair, {GRID} GROUP BY k, m""")  # fmt: skip
def pixel_diff(v):
    pairs = v("orders").select((F.col("o_orderkey") + 1).alias("file_id"), (F.col("o_orderkey") - F.col("o_orderkey") % 3 + 1).alias("other_id")).where("file_id <> other_id")
    return frames.differences_of(pairs, _files(v), _decoder(), at_once=512)


def _profile(name: str, along: str) -> str:
    """SQL for (k, v): smoothed means of the raster's pixels for each place along an axis."""
    means = f"(SELECT k, list(m ORDER BY {along}) AS u FROM (SELECT k, {along}, CAST(sum(g) AS DOUBLE) / 64 AS m FROM p GROUP BY ALL) GROUP BY k)"
    return f"{name} AS (SELECT k, list_transform(range(1, 65), lambda i: CASE WHEN i IN (1, 64) THEN u[i] ELSE (u[i - 1] + u[i] + u[i + 1]) / 3 END) AS v FROM {means})"


def _distances(a: str, b: str) -> str:
    """SQL for the mean distance of two profiles at each of 17 offsets."""
    return f"list_transform(range(-8, 9), lambda d: round(list_avg(list_transform(range(greatest(1, 1 - d), least(64, 64 - d) + 1), lambda i: abs({a}[i] - {b}[i + d]))), 9))"


@query("", f"""
    WITH p AS (SELECT o_orderkey AS k, x, y, {_pixel('o_orderkey', 'x', 'y')} AS g FROM orders, {GRID}),
    {_profile('r', 'y')}, {_profile('c', 'x')},
    s AS (SELECT r.k, (r.k + 1) // 10 AS file_id, (r.k + 1) % 10 AS frame_idx, r.v AS rows, c.v AS cols FROM r JOIN c ON c.k = r.k),
    t AS (SELECT *, lag(rows) OVER own AS r0, lag(cols) OVER own AS c0 FROM s WINDOW own AS (PARTITION BY file_id ORDER BY frame_idx)),
    d AS (SELECT file_id, frame_idx, CASE WHEN r0 IS NOT NULL THEN {_distances('r0', 'rows')} END AS dr, CASE WHEN c0 IS NOT NULL THEN {_distances('c0', 'cols')} END AS dc FROM t)
    SELECT file_id, CAST(frame_idx AS INTEGER) AS frame_idx, CAST(coalesce(list_position(dr, list_min(dr)) - 9, 0) AS INTEGER) AS dy,
           CAST(coalesce(list_position(dc, list_min(dc)) - 9, 0) AS INTEGER) AS dx, round(coalesce(greatest(list_min(dr), list_min(dc)), 0), 6) AS dist FROM d""")  # fmt: skip
def frame_shifts(v):
    clips = _rasters(v).withColumn("frame_idx", (F.col("file_id") % 10).cast("int")).withColumn("file_id", F.floor(F.col("file_id") / 10))
    return frames.shifts(frames.projections(clips)).withColumn("dist", F.round("dist", 6))


@query("", f"""
    WITH p AS (SELECT o_orderkey AS k, {_pixel('o_orderkey', 'x', 'y')} AS g FROM orders, {GRID.replace('64', '32')}),
    q AS (SELECT k, CAST(CAST(g AS FLOAT) / CAST(255 AS FLOAT) AS DOUBLE) AS g FROM p),
    m AS (SELECT k + 1 AS n, avg(g) AS mean, stddev_pop(g) AS dev FROM q GROUP BY k),
    s AS (SELECT n // 6 AS file_id, 1 / (1 + exp(10 * dev - 1)) AS blur, 1 / (1 + exp(3 - 10 * dev)) AS noise, 1 / (1 + exp(8 * mean - 2)) AS dirt FROM m WHERE n % 6 IN (0, 2, 4)),
    a AS (SELECT file_id, avg(blur) AS blur, avg(noise) AS noise, avg(dirt) AS dirt FROM s GROUP BY file_id)
    SELECT file_id, round(blur, 6) AS blur, round(noise, 6) AS noise, round(dirt, 6) AS dirt, blur > 0.86 OR noise > 0.29 OR dirt > 0.66 AS suspect FROM a""")  # fmt: skip
def ai_scores(v):
    in_clip = ((F.col("file_id") % 6) * 50).cast("int")
    voting = verdict.ai_frames(_files(v).withColumn("frame_idx", in_clip))  # the others are not even made
    scores = frames.scored(_dealt(voting.select("file_id")), lambda: frames.stub_scorer, decode=_decoder(32, rgb=True))
    clips = scores.withColumn("frame_idx", in_clip).withColumn("file_id", F.floor(F.col("file_id") / 6))
    return verdict.ai_votes(clips).withColumns({c: F.round(c, 6) for c in ("blur", "noise", "dirt")})


FLAGS = """CASE WHEN corrupted THEN 2 ELSE CASE WHEN gray_std < {blank} THEN 4 ELSE 0 END + CASE WHEN dirty THEN 8 ELSE 0 END + CASE WHEN gray_std >= {blank} AND lap_std < {blur} THEN 16 ELSE 0 END
    + CASE WHEN (exp_mean < 100 AND clip_low > 0.35) OR (exp_mean > 150 AND clip_high > 0.8) THEN 32 ELSE 0 END + CASE WHEN noise_floor > {noise} THEN 64 ELSE 0 END END"""


def _metrics(v):
    box = F.struct(*[F.lit(0.25).alias(n) for n in "xywh"])
    none = F.array().cast(f"array<{S.BOX}>")
    return v("metric").select("*", F.lit(0.1).alias("dirt_conf"), F.when(F.col("dirty"), F.array(box)).otherwise(none).alias("dirt_boxes"), F.lit("0f0f0f0f0f0f0f0f").alias("dup_hash"))


@query("metric", "SELECT file_id, tie, " + FLAGS.format(blank="8", blur="15", noise="5") + " AS flags FROM metric")
def image_verdict(v):
    return verdict.image_verdicts(_metrics(v)).select("file_id", "tie", "flags")


@query("metric", "SELECT flags_before, flags_after, count(*) AS n FROM (SELECT " + FLAGS.format(blank="8", blur="15", noise="5") + " AS flags_before, " + FLAGS.format(blank="20", blur="60", noise="7") + " AS flags_after FROM metric) GROUP BY 1, 2")
def rethreshold(v):
    """New thresholds over stored metrics: a projection, no pixel is read again. 80 is brought back to the limit of 60."""
    new = S.clamped(S.Thresholds(blank_std=20, blur_lap_std=80, noise_floor=7))
    after = verdict.image_verdicts(verdict.image_verdicts(_metrics(v)).withColumnRenamed("flags", "flags_before").drop("detail"), new)
    return after.groupBy("flags_before", F.col("flags").alias("flags_after")).agg(F.count(F.lit(1)).alias("n"))


@query("qc", "SELECT file_id, flags AS old_flags, CAST(xor(flags, CASE WHEN file_id % 2 = 0 THEN 16 ELSE 0 END) AS INT) AS new_flags FROM qc WHERE file_id % 2 = 0")
def flag_updates(v):
    changes = v("qc").select("file_id", F.col("flags").bitwiseXOR(F.when(F.col("file_id") % 2 == 0, 16).otherwise(0)).alias("flags"))
    return verdict.updated_flags(v("qc"), changes)


@query("frame_hit", """
    , share AS (SELECT file_id, avg(CASE WHEN blank THEN 1.0 ELSE 0 END) AS blank, avg(CASE WHEN dirt THEN 1.0 ELSE 0 END) AS dirt, avg(CASE WHEN under OR over THEN 1.0 ELSE 0 END) AS exposure,
                  coalesce(avg(CASE WHEN frame_idx % 5 = 0 THEN CASE WHEN blur AND NOT blank THEN 1.0 ELSE 0 END END), 0) AS blur, coalesce(avg(CASE WHEN frame_idx % 5 = 0 THEN CASE WHEN noise THEN 1.0 ELSE 0 END END), 0) AS noise,
                  count(*) FILTER (WHERE under) >= count(*) FILTER (WHERE over) AS under, max(frame_idx) FILTER (WHERE dirt) AS dirt_frame, arg_min(dup_hash, frame_idx) AS dup_hash FROM frame_hit GROUP BY file_id)
    SELECT file_id, CASE WHEN blank > 0.3 THEN 4 ELSE 0 END + CASE WHEN dirt > 0.3 THEN 8 ELSE 0 END + CASE WHEN exposure > 0.3 THEN 32 ELSE 0 END + CASE WHEN blur > 0.3 THEN 16 ELSE 0 END + CASE WHEN noise > 0.3 THEN 64 ELSE 0 END AS flags,
           under, dirt_frame, dup_hash, round(exposure, 6) AS exposure FROM share""")  # fmt: skip
def video_vote(v):
    return verdict.video_votes(v("frame_hit")).select("file_id", "flags", "under", "dirt_frame", "dup_hash", F.round("exposure", 6).alias("exposure"))


@query("frame_hit file", "SELECT id AS file_id, 2 AS flags FROM file f WHERE NOT EXISTS (SELECT 1 FROM frame_hit h WHERE h.file_id = f.id)")
def frameless_files(v):
    return verdict.with_corrupted(v("file"), verdict.video_votes(v("frame_hit"))).join(v("frame_hit").select("file_id"), "file_id", "left_anti")


@query("frame_hit", """
    , off AS (SELECT file_id, frame_idx, coalesce(last_value(CASE WHEN dist <= 25 AND frame_idx > 0 THEN dy END IGNORE NULLS) OVER w, 0) AS y, coalesce(last_value(CASE WHEN dist <= 25 AND frame_idx > 0 THEN dx END IGNORE NULLS) OVER w, 0) AS x
              FROM frame_hit WINDOW w AS (PARTITION BY file_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT *, y - lag(y) OVER (PARTITION BY file_id ORDER BY frame_idx) AS vy, x - lag(x) OVER (PARTITION BY file_id ORDER BY frame_idx) AS vx FROM off),
    f AS (SELECT *, vy * lag(vy) OVER (PARTITION BY file_id ORDER BY frame_idx) < 0 OR vx * lag(vx) OVER (PARTITION BY file_id ORDER BY frame_idx) < 0 AS flip FROM d),
    g AS (SELECT file_id, count(*) AS frames, list_sort(list(abs(vy)) FILTER (WHERE vy IS NOT NULL)) AS ys, list_sort(list(abs(vx)) FILTER (WHERE vx IS NOT NULL)) AS xs, count(*) FILTER (WHERE flip) AS flips, count(vy) AS steps FROM f GROUP BY file_id),
    r AS (SELECT file_id, frames, CAST(greatest(coalesce(ys[CAST(floor(len(ys) / 2) AS INT) + 1], 0), coalesce(xs[CAST(floor(len(xs) / 2) AS INT) + 1], 0)) AS DOUBLE) AS amp, CASE WHEN steps > 1 THEN flips / (steps - 1) ELSE 0 END AS rate FROM g)
    SELECT file_id, frames, amp, round(rate, 6) AS flip_rate, frames >= 8 AND amp > 1.5 AND rate > 0.5 AS shake FROM r""")  # fmt: skip
def shake(v):
    return verdict.shake(v("frame_hit")).withColumn("flip_rate", F.round("flip_rate", 6))


NAMES = ["gray_std", "lap_std", "noise_floor"]


@query("metric", " UNION ALL ".join(f"SELECT '{n}' AS metric, count(*) AS n, min({n}) AS min, max({n}) AS max, round(quantile_cont({n}, 0.95), 6) AS p95, round(quantile_cont({n}, 0.98), 6) AS p98, round(quantile_cont({n}, 0.99), 6) AS p99 FROM metric" for n in NAMES))
def calibration_quantiles(v):
    found = calibrate.quantiles(v("metric"), NAMES)
    return found.select("metric", "n", "min", "max", *[F.round(c, 6).alias(c) for c in ("p95", "p98", "p99")])


@query("metric", """
    SELECT t AS threshold, count(*) AS n, count(*) FILTER (WHERE lap_std < t) AS flagged, round(count(*) FILTER (WHERE lap_std < t) / count(*), 6) AS share
    FROM metric, (VALUES (10.0::DOUBLE), (15.0), (30.0), (60.0)) g(t) GROUP BY t""")  # fmt: skip
def threshold_sweep(v):
    return calibrate.sweep(v("metric"), "lap_std", [10.0, 15.0, 30.0, 60.0], above=False).withColumn("share", F.round("share", 6))


@query("qc", """
    SELECT a.file_id, b.file_id AS other_id, CAST(bit_count(xor(CAST('0x' || a.dup_hash AS UBIGINT), CAST('0x' || b.dup_hash AS UBIGINT))) AS INT) AS distance
    FROM qc a JOIN qc b ON b.file_id = a.file_id + 1 WHERE a.dup_hash <> '' AND b.dup_hash <> ''""")  # fmt: skip
def hash_distance(v):
    a = v("qc").select("file_id", V.hash_long(F.col("dup_hash")).alias("a"))
    b = v("qc").select(F.col("file_id").alias("other_id"), V.hash_long(F.col("dup_hash")).alias("b"))
    rows = a.join(b, F.col("other_id") == F.col("file_id") + 1).where("a is not null and b is not null")
    return rows.select("file_id", "other_id", V.hamming(F.col("a"), F.col("b")).alias("distance"))
