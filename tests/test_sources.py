import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.operators import catalog, review, stats
from lumaframe.operators.frames import frame_features
from lumaframe.plans import exports
from lumaframe.sources import media, sinks
from lumaframe.streaming import live, state


def png(gray):
    h, w = gray.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(row) for row in gray.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def exif_jpeg(order="<", model=b"CamX\0", taken=b"2026:09:26 10:00:00\0"):
    def entry(tag, kind, count, value):
        return struct.pack(order + "HHI", tag, kind, count) + value

    start = 8 + 2 + 24 + 4
    inner = start + len(model)
    ifd0 = struct.pack(order + "H", 2) + entry(0x0110, 2, len(model), struct.pack(order + "I", start)) + entry(0x8769, 4, 1, struct.pack(order + "I", inner)) + b"\0" * 4
    sub = struct.pack(order + "H", 2) + entry(0x9003, 2, len(taken), struct.pack(order + "I", inner + 2 + 24 + 4)) + entry(0x9999, 2, 50, struct.pack(order + "I", 999_999)) + b"\0" * 4 + taken
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + ifd0 + model + sub
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\x00\x02"


def test_capture_tags():
    for order in "<>":
        assert media.capture_tags(exif_jpeg(order)) == ("CamX", "2026:09:26 10:00:00")
    assert media.capture_tags(exif_jpeg()[:60]) in (("", ""), ("CamX", ""))
    assert media.capture_tags(b"") == media.capture_tags(None) == media.capture_tags(b"\x89PNG") == ("", "")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("media")
    for name in ("a/one.PNG", "a/.hidden/x.png", "$RECYCLE.BIN/y.png", "b/c/clip.mp4", "b/notes.txt", ".dot.jpg"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(png(np.full((20, 30), 77)))
    (root / "a/broken.png").write_bytes(b"not an image")
    (root / "a/IMG_20240102_030405.jpg").write_bytes(exif_jpeg())
    return root


def test_tree_to_catalog(spark, tree):
    found = catalog.listed(media.list_tree(spark, str(tree)), S.formats(spark))
    assert {r["rel_path"]: r["kind"] for r in found.collect()} == {"a/one.PNG": 1, "a/broken.png": 1, "a/IMG_20240102_030405.jpg": 1, "b/c/clip.mp4": 2}
    folders = catalog.folder_tree(found, spark.createDataFrame([("empty/inner",)], "rel_path string"))
    rows = {r["rel_path"]: r for r in folders.collect()}
    assert set(rows) == {".", "a", "b", "b/c", "empty", "empty/inner"} and rows["."]["parent_id"] == 0 and rows["b/c"]["parent_id"] == rows["b"]["id"] and rows["a"]["parent_id"] == rows["."]["id"]
    files = catalog.catalog(found, folders)
    again = catalog.catalog(found.withColumn("size", F.col("size") + 1), folders, files.withColumn("id", F.lit(5).cast("long")).withColumn("processed", F.lit(1)))
    assert {(r["id"], r["processed"]) for r in again.collect()} == {(5, 1)}
    assert files.select("folder_id").distinct().count() == 2


def test_images(spark, tree):
    got = {r["origin"].rsplit("/", 1)[1]: r for r in media.read_images(spark, str(tree / "a")).collect()}
    assert got["one.PNG"]["w"] == 30 and bytes(got["one.PNG"]["gray"]) == bytes([77]) * 600 and got["broken.png"]["gray"] is None


def test_capture_and_foreign_decoder(spark, tree):
    files = spark.read.format("binaryFile").load(str(tree / "a")).select("path", "content")
    got = {r["path"].rsplit("/", 1)[1]: (r["device"], r["shoot_key"]) for r in media.read_capture(files).collect()}
    assert got["IMG_20240102_030405.jpg"] == ("CamX", "2026:09:26 10:00:00") and got["one.PNG"] == ("", "")

    def decoder(content):
        if content[:4] == b"not ":
            raise ValueError("unknown format")
        return np.zeros((4, 5)) if content[:2] == b"\xff\xd8" else None

    assert [(r["w"], r["h"]) for r in media.decode(files, decoder).collect()] == [(5, 4)]


def test_tables_and_lists(spark, tmp_path):
    files = spark.createDataFrame([(k, 1, f"{n}.jpg", n, f"d/{n}.jpg", ".jpg", 100 * k, 1, 1, 1, 0) for k, n in enumerate("dbca")], S.FILE)
    for day in ("2026-01-01", "2026-01-02", "2026-01-02"):
        sinks.write_table(files, str(tmp_path / "file"), day)
    assert media.read_table(spark, str(tmp_path / "file"), S.FILE + ", snapshot_date date").count() == 8
    reviews = spark.createDataFrame([(0, 1, "=bob", 0), (1, 2, "a", 5), (9, 1, "gone", 5)], S.REVIEW)
    sinks.write_csv(exports.review_list(reviews, files), str(tmp_path / "csv"), "rel_path")
    rows = [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()]
    assert rows == [("d/b.jpg", "2", "不保留", "a", "1970-01-01 00:00:05"), ("d/d.jpg", "1", "保留", "'=bob", None)]
    sinks.write_lines(files.orderBy("sort_key"), "rel_path", str(tmp_path / "txt"), "sort_key")
    assert [r[0] for r in spark.read.text(str(tmp_path / "txt")).collect()] == [f"d/{n}.jpg" for n in "abcd"]


def test_audit(spark, tmp_path):
    (tmp_path / "audit.jsonl").write_text(json.dumps({"ts": "2026-01-01T00:00:00Z", "ip": "1.2.3.4", "user": "a", "action": "login", "result": "ok", "ua": "x"}) + "\nbroken line\n")
    rows = media.read_audit(spark, str(tmp_path / "audit.jsonl")).collect()
    assert [(r["action"], r["_corrupt_record"]) for r in rows] == [("login", None), (None, "broken line")]


def test_numbers_without_a_single_partition(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r["no"] == r["k"] + 1 for r in stats.numbered(rows, "k").collect())


def test_marks_and_done(spark):
    files = spark.createDataFrame([(k, 1, "f", "f", f"f{k}", ".jpg", 1, 1, 1, 1, 0) for k in (1, 2, 3)], S.FILE)
    log = spark.createDataFrame([(1, 0, 1, 1, "alice"), (2, 1, 2, 2, "bob"), (3, 2, 3, 1, "alice"), (4, 3, 3, 0, "alice"), (5, 4, 1, 1, "bob")], "ts_ms long, seq long, file_id long, decision int, user_name string")
    marks = review.latest(log)
    assert [tuple(r) for r in stats.done_counts(files, marks).collect()] == [(1, 3, 2)]
    assert [tuple(r) for r in stats.mark_counts(files, marks, "alice").collect()] == [(1, 3, 2)]
    none = spark.createDataFrame([], S.CLAIM)
    held = spark.createDataFrame([(1, "alice", 5)], S.CLAIM)
    assert review.clear_folder(files, marks, held, 1, "verifier").count() == 3
    cleared = review.clear_folder(files, marks, held, 1, "alice")
    assert cleared.count() == 0 and review.clear_folder(files, cleared, none, 1, "alice").count() == 0
    assert {r["decision"] for r in review.decide_folder(files, marks, none, 1, 2, "x", 9).collect()} == {2}
    edits = spark.createDataFrame([(1, 1, "bob"), (2, 1, "bob"), (8, 1, "bob")], "file_id long, decision int, user_name string")
    assert {r["file_id"]: r["outcome"] for r in review.outcomes(edits, files, none, marks).collect()} == {1: "same", 2: "changed", 8: "missing"}
    after = {r["file_id"]: r["decision"] for r in review.apply_edits(edits, files, none, marks, 50).collect()}
    assert after == {1: 1, 2: 1, 3: 0}


def y4m(frames, header=" W8 H6 F25:1 C420jpeg", chroma=b"\x80" * 24, mark=b"FRAME\n"):
    return b"YUV4MPEG2" + header.encode() + b"\n" + b"".join(mark + f.tobytes() + chroma for f in frames)


def test_y4m_frames(spark):
    rng = np.random.default_rng(1)
    clip = rng.integers(0, 256, (150, 6, 8)).astype(np.uint8)
    odd = rng.integers(0, 256, (3, 5, 7)).astype(np.uint8)
    files = {
        "long": y4m(clip), "cut": y4m(clip[:4])[:-10], "mono": y4m(clip[:2], " W8 H6 Cmono", b""), "odd": y4m(odd, " W7 H5 F2:1", b"\x80" * 24),
        "wide": y4m(clip[:2], " W8 H6 C444", b"\x80" * 96), "deep": y4m(clip[:2], " W8 H6 C420p10"), "marks": y4m(clip[:2], mark=b"FRAMX\n"),
        "other": b"RIFF....", "empty": b"", "header": b"YUV4MPEG2 W8 H6\n", "none": None, "size": b"YUV4MPEG2 W0 Hx\nFRAME\n",
    }
    df = spark.createDataFrame([(k, k, v if v is None else bytearray(v)) for k, v in files.items()], "path string, tag string, content binary")
    found = {}
    for r in media.y4m_frames(df).collect():
        assert r["tag"] == r["path"] and (r["frame_idx"], r["path"]) not in found
        found[r["frame_idx"], r["path"]] = r
    n = {}
    for (_, path), r in found.items():
        n[path] = n.get(path, 0) + 1
        assert r["n_frames"] == {"long": 150, "cut": 3, "mono": 2, "odd": 3, "wide": 2, "marks": 2}[path]
    assert n == {"long": 150, "cut": 3, "mono": 2, "odd": 3, "wide": 2, "marks": 2}
    assert all(found[k, "long"]["gray"] == clip[k].tobytes() for k in range(150)) and found[2, "odd"]["gray"] == odd[2].tobytes() and found[1, "wide"]["gray"] == clip[1].tobytes()
    assert found[0, "marks"]["gray"] is None and (found[0, "odd"]["w"], found[0, "odd"]["h"]) == (7, 5)
    thin = media.y4m_frames(df.where("path in ('long', 'odd')"), per_second=2).collect()
    assert sorted(r["frame_idx"] for r in thin if r["path"] == "long") == [*range(13)] and {r["n_frames"] for r in thin} == {13, 3}
    assert all(r["gray"] == clip[12 * r["frame_idx"]].tobytes() for r in thin if r["path"] == "long")
    assert not any("Python" in p for p in [media.y4m_frames(df)._jdf.queryExecution().executedPlan().toString()])


def test_one_clip_is_measured_by_many_tasks(spark):
    frames = np.zeros((media.FRAME_RANGE * 12, 6, 8), np.uint8)
    df = spark.createDataFrame([("a", bytearray(y4m(frames)))], "path string, content binary")
    parts = media.y4m_frames(df).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and sum(r["count"] for r in parts) == len(frames)


def test_decoder_of_clips(spark):
    df = spark.createDataFrame([("a", bytearray(b"3")), ("b", bytearray(b"x")), ("c", bytearray(b"0")), ("d", bytearray(b"1"))], "path string, content binary")

    def decoder(content):
        for k in range(int(content)):
            yield np.full((2, 3), k, np.uint8)
            if content == b"1":
                raise ValueError("broken after a frame")

    found = sorted((r["path"], r["frame_idx"], r["n_frames"], r["w"], r["h"], r["gray"][0]) for r in media.decode(df, decoder).collect())
    assert found == [("a", k, 3, 3, 2, k) for k in range(3)]


def test_stream_of_clip_files(spark, tmp_path):
    """Clip files that arrive while the stream runs end as the results that the batch rules give their frames."""
    rng = np.random.default_rng(2)
    scene = rng.integers(0, 255, (80, 80)).astype(np.uint8)
    shaking = [scene[8 + 3 * (k % 2) : 72 + 3 * (k % 2), 8:72] for k in range(10)]
    clips = {"one.y4m": [scene[8:72, 8:72]] * 9, "two.y4m": shaking, "still.y4m": [np.zeros((64, 64), np.uint8)]}
    root, store = tmp_path / "in", str(tmp_path / "qc")
    root.mkdir()
    frames = media.clip_stream(spark, str(root), files_per_batch=1)
    stream = state.clips(frame_features(frames, S.COSTLY_EVERY, ["n_frames", "size", "mtime"]))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)
    q = stream.writeStream.foreachBatch(live.ingest_clips(store, S.ALGORITHM_VERSION)).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for name, own in clips.items():
            (root / "new").write_bytes(y4m(own, " W64 H64 F2:1 Cmono", b""))
            (root / "new").rename(root / name)
            q.processAllAvailable()
        assert q.exception() is None
    finally:
        q.stop()
    rows = media.y4m_frames(spark.read.format("binaryFile").option("pathGlobFilter", "*.y4m").load(str(root)).select("path", "content"))
    batch = rows.select(F.xxhash64("path").bitwiseAND((1 << 63) - 1).alias("file_id"), "frame_idx", "w", "h", "gray", F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"))
    live.ingest(str(tmp_path / "whole"), S.ALGORITHM_VERSION)(batch, 0)
    get = lambda path: {r["file_id"]: (r["frames"], r["flags"]) for r in live.current(spark, path).collect()}
    assert get(store) == get(str(tmp_path / "whole")) and sorted(n for n, _ in get(store).values()) == [1, 9, 10]
    assert sum(bool(f & S.SHAKE) for _, f in get(store).values()) == 1


def test_closure_by_parents(spark):
    tree = [(1, 0), (2, 1), (3, 2), (4, 99), (5, 4)] + [(100 + k, 99 + k if k else 3) for k in range(40)]
    loops = [(7, 7), (8, 9), (9, 10), (10, 8), (11, 10), (12, 11), (13, 12)] + [(200 + k, 199 + k if k else 13) for k in range(30)]
    above, circling = catalog.closure_by_parents(spark.createDataFrame(tree + loops + [(3, 2)], "id long, parent_id long"))
    parent, want = dict(tree), set()
    for k in parent:
        at, d = k, 0
        while at in parent:
            want.add((at, k, d))
            at, d = parent[at], d + 1
    got = [tuple(r) for r in above.collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r["id"] for r in circling.collect()} == {k for k, _ in loops}
    assert {r["id"] for r in catalog.subtree_by_parents(spark.createDataFrame(tree, "id long, parent_id long"), 2).collect()} == {2, 3, *range(100, 140)}
    empty, none = catalog.closure_by_parents(spark.createDataFrame([], "id long, parent_id long"))
    assert empty.count() == none.count() == 0


def test_snapshots_in_buckets_meet_without_a_shuffle(spark, tmp_path):
    old = spark.range(400).selectExpr("id", "concat('p/', id) AS rel_path", "id AS size", "1L AS mtime")
    new = spark.range(50, 500).selectExpr("id + 1000 AS id", "concat('p/', id) AS rel_path", "if(id % 7 = 0, 0L, id) AS size", "1L AS mtime")
    names = [f"snapshot_{k}_{abs(hash(str(tmp_path)))}" for k in "ab"]
    ordering = spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering")
    try:
        for name, rows in zip(names, (old, new), strict=True):
            sinks.write_snapshot(rows, name, str(tmp_path / name), 5)
        found = catalog.diff(*[sinks.read_snapshot(spark, n).hint("merge") for n in names])
        assert ordered_rows(found) == ordered_rows(catalog.diff(old, new))
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    finally:
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", ordering)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def ordered_rows(df):
    return sorted(map(repr, df.collect()))
