import hashlib

import pytest
from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.functions import paths as P
from lumaframe.functions import values as V


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.select("k", make(F.col("v")).alias("x")).orderBy("k").select("x").collect()]


def test_paths(spark):
    some = ["a", "a/b", "a/b/c.JPG", ".", "a.b/c", None]
    assert column(spark, some, P.parent) == [".", "a", "a/b", ".", "a.b", None] or column(spark, some, P.parent)[:5] == [".", "a", "a/b", ".", "a.b"]
    assert column(spark, some[:5], P.depth) == [1, 2, 3, 1, 2]
    assert column(spark, some[:5], P.extension) == ["", "", ".jpg", ".", ""]
    assert column(spark, ["a/b/c", "x"], P.ancestors) == [[".", "a", "a/b"], ["."]]
    assert column(spark, ["a/../b", "..", "a..b/c", "../x"], P.escapes) == [True, True, False, True]
    assert column(spark, ["a/../b", "..", "./a//b/", "a/../../b", ""], P.normalised) == ["b", None, "a/b", None, ""]
    assert column(spark, ["a/b", "../../etc", ".", "a/.."], lambda c: P.absolute("/m", c)) == ["/m/a/b", "/m", "/m", "/m"]
    assert column(spark, ["r1", "r1/x", "r10", "."], lambda c: P.is_under(c, "r1")) == [True, True, False, False]
    assert column(spark, ["/a/b/", "c", "/", "."], P.root_label) == ["b", "c", "/", "."]


def test_names(spark):
    assert column(spark, ["=1", "+1", "-1", "@x", "\tx", "\rx", "ok", ""], P.csv_safe) == ["'=1", "'+1", "'-1", "'@x", "'\tx", "'\rx", "ok", ""]
    assert column(spark, ['a\\b/c:d*e?f"g<h>i|j\nk\rl\tm', "   ", "x" * 80], P.file_name) == ["a_b_c_d_e_f_g_h_i_j_k_l_m", "export", "x" * 60]
    assert column(spark, [" bob ", "x" * 24, "x" * 25, "a\x07b", "　 ", "名" * 24, "a\x85b"], P.reviewer_name) == ["bob", "x" * 24, None, None, None, "名" * 24, None]


def test_hashes_and_boxes(spark):
    pairs = [("0f0f0f0f0f0f0f0f", "0f0f0f0f0f0f0f04", 3), ("ffffffffffffffff", "0000000000000000", 64), ("8000000000000000", "0000000000000000", 1)]
    rows = spark.createDataFrame(pairs, "a string, b string, d int")
    assert all(r["x"] == r["d"] for r in rows.select("d", V.hamming(V.hash_long(F.col("a")), V.hash_long(F.col("b"))).alias("x")).collect())
    assert column(spark, ["", "xyz", None], V.hash_long) == [None] * 3
    box = lambda *b: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(b, "xywh", strict=True)])
    got = spark.range(1).select(*[V.iou(box(*a), box(*b)) for a, b in (((0, 0, 1, 1), (0, 0, 1, 1)), ((0, 0, 0.2, 0.2), (0.5, 0.5, 0.2, 0.2)), ((0, 0, 0.5, 0.5), (0.25, 0.25, 0.5, 0.5)), ((0, 0, 0, 0), (0, 0, 0, 0)))]).first()
    assert [*got] == pytest.approx([1, 0, 1 / 7, 0])
    assert column(spark, [0, 6, 511], lambda c: V.set_then_clear(c, F.lit(1), F.lit(8)), "int") == [1, 7, 503]


def test_times(spark):
    names = ["IMG_20240102_030405.jpg", "20240102-030405", "mmexport1600000000000.jpg", "x991600000000000.jpg", "nothing", "a20991399_999999", "11600000000000x"]
    assert column(spark, names, V.capture_time) == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2020-09-13 12:26:40", "", "", "2099-13-99 99:99:99", ""]
    keys = ["2024-01-02 03:04:05", "2024:01:02 03:04:05", "2024-13-02 03:04:05", ""]
    assert [t is not None for t in column(spark, keys, V.shoot_time)] == [True, False, False, False]
    assert [t is not None for t in column(spark, keys, lambda c: V.shoot_time(c, True))] == [True, True, False, False]
    twice = column(spark, [1_600_000_000, 1_600_000_000_000, 0, -5], lambda c: V.claim_millis(V.claim_millis(c)), "long")
    assert twice == [1_600_000_000_000, 1_600_000_000_000, 0, -5]


def test_sizes(spark):
    sizes = [0, 1, 1 << 20, 1_053_818, 123_456_789, (1 << 50) + 7]
    assert column(spark, sizes, V.megabytes, "long") == [f"{x / (1 << 20):.2f}" for x in sizes]

    def fit(w, h, short, even=False):
        return [*spark.range(1).select(V.fitted(F.lit(w), F.lit(h), short, even).alias("s")).first()["s"]]

    assert fit(2772, 1280, 720, True) == [1558, 720, True] and fit(1080, 1920, 720, True) == [720, 1280, True] and fit(1280, 720, 720, True) == [1280, 720, False]
    assert fit(0, 10, 720) == [0, 10, False] and fit(4000, 3000, 1600) == [2133, 1600, True]


def test_texts(spark):
    rows = spark.createDataFrame([(511, '{"exposure":{"over":true,"under":true}}'), (32, '{"exposure":{"under":true}}'), (32, "no json"), (0, ""), (256, "{}")], "f int, d string")
    got = [r[0] for r in rows.select(F.concat_ws("、", V.issue_texts(F.col("f"), F.col("d")))).collect()]
    assert got == ["损坏、重复、空镜、镜头脏污、模糊、过曝、噪点、抖动", "欠曝", "曝光", "未知", "未知"]


def test_client_ip(spark):
    rows = [
        ("127.0.0.1:80", "203.0.113.9, 10.0.0.1", None, "203.0.113.9"), ("10.0.0.2:80", "bad", " 2001:db8::1 ", "2001:db8::1"), ("192.168.1.1:1", "bad", "bad", "192.168.1.1"),
        ("8.8.8.8:1", "1.2.3.4", "1.2.3.4", "8.8.8.8"), ("[::1]:9", "1.2.3.4", None, "1.2.3.4"), ("172.32.0.1:1", "1.2.3.4", None, "172.32.0.1"), ("nohost", None, None, "nohost"), ("[fd00::1]:2", "999.1.1.1", "5.6.7.8", "5.6.7.8"),
    ]
    df = spark.createDataFrame(rows, "p string, f string, r string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", V.client_ip(F.col("p"), F.col("f"), F.col("r")).alias("got")).collect())


def test_detail_round_trip(spark):
    text = '{"flags":8,"lensDirt":{"conf":0.1,"boxes":[{"x":0.375,"y":0.375,"w":0.25,"h":0.25}]}}'
    assert column(spark, [text], lambda c: V.detail_json(V.parsed_detail(c))) == [text]


def test_versions():
    base = S.Thresholds()
    assert S.version(base) == 5 and S.version(S.Thresholds(blank_std=9)) != 5
    assert S.version(base, "m1") != S.version(base, "m2") and 1_000_000_001 <= S.version(base, "m1") < 2_000_000_000
    assert S.fnv1a(b"") == 0xCBF29CE484222325 and S.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert S.clamped(S.Thresholds(blur_lap_std=1000, dup_sim=0)) == S.Thresholds(blur_lap_std=60, dup_sim=0.5)
    assert S.ISSUES == 510


def test_formats(spark):
    found = {r["ext"]: (r["kind"], r["decoder"]) for r in S.formats(spark).collect()}
    assert len(found) == 62 and found[".jpg"] == (1, "ffmpeg") and found[".mov"] == (2, "ffmpeg") and found[".heic"] == (1, "magick") and ".txt" not in found


def test_cache_key(spark):
    want = hashlib.sha1(b"a/b.mp4|5|7|720p").hexdigest()
    got = spark.range(1).select(P.cache_key(F.lit("a/b.mp4"), F.lit(5), F.lit(7), "720p").alias("k")).select("k", P.cache_path(F.col("k"), "mp4")).first()
    assert [*got] == [want, f"{want[:2]}/{want}.mp4"]
