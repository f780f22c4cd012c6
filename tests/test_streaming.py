"""Rules on hand-made logs; each stream against its replay over the same events."""

import time
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe import schemas as S
from lumaframe.operators import stats
from lumaframe.operators.frames import frame_features
from lumaframe.streaming import live, rules, state, table_log
from lumaframe.streaming.replay import marked, replay

START = datetime(2024, 1, 1)


def fold(step, events):
    state, out = {}, []
    for e in events:
        state, rows = step(state, SimpleNamespace(**e))
        out += rows
    return out


def test_login():
    tries = [{"ts_ms": 1000 * k, "ok": k == 5} for k in range(7)] + [{"ts_ms": 900_001, "ok": True}, {"ts_ms": 900_002, "ok": False}]
    assert [r[0] for r in fold(rules.login, tries)] == ["failed"] * 5 + ["blocked"] * 2 + ["ok", "failed"]


def test_download():
    tries = [{"ts_ms": k, "ok": False} for k in range(6)] + [{"ts_ms": 20_000, "ok": True}, {"ts_ms": 30_004, "ok": False}, {"ts_ms": 30_005, "ok": True}]
    assert [r[0] for r in fold(rules.download, tries)] == ["failed"] * 4 + ["lock", "locked", "locked", "failed", "ok"]


def test_quota():
    assert rules.quota("use", 3)[0] == 3 and rules.quota("use", 999_999)[0] == 1000 and rules.quota("x", 5)[0] == 10 and rules.quota("hour", 2) == (0, 7_200_000) and rules.quota("day", 99)[1] == 30 * rules.DAY
    log = [{"ts_ms": 0, "op": "redeem", "mode": "", "value": 0}, {"ts_ms": 1, "op": "issue", "mode": "use", "value": 2}] + [{"ts_ms": 2 + k, "op": "redeem", "mode": "", "value": 0} for k in range(3)]
    assert [r[0] for r in fold(rules.redeem, log)] == ["refused", "issued", "counted", "counted", "refused"]


def test_claims():
    e = lambda ts, user, op: {"ts_ms": ts, "user_name": user, "op": op}
    log = [e(0, "alice", "claim"), e(1, "bob", "claim"), e(2, "alice", "claim"), e(7_200_000, "bob", "claim"), e(7_200_001, "alice", "activity"), e(7_200_002, "bob", "force"), e(9_100_000, "bob", "force"), e(9_100_001, "bob", "claim"), e(9_100_002, "", "release")]
    assert fold(rules.claim, log) == [("claimed", "alice"), ("refused", "alice"), ("renewed", "alice"), ("refused", "alice"), ("renewed", "alice"), ("kept", "alice"), ("released", "alice"), ("claimed", "bob"), ("released", "bob")]


def test_throttle_and_sections():
    assert [r[0] for r in fold(rules.throttle, [{"ts_ms": t} for t in (0, 299_999, 300_000, 599_999, 600_000)])] == ["taken", "dropped", "taken", "dropped", "taken"]
    assert fold(rules.changed_section, [{"json": j} for j in ("a", "a", "b", "a")]) == [("a",), ("b",), ("a",)]


def streamed(spark, tmp_path, batches, schema, make, mode="append"):
    """Runs make(stream) over one file per batch and returns all rows."""
    source, name = str(tmp_path / "in"), "out_" + str(abs(hash(str(tmp_path))))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_marks_stream_is_its_replay(spark, tmp_path):
    schema = "folder_id long, ts_ms long, seq long, user_name string, op string, file_id long, decision int"
    log = []
    for k in range(60):
        op = "claim" if k % 11 == 0 else "release" if k % 13 == 0 else "mark"
        log.append((k % 3, 10 * k, k, f"u{k % 4}", op, k % 5, k // 7 % 3))
    want = sorted(map(tuple, marked(spark.createDataFrame(log, schema)).collect()))
    assert {w[4] for w in want} == {"blocked", "same", "changed"}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (log[:20], log[20:45], log[45:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = live.keyed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "lock", "folder_id")
    q = stream.writeStream.foreachBatch(live.store_marks(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = spark.read.parquet(f"{out}/outcomes").drop("batch").collect()
    assert sorted(map(tuple, got)) == want
    holder, decided, slow = {}, {}, []
    for folder, ts, seq, user, op, file_id, decision in log:  # one dict of everything
        if op == "claim":
            holder[folder] = holder.get(folder) or user
        elif op == "release":
            holder[folder] = None if holder.get(folder) == user else holder.get(folder)
        elif holder.get(folder) not in (None, user):
            slow.append((file_id, ts, seq, folder, "blocked", decision, user))
        else:
            slow.append((file_id, ts, seq, folder, "same" if decided.get(file_id) == decision else "changed", decision, user))
            decided[file_id] = decision
    assert want == sorted(slow)
    assert {r["file_id"]: r["decision"] for r in live.current(spark, f"{out}/marks").collect()} == decided


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_stale_alert_fires_once(spark, tmp_path):
    schema = "ts timestamp, folder_id long, user_name string, op string"
    batches = [
        [(at(0), 1, "a", "claim"), (at(0), 2, "b", "claim"), (at(0), 3, "c", "claim")],
        [(at(1500), 2, "b", "activity"), (at(1600), 3, "c", "release")],
        [(at(2000), 9, "z", "claim")],
        [(at(2100), 9, "z", "activity")],
    ]
    got = [tuple(r) for r in streamed(spark, tmp_path, batches, schema, live.stale_alerts)]
    assert got == [(1, "a", START)]


def test_windows(spark, tmp_path):
    schema = "ts timestamp, user_name string, decision int"
    rows = [(at(k * 7), f"u{k % 3}", k % 2) for k in range(40)] + [(at(4000), "end", 1)]
    got = {(r["window"]["start"], r["user_name"], r["decision"]): r["n"] for r in streamed(spark, tmp_path, [rows, [(at(9000), "end", 1)]], schema, live.marks_per_minute)}
    want = {}
    for ts, user, d in rows:
        key = (ts.replace(second=0), user, d)
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_bursts_stream(spark, tmp_path):
    schema = "ts timestamp, device string, file_id long"
    rows = [(at(s), "C", k) for k, s in enumerate((0, 2, 4, 7, 20, 21))]
    got = sorted((r["anchor_id"], r["members"]) for r in streamed(spark, tmp_path, [rows, [(at(5000), "C", 99)], [(at(9000), "C", 100)]], schema, live.burst_sessions))
    assert got[:3] == [(0, 3), (3, 1), (4, 2)]


def test_other_windows(spark, tmp_path):
    schema = "ts timestamp, user_name string"
    rows = [(at(0), "a"), (at(1), "b"), (at(200), "a")]
    active = streamed(spark, tmp_path / "a", [rows, [(at(2000), "z")], [(at(4000), "z")]], schema, live.active_users)
    starts = {at(10 * k) for k in range(-30, 21)}
    seen = {w: len({u for t, u in rows if w <= t < w + timedelta(minutes=5)}) for w in starts}
    assert {r["window"]["start"]: r["users"] for r in active if r["window"]["start"] in starts} == {w: n for w, n in seen.items() if n}
    ticks = streamed(spark, tmp_path / "b", [[(at(0), "a"), (at(0), "b"), (at(3), "a")], [(at(100), "z")], [(at(200), "z")]], schema, live.once_a_second)
    assert sorted((r["window"]["start"], r["n"]) for r in ticks)[:2] == [(at(0), 2), (at(3), 1)]
    once = streamed(spark, tmp_path / "c", [[(at(0), "p", 1, 1), (at(1), "p", 1, 1)], [(at(2), "p", 1, 1), (at(3), "p", 2, 1)]], "ts timestamp, rel_path string, size long, mtime long", live.new_only)
    assert sorted((r["rel_path"], r["size"]) for r in once) == [("p", 1), ("p", 2)]


def test_upsert_and_ingest(spark, tmp_path):
    write = live.upsert_into(str(tmp_path / "t"), ["file_id"], "n")
    write(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "file_id long, n long, v string"), 0)
    write(spark.createDataFrame([(2, 5, "d"), (3, 1, "e")], "file_id long, n long, v string"), 1)
    assert {r["file_id"]: r["v"] for r in live.current(spark, str(tmp_path / "t")).collect()} == {1: "b", 2: "d", 3: "e"}
    for n in (2, 3, 3):  # a batch that comes again changes nothing
        write(spark.createDataFrame([(1, n + 4, f"x{n}")], "file_id long, n long, v string"), n)
    assert {r["file_id"]: r["v"] for r in live.current(spark, str(tmp_path / "t")).collect()} == {1: "x3", 2: "d", 3: "e"}
    kept = {p.parent.name for p in (tmp_path / "t").glob("v*/part=*")}
    assert "v3" in kept and len([*(tmp_path / "t").glob("v*/part=*")]) <= 5
    store = str(tmp_path / "qc")
    sink = live.ingest(store, S.ALGORITHM_VERSION)
    frames = spark.createDataFrame([(1, 0, 64, 64, bytearray(4096)), (2, 0, 64, 64, bytearray(b"x"))], S.FRAME).withColumn("size", F.lit(1).cast("long")).withColumn("mtime", F.lit(1).cast("long"))
    sink(frames, 0)
    sink(frames.where("file_id = 1").unionByName(frames.where("file_id = 2").withColumn("mtime", F.lit(2).cast("long"))), 1)
    got = {r["file_id"]: (r["corrupted"], r["batch"]) for r in live.current(spark, store).collect()}
    assert got == {1: (False, 0), 2: (True, 1)}
    claims = spark.createDataFrame([(7, "a"), (8, "a")], "folder_id long, user_name string")
    events = spark.createDataFrame([(0, "a", "activity"), (9, "b", "claim")], "folder_id long, user_name string, op string")
    assert sorted(r["folder_id"] for r in live.expanded_activity(events, claims).collect()) == [7, 8, 9]


def test_ingest_votes_over_all_frames(spark, tmp_path):
    """A streamed clip gets the flags that the batch rules give it."""
    rng = np.random.default_rng(2)
    scene = rng.integers(0, 255, (80, 80)).astype(np.uint8)
    rows = []
    for k in range(12):
        d = 3 if k % 2 else 0
        rows.append((1, k, 64, 64, bytearray(scene[8 + d : 72 + d, 8:72].tobytes())))
        rows.append((2, k, 64, 64, bytearray(bytes(4096)) if k % 2 else bytearray(scene[8:72, 8:72].tobytes())))
        rows.append((3, k, 64, 64, bytearray(scene[8:72, 8:72].tobytes()) if k else bytearray(bytes(4096))))
    rows.append((4, 0, 64, 64, bytearray(bytes(4096))))
    rows += [(5, k, 64, 64, bytearray(b"x")) for k in range(2)]
    frames = spark.createDataFrame(rows, S.FRAME).withColumn("size", F.lit(1).cast("long")).withColumn("mtime", F.lit(1).cast("long"))
    live.ingest(str(tmp_path / "qc"), S.ALGORITHM_VERSION)(frames, 0)
    flags = {r["file_id"]: r["flags"] for r in live.current(spark, str(tmp_path / "qc")).collect()}
    assert flags[1] & S.SHAKE and not flags[2] & S.SHAKE and flags[2] & S.BLANK and flags[2] & S.EXPOSURE
    assert not flags[3] & (S.BLANK | S.EXPOSURE | S.SHAKE) and flags[4] & S.BLANK and flags[5] == S.CORRUPTED


def run_stream(spark, tmp_path, batches, schema, make, sink=None, after=None, mode="append", idle=True):
    """Feeds batches one by one into one query; gives its rows (or None with a sink) and the state rows after each batch.

    idle: batches run without data too, for the watermark; processing time would make them without end.
    """
    source, name = tmp_path / "in", "rows_" + str(abs(hash(str(tmp_path))))
    source.mkdir(parents=True)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", idle)
    writer = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp"))
    writer = writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)
    q, counts = writer.start(), []
    try:
        for k, rows in enumerate(batches):
            part = rows if hasattr(rows, "write") else spark.createDataFrame(rows, schema)
            part.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
            for f in (tmp_path / f"part{k}").glob("*.parquet"):
                f.rename(source / f"{k}.parquet")
            q.processAllAvailable()
            assert q.exception() is None
            counts.append(q.lastProgress.stateOperators[0].numRowsTotal if q.lastProgress.stateOperators else 0)
            if after:
                after(k)
    finally:
        q.stop()
    return None if sink else [tuple(r) for r in spark.table(name).collect()], counts


def attempts(seed, n):
    rng = np.random.default_rng(seed)
    ts = np.sort(rng.integers(0, 40 * 60_000, n))
    return [(f"s{rng.integers(0, 6)}", int(t), k, bool(rng.random() < 0.15)) for k, t in enumerate(ts)]


@pytest.mark.parametrize("rule", ["login", "download"])
def test_limiters_stream_is_their_replay(spark, tmp_path, rule):
    schema = "source string, ts_ms long, seq long, ok boolean"
    log = attempts(1, 300)
    want = sorted(map(tuple, replay(spark.createDataFrame(log, schema), rule, "source").collect()))
    got, _ = run_stream(spark, tmp_path, [log[:90], log[90:100], log[100:240], log[240:]], schema, lambda s: live.keyed(s, rule, "source"))
    assert sorted(got) == want and len({r[3] for r in want}) == 3 + (rule == "download")


def test_state_ends_with_its_rule(spark, tmp_path):
    """Timers take the state of keys that are not seen again; a later event of such a key is judged as in the replay."""
    schema = "source string, ts_ms long, seq long, ok boolean"
    first = [(f"s{k}", 1000 * k, k, False) for k in range(50)]
    late = [("x", 3_600_000, 100, False)], [("x", 3_700_000, 101, False), ("s7", 3_700_001, 102, False)]
    got, counts = run_stream(spark, tmp_path / "a", [first, *late], schema, lambda s: live.keyed(s, "login", "source"))
    assert counts[0] >= 50 and counts[-1] <= 8
    assert sorted(got) == sorted(map(tuple, replay(spark.createDataFrame([*first, *late[0], *late[1]], schema), "login", "source").collect()))
    tokens = "token string, ts_ms long, seq long, op string, mode string, value int"
    issued = [(f"t{k}", k, k, "issue", "hour", 1) for k in range(40)]
    used = [("t0", 4_000_000, 50, "redeem", "", 0)], [("t1", 4_200_000, 51, "redeem", "", 0)]
    got, counts = run_stream(spark, tmp_path / "b", [issued, *used], tokens, lambda s: live.keyed(s, "redeem", "token"))
    assert counts[0] >= 40 and counts[-1] <= 4 and [r[3] for r in sorted(got, key=lambda r: r[2])[40:]] == ["refused", "refused"]


def test_time_to_live(spark, tmp_path):
    """A rule that never forgets keeps a key only for so long after its last event."""
    schema = "source string, ts_ms long, seq long, ok boolean"
    batches = [[(f"s{k}", k, k, False) for k in range(30)], [("x", 100, 100, False)]]
    _, counts = run_stream(spark, tmp_path, batches, schema, lambda s: live.keyed(s, "download", "source", ttl_ms=1), after=lambda k: time.sleep(0.5), idle=False)
    assert counts[0] >= 30 and counts[1] <= 4


def test_throttle_and_claims_stream_is_their_replay(spark, tmp_path):
    log = [(f"n{k % 3}", 47_000 * k, k) for k in range(60)]
    schema = "name string, ts_ms long, seq long"
    got, _ = run_stream(spark, tmp_path / "a", [log[:20], log[20:33], log[33:]], schema, lambda s: live.keyed(s, "throttle", "name"))
    assert sorted(got) == sorted(map(tuple, replay(spark.createDataFrame(log, schema), "throttle", "name").collect()))
    rng = np.random.default_rng(5)
    schema = "folder_id long, ts_ms long, seq long, user_name string, op string"
    log = [(int(rng.integers(0, 4)), 400_000 * k, k, f"u{rng.integers(0, 3)}", str(rng.choice(["claim", "activity", "release", "force"]))) for k in range(120)]
    got, _ = run_stream(spark, tmp_path / "b", [log[:50], log[50:]], schema, lambda s: live.keyed(s, "claim", "folder_id"))
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in replay(spark.createDataFrame(log, schema), "claim", "folder_id").collect())


def test_live_counts_are_the_rollup(spark, tmp_path):
    """After each batch the kept-up tree equals tree_counts() of the marks as they are then."""
    folders = spark.createDataFrame([(1, 0, ".", ".", 1), (2, 1, "a", "a", 1), (3, 2, "b", "a/b", 2), (4, 2, "c", "a/c", 2), (5, 1, "d", "d", 1)], S.FOLDER)
    where = {f: 2 + f % 4 for f in range(1, 41)}
    files = spark.createDataFrame([(f, w, f"{f}", f"{f}", f"{f}", ".jpg", 1, 1, 1, 1, 0) for f, w in where.items()], S.FILE)
    decided = {f: 1 + f % 2 for f in range(1, 41) if f % 5 == 0}
    marks = spark.createDataFrame([(where[f], f, d) for f, d in decided.items()], "folder_id long, file_id long, decision int")
    tree_of = lambda d: stats.tree_counts(folders, stats.folder_counts(folders, files, spark.createDataFrame([(f, x, "r", 1) for f, x in d.items()] or [(0, 0, "", 0)], S.REVIEW)))
    began = tree_of(decided).cache()
    rng = np.random.default_rng(8)
    log, t = [(5, 0, 0, "someone", "claim", None, None)], 0
    for k in range(1, 90):
        f = int(rng.integers(1, 41))
        t += 1000
        log.append((where[f], t, k, f"u{rng.integers(0, 2)}", "mark", f, int(rng.integers(0, 3))))
    batches = [log[:30], log[30:31], log[31:70], log[70:]]
    seen = []

    def check(k):
        for folder, _, _, user, op, f, d in batches[k]:
            if op == "mark" and folder != 5:
                decided[f] = d
        assert sorted(map(tuple, live.tree_now(began, str(tmp_path / "counts")).collect())) == sorted(map(tuple, tree_of(decided).collect()))
        seen.append(k)

    schema = "folder_id long, ts_ms long, seq long, user_name string, op string, file_id long, decision int"
    run_stream(spark, tmp_path, batches, schema, lambda s: state.decisions(s, marks), live.count_marks(str(tmp_path / "counts"), folders), check)
    assert seen == [0, 1, 2, 3]


def clip_frames(seed, clips):
    """FRAME rows of clips {file_id: frames}: some shaking, some blank."""
    scene = np.random.default_rng(seed).integers(0, 255, (80, 80)).astype(np.uint8)
    rows = []
    for c, n in clips.items():
        for k in range(n):
            d = 3 * (k % 2) if c % 2 else 0
            gray = bytes(4096) if c % 3 == 0 and k % 2 else scene[8 + d : 72 + d, 8:72].tobytes()
            rows.append((c, k, 64, 64, bytearray(gray)))
    return rows


def test_ingest_of_clips_cut_anywhere(spark, tmp_path):
    """A clip whose frames come in several batches, some of them twice, has the results of the whole clip."""
    rows = clip_frames(3, {1: 12, 2: 7, 3: 9, 4: 1})
    frames = spark.createDataFrame(rows, S.FRAME).withColumns({"size": F.lit(1).cast("long"), "mtime": F.lit(1).cast("long")})
    live.ingest(str(tmp_path / "whole"), S.ALGORITHM_VERSION)(frames, 0)
    sink = live.ingest(str(tmp_path / "cut"), S.ALGORITHM_VERSION)
    for k, part in enumerate(["file_id = 1 and frame_idx = 0", "file_id in (1, 2) and frame_idx < 4", "frame_idx >= 3 or file_id > 2", "file_id = 1"]):
        sink(frames.where(part), k)
    get = lambda name: sorted(tuple(r) for r in live.current(spark, str(tmp_path / name)).drop("batch").collect())
    assert get("cut") == get("whole") and {r[1] for r in get("cut")} == {12, 7, 9, 1}


def test_clips_wait_for_their_last_frame(spark, tmp_path):
    schema = f"{S.FRAME}, n_frames int, size long, mtime long"
    want = {1: 12, 2: 7, 3: 9, 4: 1, 5: 6}
    rows = [(*r, want[r[0]], 10, 20) for r in clip_frames(3, want)]
    cut = [[r for r in rows if (r[0] * 7 + r[1]) % 3 == k and not (r[0] == 5 and r[1] == 2)] for k in range(3)]
    got, counts = run_stream(spark, tmp_path, [cut[0], cut[1] + cut[0][:3], cut[2]], schema, lambda s: state.clips(frame_features(s, S.COSTLY_EVERY, ["n_frames", "size", "mtime"])), idle=False)
    clips = {}
    for r in got:
        clips.setdefault(r[0], []).append(r)
    assert {c: [r[4] for r in own] for c, own in clips.items()} == {c: [*range(n)] for c, n in want.items() if c != 5}
    assert all(r[3] for r in got) and 0 < counts[-1] < counts[0]
    frames = spark.createDataFrame([r[:5] for r in rows], S.FRAME)
    plain = {(r["file_id"], r["frame_idx"]): tuple(r)[2:] for r in frame_features(frames, S.COSTLY_EVERY).collect()}
    assert all(r[5:] == plain[r[0], r[4]] for r in got)


def test_ingest_clips_is_the_batch_verdict(spark, tmp_path):
    schema = f"{S.FRAME}, n_frames int, size long, mtime long"
    want = {1: 12, 2: 7, 3: 9, 4: 1}
    rows = [(*r, want[r[0]], 1, 1) for r in clip_frames(3, want)]
    store = str(tmp_path / "qc")
    make = lambda s: state.clips(frame_features(s, S.COSTLY_EVERY, ["n_frames", "size", "mtime"]), patience_ms=1)
    run_stream(spark, tmp_path, [rows[:1], rows[1:8], rows[8:]], schema, lambda s: state.clips(frame_features(s, S.COSTLY_EVERY, ["n_frames", "size", "mtime"])), live.ingest_clips(store, S.ALGORITHM_VERSION), idle=False)
    frames = spark.createDataFrame([(*r[:5], 1, 1) for r in rows], f"{S.FRAME}, size long, mtime long")
    live.ingest(str(tmp_path / "whole"), S.ALGORITHM_VERSION)(frames, 0)
    get = lambda path: {r["file_id"]: (r["frames"], r["flags"], r["lap_std"]) for r in live.current(spark, path).collect()}
    assert get(store) == get(str(tmp_path / "whole"))
    assert all(r["complete"] for r in live.current(spark, store).collect())
    part = [r for r in rows if r[0] == 1][:5]
    got, counts = run_stream(spark, tmp_path / "open", [part, [r for r in rows if r[0] == 4]], schema, make, after=lambda k: time.sleep(0.5), idle=False)
    assert sorted((r[0], r[3]) for r in got) == [(1, False)] * 5 + [(4, True)] and counts[-1] <= 1


def test_table_of_many_batches(spark, tmp_path):
    """Layers and log stay few; sums and last rows are right after each batch."""
    sums, last = str(tmp_path / "sums"), str(tmp_path / "last")
    add, put = table_log.add_into(sums, ["k"], ["n"], parts=2), table_log.upsert_into(last, ["k"], "n", parts=2)
    want, most = {}, 0
    for b in range(45):
        rows = [(b % 5, b), (7, 1)]
        batch = spark.createDataFrame(rows, "k long, n long").coalesce(1)
        add(batch, b)
        if b < 12:
            put(batch, b)
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        most = max(most, len([*(tmp_path / "sums" / "log").glob("*.json")]))
    add(batch, 44)
    assert {r["k"]: r["n"] for r in table_log.current(spark, sums).collect()} == want
    assert {r["k"]: r["n"] for r in table_log.current(spark, last).collect()} == {0: 10, 1: 11, 2: 7, 3: 8, 4: 9, 7: 1}
    assert most <= 2 * table_log.EVERY + 3 and table_log.version(spark, sums) == 44
    assert len([*(tmp_path / "sums").glob("v*/part=*")]) <= 2 * 7


@pytest.mark.parametrize("turn", (1, 2))
def test_idle_batches_are_set_for_one_test(spark, turn):
    """What one test leaves in the session does not reach the next: test_windows needs the batch without data that comes last."""
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)
