"""Stateful stream operators: typed state per key, event-time timers that end it, or a time to live.

All are transformWithState operators over RocksDB, so state is larger than memory if it must be and a key's values are read one by
one. A processor sees one key's events of a micro-batch; the source's options (maxFilesPerTrigger, maxOffsetsPerTrigger) bound how many
those can be.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumaframe import schemas as S
from lumaframe.operators.frames import METRIC_NAMES
from lumaframe.streaming.rules import ENDS, RULES, STATES, lock

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_rocksdb(spark: SparkSession) -> None:
    """State with timers and times to live needs RocksDB; what the session chose itself stays."""
    if "RocksDB" not in spark.conf.get(PROVIDER):
        spark.conf.set(PROVIDER, ROCKS)


def in_event_time(events: DataFrame, late: str) -> DataFrame:
    """The events with a watermark on the time that their ts_ms tells, a millisecond on: Spark takes time zero for late."""
    return events.withColumn("event_time", F.timestamp_millis(F.col("ts_ms") + 1)).withWatermark("event_time", late)


def in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda e: (e.ts_ms, e.seq))


class KeyedRule(StatefulProcessor):
    """One of RULES. The state's fields are columns of a value state; a state that its rule no longer needs ends by a timer."""

    def __init__(self, rule: str, key: str, ttl_ms: int | None):
        self.rule, self.key, self.ttl = rule, key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.step, columns = RULES[self.rule]
        self.fields = [c.split()[0] for c in STATES[self.rule].split(", ")]
        self.out = Row(self.key, "ts_ms", "seq", *[c.split()[0] for c in columns.split(", ")])
        self.ends = ENDS.get(self.rule, lambda state: None)
        self.held = handle.getValueState("held", f"{STATES[self.rule]}, timer long", self.ttl)

    def stored(self) -> tuple[dict, int | None]:
        found = self.held.get()
        if found is None:
            return {}, None
        return {f: v for f, v in zip(self.fields, found, strict=False) if v is not None}, found[len(self.fields)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  (names of the interface)
        state, timer = self.stored()
        known = timer is not None or bool(state)
        for e in in_order(rows):
            state, found = self.step(state, e)
            for r in found:
                yield self.out(key[0], e.ts_ms, e.seq, *r)
        state = {f: v for f, v in state.items() if v is not None}
        end = self.ends(state) if state and self.ttl is None else None
        end = None if end is None else end + 1  # event_time is a millisecond on
        if timer is not None and timer != end:
            self.handle.deleteTimer(timer)
        if end is not None and timer != end:
            self.handle.registerTimer(end)
        if state:
            self.held.update((*[state.get(f) for f in self.fields], end))
        elif known:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state, timer = self.stored()
        if timer is not None and timer <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed(events: DataFrame, rule: str, key: str, late: str = "1 minute", ttl_ms: int | None = None) -> DataFrame:
    """(key, ts_ms, seq, the rule's columns): a rule over a stream, in order of (ts_ms, seq) within a micro-batch.

    State ends by a timer once the watermark has passed the time at which the rule itself forgets it (rules.ENDS), which changes no
    output; events later than `late` are dropped. With ttl_ms a key's state also ends when so much processing time has gone by without an
    event, whatever the rule says: for rules that never forget, where old keys may be taken for new ones. Then nothing is late.
    """
    on_rocksdb(events.sparkSession)
    columns = RULES[rule][1]
    kind = events.schema[key].dataType.simpleString()
    timed = in_event_time(events, late) if ttl_ms is None else events
    mode = "EventTime" if ttl_ms is None else "ProcessingTime"
    return timed.groupBy(key).transformWithState(KeyedRule(rule, key, ttl_ms), f"{key} {kind}, ts_ms long, seq long, {columns}", "append", mode)


class Alerts(StatefulProcessor):
    """Claims without activity: a timer for each folder that is held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "user_name string, at long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        user, at, timer = self.held.get() or (None, 0, None)
        for e in sorted(rows, key=lambda e: e.ts):
            ms = round(e.ts.timestamp() * 1000)
            if (e.op == "claim" and user in (None, e.user_name)) or (e.op == "activity" and user == e.user_name):
                user, at = e.user_name, ms
            elif e.op in ("release", "force") and user == e.user_name:
                user = None
        if timer is not None:
            self.handle.deleteTimer(timer)
        if user is None:
            self.held.clear()
        else:
            due = max(at + S.STALE_MS, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(due)
            self.held.update((user, at, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        user, at, timer = self.held.get() or (None, 0, None)
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield Row(folder_id=key[0], user_name=user, since_ms=at)

    def close(self) -> None:
        pass


def stale_alerts(events: DataFrame) -> DataFrame:
    """(folder_id, user_name, since): a claim without activity for 30 minutes of event time, once; a renewal starts anew.

    events: ts (timestamp), folder_id, user_name, op.
    """
    on_rocksdb(events.sparkSession)
    marked = events.withWatermark("ts", "1 minute")
    found = marked.groupBy("folder_id").transformWithState(Alerts(), "folder_id long, user_name string, since_ms long", "append", "EventTime")
    return found.select("folder_id", "user_name", F.timestamp_millis("since_ms").alias("since"))


class Decisions(StatefulProcessor):
    """Who holds a folder, and the decision of each of its files: a map, of which a mark reads one entry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holder = handle.getValueState("holder", "holder string")
        self.decided = handle.getMapState("decided", "file_id long", "decision int")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        if initialState.decision:
            self.decided.updateValue((initialState.file_id,), (initialState.decision,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        found = self.holder.get()
        before = {"holder": found[0]} if found else {}
        state = before
        for e in in_order(rows):
            state, marks = lock(state, e)
            for file_id, decision, user, allowed in marks:
                last = self.decided.getValue((file_id,))
                last = last[0] if last else S.PENDING
                outcome = "blocked" if not allowed else "same" if last == decision else "changed"
                if outcome == "changed" and decision == S.PENDING:
                    self.decided.removeKey((file_id,))
                elif outcome == "changed":
                    self.decided.updateValue((file_id,), (decision,))
                yield Row(folder_id=key[0], ts_ms=e.ts_ms, seq=e.seq, file_id=file_id, user_name=user, outcome=outcome, before=last, decision=decision)
        if state.get("holder") is None:
            if found:
                self.holder.clear()
        elif state != before:
            self.holder.update((state["holder"],))

    def close(self) -> None:
        pass


def decisions(events: DataFrame, marks: DataFrame | None = None, late: str = "1 minute") -> DataFrame:
    """(folder_id, ts_ms, seq, file_id, user_name, outcome, before, decision) of every mark in a stream of claims, releases and marks.

    outcome: blocked by someone's claim, same as before, or changed; a file that nobody marked was pending. marks (folder_id, file_id,
    decision) are the ones from before the stream. State: a folder's holder, and an entry for each file that is not pending.
    """
    on_rocksdb(events.sparkSession)
    first = None if marks is None else marks.select("folder_id", "file_id", "decision").groupBy("folder_id")
    columns = "folder_id long, ts_ms long, seq long, file_id long, user_name string, outcome string, before int, decision int"
    return in_event_time(events, late).groupBy("folder_id").transformWithState(Decisions(), columns, "append", "EventTime", initialState=first)


#: What is kept of a frame until its clip is whole: its metrics and projections, no pixels.
FEATURES = f"{S.METRICS}, rows array<double>, cols array<double>"
FEATURE_NAMES = [*METRIC_NAMES, "rows", "cols"]


class Clips(StatefulProcessor):
    """The frames of a clip, until all are there or none has come for a while."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "frame_idx int", FEATURES)
        self.known = handle.getValueState("known", "n int, timer long")
        self.out = Row("file_id", "size", "mtime", "complete", "frame_idx", *FEATURE_NAMES)

    def ended(self, key, frames: dict[int, tuple], complete: bool) -> Iterator[Row]:
        for k in sorted(frames):
            yield self.out(*key, complete, k, *frames[k])

    def forget(self) -> None:
        self.frames.clear()
        self.known.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new, total = {}, 0
        for r in rows:
            new[r.frame_idx] = tuple(r[c] for c in FEATURE_NAMES)
            total = r.n_frames
        n, timer = self.known.get() or (0, None)
        if not n and len(new) >= total:  # a clip that comes whole is never stored
            yield from self.ended(key, new, True)
            return
        n += sum(not self.frames.containsKey((k,)) for k in new)
        if timer is not None:
            self.handle.deleteTimer(timer)
        if n >= total:
            old = {k[0]: v for k, v in self.frames.iterator()}
            self.forget()
            yield from self.ended(key, old | new, True)
            return
        for k, values in new.items():
            self.frames.updateValue((k,), values)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.patience
        self.handle.registerTimer(timer)
        self.known.update((n, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        _, timer = self.known.get() or (0, None)
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            old = {k[0]: v for k, v in self.frames.iterator()}
            self.forget()
            yield from self.ended(key, old, False)

    def close(self) -> None:
        pass


def clips(features: DataFrame, patience_ms: int = 6 * 3_600_000) -> DataFrame:
    """(file_id, size, mtime, complete, frame_idx, FEATURES): all frames of a clip at once, whatever micro-batches they came in.

    features: frame_features() of frames with n_frames, size and mtime; another size or mtime is another clip. A clip of which frames are
    still missing after `patience_ms` of processing time since its last one comes as it is, with complete = false.
    """
    on_rocksdb(features.sparkSession)
    columns = f"file_id long, size long, mtime long, complete boolean, frame_idx int, {FEATURES}"
    return features.groupBy("file_id", "size", "mtime").transformWithState(Clips(patience_ms), columns, "append", "ProcessingTime")
