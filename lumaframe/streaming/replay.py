"""Rules over a finished log.

Rows are dealt out by key, sorted by key and time within a partition, and folded as they stream by: a task holds one
key's state and one Arrow batch, however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.streaming.rules import RULES


def replay(events: DataFrame, rule: str, key: str) -> DataFrame:
    """(key, ts_ms, seq, the rule's columns) for every output of the rule over events (key, ts_ms, seq and what the rule reads)."""
    step, columns = RULES[rule]
    names = [key, "ts_ms", "seq", *[c.split()[0] for c in columns.split(", ")]]
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), {}
        for part in batches:
            out = []
            for e in part.itertuples(index=False):
                own = getattr(e, key)
                if own != current:
                    current, state = own, {}
                state, rows = step(state, e)
                out += [(own, e.ts_ms, e.seq, *r) for r in rows]
            yield pd.DataFrame(out, columns=names)

    ordered = events.repartition(key).sortWithinPartitions(key, "ts_ms", "seq")
    return ordered.mapInPandas(run, f"{key} {kind}, ts_ms long, seq long, {columns}")


def outcomes(marks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(file_id, ts_ms, seq, folder_id, outcome, decision, user_name) of what the rule lock lets through or not.

    stored: (file_id, decision) from before. An allowed mark always leaves its decision, so the one before it tells whether it changes
    anything, and no state is kept: blocked, same or changed.
    """
    before = Window.partitionBy("file_id").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("allowed"), F.col("decision")), ignorenulls=True).over(before)
    if stored is not None:
        marks = marks.join(stored.select("file_id", F.col("decision").alias("_stored")), "file_id", "left")
        last = F.coalesce(last, F.col("_stored"))
    outcome = F.when(~F.col("allowed"), "blocked").when(last == F.col("decision"), "same").otherwise("changed")
    return marks.select("file_id", "ts_ms", "seq", "folder_id", outcome.alias("outcome"), "decision", "user_name")


def marked(events: DataFrame) -> DataFrame:
    """outcomes() of every mark in events (folder_id, ts_ms, seq, user_name, op: claim, release or mark, file_id, decision)."""
    return outcomes(replay(events, "lock", "folder_id"))
