"""Removal of lines that many documents share, with levelled sorted runs of line hashes.

Each batch of documents is reduced to one row per distinct line key with the number of documents that hold it. The batch
is merge-anti-joined with the runs: a key that they count in enough documents is settled and goes no further, the others
become a run of level 0. When a level holds `fanout` runs they are merged into one run of the next level, so a long
history stays a handful of sorted tables. A key is dropped once the runs count it in enough documents.

A run is a table in buckets by hash, each bucket sorted. All runs and the counted keys of a batch are dealt alike, so
neither the anti-join nor a merge shuffles a run again: they are merge joins, bucket by bucket. Spark sorts a bucket's rows once
more when it reads them, as it does not rely on their order by default.

Only built-in DataFrame functions are used. Lines are shuffled as counts of their hashes, never as text; the text itself
moves once, to meet the positions to drop. A key that a third of all documents holds is counted by partial aggregation;
the keys to drop are broadcast if they are few (they are counted first), and otherwise joined, where the hot key's
partition is split (both sides are plain shuffles).

Defined results: a null or empty text is one empty line, which is never dropped; equal rows count as one document;
rows with one doc_id but different texts count as different documents; an empty table gives an empty result; columns
other than doc_id and text are not looked at. A key is identified by 128 bits of XXH64.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm.common import bounded, forget, new_path, once, saved

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def hashed_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, body, lines) for each row: the lines whose key has min_chars code points, as (h1, h2, pos) in that order.

    body is a hash of the whole text, h1 and h2 of the key.
    """
    keys = docs.select("doc_id", F.xxhash64("text").alias("body"), F.transform(lines_of(F.col("text")), line_key).alias("keys"))
    hashed = F.transform("keys", lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), i.alias("pos"))))
    return keys.select("doc_id", "body", F.sort_array(F.array_compact(hashed)).alias("lines"))


def documents_per_key(lines: DataFrame) -> DataFrame:
    """(h1, h2, n) from hashed_lines(); equal rows count once."""

    def first(x: Column, i: Column) -> Column:
        before = F.get(F.col("lines"), i - 1)
        return (i == 0) | (x["h1"] != before["h1"]) | (x["h2"] != before["h2"])

    each = once(lines, ["doc_id", "body"]).select(F.explode(F.filter("lines", first)).alias("line"))
    return each.groupBy(F.col("line.h1").alias("h1"), F.col("line.h2").alias("h2")).agg(F.count(F.lit(1)).alias("n"))


class LineRuns:
    """The levels of sorted runs. `root` is a folder that all executors share; drop() forgets the tables' names."""

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = 4, buckets: int | None = None):
        self.spark, self.root, self.fanout = spark, root or new_path(spark, "line-runs"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.names: list[str] = []

    def _write(self, run: DataFrame, level: int) -> None:
        name = "line_run_" + uuid.uuid4().hex
        self.names.append(name)
        dealt = run.repartition(self.buckets, "h1", "h2")
        dealt.write.format("parquet").option("path", f"{self.root}/{name}").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """(h1, h2, n): the runs merged pair by pair, bucket by bucket."""

        def merge(left: DataFrame, right: DataFrame) -> DataFrame:
            both = left.join(right.withColumnRenamed("n", "m").hint("merge"), ["h1", "h2"], "full_outer")
            return both.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        return reduce(merge, [self.spark.table(n) for n in names])

    def unsettled(self, keys: DataFrame, min_docs: int) -> DataFrame:
        """keys (h1, h2, n) without those that the runs count in min_docs documents: an anti-join with every run at once."""
        found = keys
        runs = [n for level in self.levels for n in level]
        for k, name in enumerate(runs):
            found = found.join(self.spark.table(name).withColumnRenamed("n", f"n{k}").hint("merge"), ["h1", "h2"], "left")
        counted = sum((F.coalesce(F.col(f"n{k}"), F.lit(0)) for k in range(len(runs))), F.lit(0))
        return found.where(counted < min_docs).select("h1", "h2", "n")

    def add(self, lines: DataFrame, settled_at: int | None = None) -> None:
        """Adds a batch of hashed_lines() as a run of level 0, without keys already counted settled_at times, and compacts full levels."""
        keys = documents_per_key(lines)
        self._write(keys if settled_at is None else self.unsettled(keys, settled_at), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            level += 1

    def counts(self) -> DataFrame:
        """(h1, h2, n) over all runs; settled keys are counted as far as they were followed."""
        names = [n for level in self.levels for n in level]
        return self._merged(names) if names else self.spark.createDataFrame([], "h1 long, h2 long, n long")

    def common(self, min_docs: int) -> DataFrame:
        return self.counts().where(F.col("n") >= min_docs)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names, self.levels = [], []


def drop_positions(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, body, dropped): the positions of the lines whose key is in keys, a table of saved()."""
    each = lines.select("doc_id", "body", F.explode("lines").alias("line")).select("doc_id", "body", "line.*")
    hit = each.join(bounded(keys.select("h1", "h2")), ["h1", "h2"], "left_semi")
    return hit.groupBy("doc_id", "body").agg(F.collect_set("pos").alias("dropped"))


def without(docs: DataFrame, dropped: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The named columns of docs (all by default) with _n_lines, _n_dropped and _kept (the text that stays)."""
    gone = dropped.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), F.col("dropped").alias("_dropped"))
    lines = lines_of(docs["text"])
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone["_dropped"])
    kept = F.when(gone["_dropped"].isNull(), F.coalesce(docs["text"], F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_body"]), "left")
    return joined.select(
        *[docs[c] for c in (docs.columns if columns is None else columns)],
        F.size(lines).cast("long").alias("_n_lines"),
        F.coalesce(F.size(gone["_dropped"]), F.lit(0)).cast("long").alias("_n_dropped"),
        kept.alias("_kept"),
    )


def common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 2, fanout: int = 2) -> DataFrame:
    """(doc_id, body, dropped) for each text that loses lines.

    The corpus enters the runs in `batches` parts; a line goes when its key is in at least min_docs documents of all.
    """
    runs = LineRuns(docs.sparkSession, fanout=fanout)
    lines = saved(hashed_lines(docs, min_chars), "lines")
    for k in range(batches):
        runs.add(lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), settled_at=min_docs if k else None)
    keys = saved(runs.common(min_docs).select("h1", "h2"), "common-lines")
    runs.drop()
    return drop_positions(lines, keys)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 2, fanout: int = 2) -> DataFrame:
    """(doc_id, _n_lines, _n_dropped, _kept) of each row."""
    return without(docs, common_lines(docs, min_docs, min_chars, batches, fanout), ["doc_id"])


def clean(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 2, fanout: int = 2) -> DataFrame:
    """docs with the lines taken out of text; a column n_chars follows the new text. Other columns stay as they are."""
    mark = "_row_" + uuid.uuid4().hex
    packed = docs.select("doc_id", "text", F.struct("*").alias(mark))
    found = without(packed, common_lines(docs, min_docs, min_chars, batches, fanout), [mark])
    new = {"text": F.col("_kept"), "n_chars": F.char_length("_kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return found.select(*[(new[c] if c in new else F.col(f"{mark}.`{c}`")).alias(c) for c in docs.columns])


def dedup_batch(batch: DataFrame, runs: LineRuns, min_chars: int = 1) -> DataFrame:
    """One step of an endless corpus: loses the lines that earlier batches hold, and adds its own new ones to the runs."""
    lines = saved(hashed_lines(batch, min_chars), "lines")
    known = saved(runs.counts().select("h1", "h2"), "known-lines")
    out = without(batch, drop_positions(lines, known))  # planned on tables that later runs do not touch
    runs.add(lines, settled_at=1)
    return out
