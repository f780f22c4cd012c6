"""Exact top-k inner products of whole-number vectors by block-at-a-time pruning.

Rows are laid out so that near ones are neighbours: by the nearest of at most PIVOTS sampled vectors (the sample only
decides the order), then by how near. Ranges of this order are shards, each cut into blocks of BLOCK_ROWS rows that keep, besides
their vectors (the block's forward index), the largest and the least value of each component (term). The sum over terms of
the query's value times the one of the two that makes more bounds every score in a block. For each query a shard's blocks
are taken by falling bound, some more each round, and scored until the bounds fall below its kth score; a block whose
bound equals that score still counts while it holds a smaller id. Queries go through a shard in chunks, and what a round asks of a
block is one matrix product.

Two passes: first each query sees the shard of the highest bound (its near copies are there), which gives a kth score
to start with; then it goes to those other shards that could still do better. Shards, cut to SHARD_BYTES of vectors, are
what a task holds at once, with one chunk of queries; both passes move the rows once and the queries once for each shard
that they must see. Bounds of shards are held by the driver and sent to tasks for up to MAX_SHARDS shards; beyond, every query
goes to every shard, with the same result.

Defined results: rows whose vector is null, empty, or holds null or non-finite components take no part, nor do those
that have not the commonest length; repeated rows are rows of their own, so a query can find its copy; ties go to the
smaller id, a null id last; fewer than k other rows are all returned; a single row finds nothing; an empty table gives an
empty result; other columns are not looked at. Scores must fit a long (else an OverflowError).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.llm.common import forget, saved
from lumaframe.llm.vectors import matrix, whole

PIVOTS, BLOCK_ROWS, CHUNK = 256, 64, 256
SHARD_BYTES, MAX_SHARDS = 32 << 20, 65_536
#: In the order of a shard, chunks of queries come after the blocks; its summary comes before.
SUMMARY, QUERIES = -1, 2**31 - 1
LAST = 2**63 - 1
INDEX = "shard int, block int, n int, ids binary, nulls binary, uids binary, x binary, high binary, low binary"
NAMES = [c.split()[0] for c in INDEX.split(", ")]
FOUND = "uid long, id long, no_id boolean, shard int, x binary, ids array<long>, scores array<long>"


def _raw(x: np.ndarray) -> bytes:
    return x.astype("<i4" if not x.size or np.abs(x).max() < 2**31 else "<i8").tobytes()


def _rows(raw: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * n * d else "<i8").reshape(n, d).astype(np.int64)


def _exact(d: int, *sizes: int) -> type:
    """The type in which d products of values of such sizes add up exactly."""
    most = d * math.prod(max(1, int(s)) for s in sizes)
    if most >= 2**63:
        raise OverflowError("an inner product may not fit a long")
    return np.float64 if most < 2**53 else np.int64


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block, no score of the block is larger."""
    size = max(np.abs(high).max(initial=0), np.abs(low).max(initial=0))
    kind = _exact(q.shape[1], np.abs(q).max(initial=0), size)
    return np.maximum(q, 0).astype(kind) @ high.T.astype(kind) + np.minimum(q, 0).astype(kind) @ low.T.astype(kind)


class Shard:
    """The blocks of one range of rows."""

    def __init__(self, blocks: list[dict], d: int):
        sizes = [b["n"] for b in blocks]
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.x = np.concatenate([_rows(b["x"], b["n"], d) for b in blocks])
        self.ids, self.uids = (np.concatenate([np.frombuffer(b[c], "<i8") for b in blocks]) for c in ("ids", "uids"))
        self.nulls = np.concatenate([np.frombuffer(b["nulls"], bool) for b in blocks])
        self.high, self.low = (np.array([np.frombuffer(b[c], "<i8") for b in blocks]) for c in ("high", "low"))
        self.first = np.minimum.reduceat(self.ids, self.start)
        self.size = int(np.abs(self.x).max(initial=0))
        self.forms = {np.int64: self.x}
        self.scored = 0

    def search(self, q: np.ndarray, uids: np.ndarray, score: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of up to k rows of each query that beat its (score, id), best first; other rows than the query's own."""
        kind = _exact(q.shape[1], np.abs(q).max(initial=0), self.size)
        v = self.forms.setdefault(kind, self.x.astype(kind) if kind not in self.forms else None)
        least = -np.inf if kind is np.float64 else -LAST
        score, last, q = np.where(score == -LAST, least, score).astype(kind), last.copy(), q.astype(kind)
        most = bounds(q.astype(np.int64), self.high, self.low).astype(kind)
        order = (-most).argsort(axis=1, kind="stable")
        most = np.take_along_axis(most, order, 1)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))
        at, width = 0, 1
        while at < order.shape[1] and (most[:, at] >= score).any():
            block, bound = order[:, at : at + width], most[:, at : at + width]
            asks, column = ((bound > score[:, None]) | ((bound == score[:, None]) & (self.first[block] < last[:, None]))).nonzero()
            block = block[asks, column]
            turn = block.argsort(kind="stable")
            block, asks = block[turn], asks[turn]
            edges = np.r_[(block[1:] != block[:-1]).nonzero()[0] + 1, len(block)] if len(block) else []
            parts = [best]
            for i, j in zip([0, *edges[:-1]], edges, strict=False):
                a, b, own = self.start[block[i]], self.end[block[i]], asks[i:j]
                s = v[a:b] @ q[own].T
                hit = (s > score[own]) | ((s == score[own]) & (self.ids[a:b, None] < last[own]))
                row, column = (hit & (self.uids[a:b, None] != uids[own])).nonzero()
                parts.append((own[column], a + row, s[row, column]))
                self.scored += s.size
            if len(parts) > 1:
                who, row, s = (np.concatenate(p) for p in zip(*parts, strict=True))
                turn = np.lexsort((self.ids[row], -s, who))
                who, row, s = who[turn], row[turn], s[turn]
                heads = np.r_[True, who[1:] != who[:-1]].nonzero()[0]
                place = np.arange(len(who)) - heads.repeat(np.diff(np.r_[heads, len(who)]))
                best = (who[place < k], row[place < k], s[place < k])
                full = place == k - 1
                score[who[full]], last[who[full]] = s[full], self.ids[row[full]]
            at, width = at + width, min(2 * width, 32)
        return best[0], best[1], best[2].astype(np.int64)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "block": pa.int32(), "n": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.binary())) for c in NAMES], names=NAMES)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, with the last number for null, and which are null."""
    return column.fill_null(LAST).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def placed(rows: DataFrame, d: int, pivots: np.ndarray) -> DataFrame:
    """(uid, id, asks, x, pivot, near): which sampled vector a row is nearest to, and how near."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"), d)
            if len(x):
                near = x.astype(np.float64) @ pivots.T
                own = near.argmax(1)
                packs = pa.array([_raw(v) for v in x], pa.binary())
                columns = [batch.column("uid"), batch.column("id"), batch.column("asks"), packs, pa.array(own, pa.int32()), pa.array(near[np.arange(len(x)), own], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "id", "asks", "x", "pivot", "near"])

    return rows.select("uid", "id", "asks", "x").mapInArrow(run, "uid long, id long, asks boolean, x binary, pivot int, near double")


def index(rows: DataFrame, d: int, shards: int) -> DataFrame:
    """The blocks of each shard, and one row with the bounds of all of it."""

    def block(shard: int, k: int, ids: np.ndarray, nulls: np.ndarray, uids: np.ndarray, x: np.ndarray) -> dict:
        return {"shard": shard, "block": k, "n": len(x), "ids": ids.tobytes(), "nulls": nulls.tobytes(), "uids": uids.tobytes(), "x": _raw(x), "high": x.max(0).tobytes(), "low": x.min(0).tobytes()}

    def run(batches):
        shard, k, held, most, least, total = TaskContext.get().partitionId(), 0, [], None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((*_ids(batch.column("id")), batch.column("uid").to_numpy(), np.concatenate([_rows(r, 1, d) for r in batch.column("x").to_pylist()])))
            ids, nulls, uids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            most, least = (x.max(0), x.min(0)) if most is None else (np.maximum(most, x.max(0)), np.minimum(least, x.min(0)))
            whole_rows = len(x) - len(x) % BLOCK_ROWS
            out = [block(shard, k + a // BLOCK_ROWS, ids[a : a + BLOCK_ROWS], nulls[a : a + BLOCK_ROWS], uids[a : a + BLOCK_ROWS], x[a : a + BLOCK_ROWS]) for a in range(0, whole_rows, BLOCK_ROWS)]
            k, total = k + len(out), total + whole_rows
            held = [(ids[whole_rows:], nulls[whole_rows:], uids[whole_rows:], x[whole_rows:])]
            if out:
                yield _batch(out)
        if most is not None:
            out = [block(shard, k, *held[0])] if len(held[0][0]) else []
            yield _batch([*out, {"shard": shard, "block": SUMMARY, "n": total + len(held[0][0]), "high": most.tobytes(), "low": least.tobytes()}])

    order = ["pivot", "near", "uid"]
    return rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(run, INDEX)


def routed(queries: DataFrame, d: int, high: np.ndarray, low: np.ndarray, names: np.ndarray, k: int, first: bool) -> DataFrame:
    """Chunks of queries for each shard: first the one with the highest bound, later all others that may beat the kth score."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x = np.concatenate([_rows(r, 1, d) for r in part.column("x").to_pylist()])
                uids, ids = part.column("uid").to_numpy(), part.column("id").fill_null(LAST).to_numpy(zero_copy_only=False)
                nulls = part.column("id").is_null().to_numpy(zero_copy_only=False)
                most = bounds(x, high, low)
                score, last = np.full(len(x), -LAST), np.full(len(x), LAST)
                if first:
                    goes = np.arange(len(names)) == most.argmax(1)[:, None]
                else:
                    for j, (s, i) in enumerate(zip(part.column("scores").to_pylist(), part.column("ids").to_pylist(), strict=True)):
                        if len(s) == k:
                            score[j], last[j] = s[-1], LAST if i[-1] is None else i[-1]
                    goes = ((score == -LAST)[:, None] | (most >= score[:, None])) & (names != part.column("shard").to_numpy()[:, None])
                out = []
                for j in goes.any(0).nonzero()[0]:
                    own = goes[:, j]
                    out.append({"shard": int(names[j]), "block": QUERIES, "n": int(own.sum()), "ids": ids[own].tobytes(), "nulls": nulls[own].tobytes(), "uids": uids[own].tobytes(), "x": _raw(x[own]), "high": score[own].tobytes(), "low": last[own].tobytes()})
                if out:
                    yield _batch(out)

    return queries.mapInArrow(run, INDEX)


def everywhere(queries: DataFrame, d: int, shards: int) -> DataFrame:
    """Chunks of queries for every shard."""
    chunk = routed(queries, d, np.zeros((1, d), np.int64), np.zeros((1, d), np.int64), np.array([-1]), 0, True)
    return chunk.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def searched(blocks: DataFrame, chunks: DataFrame, d: int, shards: int, k: int) -> DataFrame:
    """What each query finds in each shard that it goes to."""

    def run(batches):
        number, held, shard = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != number:
                    number, held, shard = r["shard"], [], None
                if r["block"] != QUERIES:
                    held.append(r)
                    continue
                if shard is None and not held:
                    continue  # a range without rows
                if shard is None:
                    shard, held = Shard(held, d), []
                n = r["n"]
                x, uids = _rows(r["x"], n, d), np.frombuffer(r["uids"], "<i8")
                who, row, s = shard.search(x, uids, np.frombuffer(r["high"], "<i8"), np.frombuffer(r["low"], "<i8"), k)
                ends = np.searchsorted(who, np.arange(n + 1)).astype(np.int32)
                ids = pa.array(np.frombuffer(r["ids"], "<i8"), pa.int64())
                found = pa.array(shard.ids[row], pa.int64(), mask=shard.nulls[row])
                columns = [
                    pa.array(uids, pa.int64()), ids, pa.array(np.frombuffer(r["nulls"], bool)), pa.array(np.full(n, number), pa.int32()), pa.array([_raw(v) for v in x], pa.binary()),
                    pa.ListArray.from_arrays(ends, found), pa.ListArray.from_arrays(ends, pa.array(s, pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    both = blocks.unionByName(chunks.select(*NAMES))
    return both.repartitionById(shards, "shard").sortWithinPartitions("shard", "block").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, asks: Column, key: str = "vec_id", column: str = "embedding", k: int = 10, scale: float = 1024, shard_bytes: int = SHARD_BYTES, max_shards: int = MAX_SHARDS) -> DataFrame:
    """(query_id, rank, key, score) of the k rows with the highest inner products with each row that asks."""
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    rows, d = whole(vectors.select(F.col(key).alias("id"), F.col(column).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")), "v", scale)
    if not d:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score long")
    rows = rows.withColumn("id", F.col("id").cast("long")).withColumn("uid", F.monotonically_increasing_id())
    sample = rows.orderBy(F.xxhash64("id", "x")).limit(PIVOTS).select("x").collect()
    held = saved(placed(rows, d, np.array([r["x"] for r in sample], np.float64)), "vectors")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held.count() * 8 * d // shard_bytes))
    stored = saved(index(held, d, shards), "vector-blocks")
    queries, blocks = held.where("asks"), stored.where(f"block <> {SUMMARY}")
    if shards <= max_shards:
        summary = stored.where(f"block = {SUMMARY}").select("shard", "high", "low").orderBy("shard").collect()
        high, low = (np.array([np.frombuffer(r[c], "<i8") for r in summary]).reshape(-1, d) for c in ("high", "low"))
        names = np.array([r["shard"] for r in summary])
        near = saved(searched(blocks, routed(queries.select("uid", "id", "x"), d, high, low, names, k, True), d, shards, k), "first-found")
        forget(held)
        known = near.withColumn("id", F.when(~F.col("no_id"), F.col("id"))).select("uid", "id", "x", "shard", "ids", "scores")
        found = near.unionByName(searched(blocks, routed(known, d, high, low, names, k, False), d, shards, k))
    else:
        found = searched(blocks, everywhere(queries.select("uid", "id", "x"), d, shards), d, shards, k)
    pairs = found.select("uid", "id", "no_id", F.explode(F.arrays_zip("ids", "scores")).alias("hit")).select("uid", "id", "no_id", F.col("hit.ids").alias("other"), F.col("hit.scores").alias("score"))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("other"))
    best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.when(~F.col("no_id"), F.col("id")).cast(kind).alias("query_id"), "rank", F.col("other").cast(kind).alias(key), "score")
