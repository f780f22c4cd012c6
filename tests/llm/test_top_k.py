import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.llm import top_k
from lumaframe.llm.queries import QUERIES, SQL

from .conftest import ordered

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, id int, score double, shard int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "u", 1, 0.5, 2) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, step=100, k=10):
    x = [(i, np.floor(1024 * np.asarray(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows]
    out = []
    for a, (i, q) in enumerate(x):
        if i is not None and i % step == 0:
            others = sorted((-int(q @ v), j is None, j or 0) for b, (j, v) in enumerate(x) if b != a)
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(others[:k])]
    return out


def clustered(rng, n, d=12):
    """Groups of near copies, one large group of exact copies, and rows of their own."""
    centres = rng.standard_normal((20, d))
    v = centres[rng.integers(0, 20, n)] + 0.02 * rng.standard_normal((n, d))
    v[: n // 3] = v[0]
    v[n // 3 : n // 2] = rng.standard_normal((n // 2 - n // 3, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("shard_bytes,max_shards", [(top_k.SHARD_BYTES, 65_536), (4000, 65_536), (4000, 3)])
def test_equals_all_scores(spark, shard_bytes, max_shards):
    rng = np.random.default_rng(1)
    rows = [*enumerate(clustered(rng, 1500).tolist())]
    rng.shuffle(rows)
    found = top_k.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, shard_bytes=shard_bytes, max_shards=max_shards)
    assert ordered(found.collect()) == ordered(plain(rows, 50))


def test_query_equals_sql_and_all_scores(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [*enumerate(clustered(rng, 900).tolist())]
    rows += [(100, rows[100][1]), (200, rows[7][1]), (None, rows[3][1])]
    odd = [(2000, None), (2100, []), (2200, [1.0] * 5), (2300, [float("nan")] + [0.0] * 11), (2400, [float("inf")] * 12), (2500, [None] + [0.0] * 11)]
    frame(spark, rows + odd).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_top_k"](spark, str(tmp_path))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got = ordered(got.collect())
    assert got == ordered(plain(rows))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == ordered(db.execute(SQL["op12_top_k"]).fetchall())


def test_blocks_below_the_kth_score_are_not_scored():
    rng = np.random.default_rng(3)
    d, blocks = 8, []
    centres = 1000 * np.eye(d, dtype=np.int64)
    for k in range(64):
        x = centres[k % d] * (1 if k < 8 else -1) + rng.integers(-9, 10, (64, d))
        blocks.append({"n": 64, "ids": np.arange(64 * k, 64 * k + 64).tobytes(), "nulls": np.zeros(64, bool).tobytes(), "uids": np.arange(64 * k, 64 * k + 64).tobytes(), "x": top_k._raw(x), "high": x.max(0).tobytes(), "low": x.min(0).tobytes()})
    shard = top_k.Shard(blocks, d)
    who, row, score = shard.search(shard.x[:3], shard.uids[:3], np.full(3, -top_k.LAST), np.full(3, top_k.LAST), 10)
    all_scores = shard.x[:3] @ shard.x.T
    all_scores[np.arange(3), np.arange(3)] = -(2**60)
    assert np.array_equal(score.reshape(3, 10), -np.sort(-all_scores, 1)[:, :10])
    assert shard.scored <= 3 * 64 * 3


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x, q = rng.integers(-1000, 1000, (40, 6)), rng.integers(-1000, 1000, (30, 6))
    most = top_k.bounds(q, x.reshape(4, 10, 6).max(1), x.reshape(4, 10, 6).min(1))
    assert (most >= (q @ x.T).reshape(30, 4, 10).max(2)).all()


def test_large_numbers(spark):
    rows = [(k, [2.0**20 + k, -(2.0**20), 3.0]) for k in range(0, 1000, 10)]
    assert ordered(top_k.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()) == ordered(plain(rows))
    with pytest.raises(Exception, match="may not fit a long"):
        top_k.top_k(frame(spark, [(0, [2.0**30]), (1, [2.0**30])]), F.col("vec_id") == 0).collect()


def test_few_rows(spark):
    assert top_k.top_k(frame(spark, []), F.col("vec_id") == 0).count() == 0
    assert top_k.top_k(frame(spark, [(0, [1.0, 2.0])]), F.col("vec_id") == 0).count() == 0
    assert top_k.top_k(frame(spark, [(1, [1.0, 2.0])]), F.col("vec_id") == 0).count() == 0
    assert [tuple(r) for r in top_k.top_k(frame(spark, [(0, [1.0, 2.0]), (None, [1.0, 2.0])]), F.col("vec_id") == 0).collect()] == [(0, 1, None, 5 * 1024**2)]


def test_only_ties_are_left():
    """Blocks whose bound is the kth score, with no smaller ids, are not asked; the search ends all the same."""
    x = np.tile(np.arange(1, 5), (64, 1))
    blocks = [{"n": 64, "ids": np.arange(64 * k, 64 * k + 64).tobytes(), "nulls": np.zeros(64, bool).tobytes(), "uids": np.arange(64 * k, 64 * k + 64).tobytes(), "x": top_k._raw(x), "high": x[0].tobytes(), "low": x[0].tobytes()} for k in range(40)]
    shard = top_k.Shard(blocks, 4)
    _, row, _ = shard.search(x[:1], np.array([-1]), np.array([-top_k.LAST]), np.array([top_k.LAST]), 5)
    assert shard.ids[row].tolist() == [0, 1, 2, 3, 4] and shard.scored < 4 * 64
    assert not len(shard.search(x[:1], np.array([-1]), np.array([30]), np.array([0]), 5)[1])
