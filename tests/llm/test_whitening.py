import numpy as np
import pytest

from lumaframe.llm import whitening
from lumaframe.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, x string, deviation string, component int"


def rows_of(vectors, first=0):
    return [(first + k, None if v is None else [None if c is None else float(c) for c in v], 1, "x", "d", 1) for k, v in enumerate(vectors)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def whole(v):
    return np.floor(64 * np.asarray(v, np.float32).astype(float)).astype(np.int64) + 1_000_000


def held(found, ids, vectors, wanted, tolerance=1e-9):
    """The rows against a dense eigensolver over all vectors."""
    x = whole(vectors)
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(wanted, int((e > 1e-10 * e[0]).sum()))
    assert len(found) == n * k
    got = {}
    for r in found:
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    deviation = {i: int(v) for i, v in zip(ids, ((n * x - sums) ** 2).sum(1), strict=True)}
    for c in range(1, k + 1):
        w = centred @ u[:, c - 1] / np.sqrt(e[c - 1])
        own = np.array([got[i, c][0]["whitened"] for i in ids])
        assert min(np.abs(own - w).max(), np.abs(own + w).max()) < tolerance * 1e3 / min(1, np.abs(np.diff(e)).min() + 1e-3)
        for i in ids:
            r = got[i, c][0]
            assert r["n"] == n and r["deviation"] == deviation[i] and r["identity_error"] < 1e-9
            assert r["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-10)


def test_query_equals_a_dense_solver(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((400, 48)) * np.linspace(0.2, 1, 48)
    odd = [None, [], [1.0] * 7, [float("nan")] + [0.0] * 47, [float("-inf")] + [0.0] * 47, [None] + [0.0] * 47]
    frame(spark, [*rows_of(vectors), *rows_of(odd, 1000)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    held(QUERIES["op11_whitening"](spark, str(tmp_path)).collect(), range(400), vectors, 32)


@pytest.mark.parametrize("guard", [1, 5])
def test_small_guards_need_more_rounds(spark, guard):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((300, 20)) * np.linspace(0.1, 3, 20)
    model, _ = whitening.fit(frame(spark, rows_of(vectors)), components=5, guard=guard)
    x = whole(vectors)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(model.eigenvalues, e[::-1][:5], rtol=1e-12)
    assert np.allclose(np.abs((model.components * u[:, ::-1][:, :5]).sum(0)), 1, atol=1e-12)
    assert model.passes > 5


def test_low_rank_equal_eigenvalues_and_copies(spark):
    rng = np.random.default_rng(3)
    low = rng.integers(-40, 40, (200, 3)) @ rng.integers(-3, 4, (3, 40)) / 64
    found = whitening.components(frame(spark, rows_of(low))).collect()
    assert {r["component"] for r in found} == {1, 2, 3} and max(r["identity_error"] for r in found) < 1e-9
    cube = np.array([[(k >> b & 1) * 2.0 - 1 for b in range(6)] for k in range(64)])
    model, _ = whitening.fit(frame(spark, rows_of(cube)), components=4)
    assert np.allclose(model.eigenvalues, 64**2) and np.allclose(model.components.T @ model.components, np.eye(4)) and model.identity_error < 1e-12
    copies = np.vstack([np.tile(rng.standard_normal(10), (300, 1)), rng.standard_normal((100, 10))])
    model, rows = whitening.fit(frame(spark, rows_of(copies)), components=10)
    assert model.identity_error < 1e-9 and whitening.whitened(rows, model).count() == 400


def test_nothing_to_whiten(spark):
    for rows in ([], rows_of([None, []]), rows_of([[1.0, 2.0]]), rows_of([[1.0, 2.0]] * 9)):
        found = whitening.components(frame(spark, rows))
        assert found.count() == 0
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_null_and_repeated_ids(spark):
    rows = rows_of(np.random.default_rng(4).standard_normal((30, 4)))
    rows = [(None if k < 3 else r[0] // 2, *r[1:]) for k, r in enumerate(rows)]
    found = whitening.components(frame(spark, rows), components=2).collect()
    assert len(found) == 60 and sum(r["vec_id"] is None for r in found) == 6


def test_deviation_beyond_a_long(spark):
    model, rows = whitening.fit(frame(spark, rows_of([[1e14, 0.0], [-1e14, 1.0], [0.0, 2.0]])), components=1)
    assert [r["deviation"] for r in whitening.whitened(rows, model).orderBy("vec_id").collect()][:2] == [None, None]
