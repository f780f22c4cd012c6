"""Whitening of vectors by Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never made: a pass over all rows gives V Q = XᵀXQ / n for a block Q of columns, with rows
centred before anything is multiplied (their exact whole-number mean is taken off in two parts, so that what is left is
small and precise). One round is

* Rayleigh-Ritz: V Q, then the eigenvalues and vectors of QᵀVQ; residuals V q - e q certify the wanted columns;
* a Chebyshev filter: the three-term recurrence in V, scaled to the interval of the unwanted eigenvalues, damps those and
  lets the wanted ones grow; its degree follows from the residuals. Then QR.

The interval ends above at the least Ritz value of the block, which has half as many columns more than are wanted (guard, one at least); below
at a bound from Lanczos steps of one further column that rides along in the first passes. Rounds end when all residuals
are below TOLERANCE times the largest eigenvalue, or no longer fall once they are below ROUNDING times it.

The vectors are stored once as packed blocks in the shared folder, which every pass reads; sums of tasks are added in
further tasks until at most sixteen blocks of (dimensions x columns) reach the driver. Nothing else leaves a task.

Defined results: rows whose vector is null, empty, or holds null or non-finite components give no row, nor do those that
have not the commonest length; repeated rows count each and give equal rows, whatever their id (null too); components
of no variance do not exist, so a table of one row or of equal rows gives no row, like an empty one; of equal
eigenvalues any orthonormal vectors are components; other columns are not looked at. A deviation that no long can hold is
null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.common import forget, saved
from lumaframe.llm.vectors import added, matrix, packed, whole

#: Residuals relative to the largest eigenvalue: enough; enough if rounding lets them fall no further.
TOLERANCE, ROUNDING = 1e-14, 1e-11
#: Eigenvalues below this share of the largest are no variance.
NOTHING = 1e-10
#: Degree of a filter, and how much more the largest wanted direction may grow than the least.
DEGREES, CONTRAST = (4, 24), 1e8
LANCZOS_STEPS = 10


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums S; components as columns, their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, *_parts(self.n, self.sums))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.components) / np.sqrt(self.eigenvalues)


def _parts(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and what is left of it."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def _centred(x: np.ndarray, mean: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - mean).astype(np.float64) - rest


class _Covariance:
    """V times a block of columns, by a pass over a packed table."""

    def __init__(self, table: DataFrame, d: int, n: int, sums: list[int]):
        self.table, self.d, self.n, self.parts, self.passes = table, d, n, _parts(n, sums), 0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        mean, rest = self.parts
        self.passes += 1

        def product(x: np.ndarray) -> np.ndarray:
            c = _centred(x, mean, rest)
            return c.T @ (c @ q)

        return added(self.table, self.d, q.shape, "<f8", product) / self.n


class _Rider:
    """Lanczos steps of one column, for a lower bound of the spectrum."""

    def __init__(self, d: int, rng: np.random.Generator):
        v = rng.standard_normal(d)
        self.basis, self.alpha, self.beta = [v / np.linalg.norm(v)], [], []

    @property
    def column(self) -> np.ndarray | None:
        return self.basis[-1] if len(self.alpha) < min(LANCZOS_STEPS, len(self.basis[0])) and len(self.basis) > len(self.alpha) else None

    def take(self, w: np.ndarray) -> None:
        self.alpha.append(float(w @ self.basis[-1]))
        for _ in range(2):
            for v in self.basis:
                w = w - (w @ v) * v
        norm = float(np.linalg.norm(w))
        self.beta.append(norm)
        if norm > 1e-12 * abs(self.alpha[0]):
            self.basis.append(w / norm)

    def low(self) -> float:
        if len(self.alpha) < 4:
            return 0.0
        t = np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - self.beta[-1])


def _eigen(times: _Covariance, d: int, wanted: int, seed: int, guard: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of V and their vectors as columns."""
    rng = np.random.default_rng(seed)
    m = min(d, wanted + (max(4, wanted // 2) if guard is None else max(1, guard)))
    rider = _Rider(d, rng)

    def product(q: np.ndarray) -> np.ndarray:
        extra = rider.column
        if extra is None:
            return times(q)
        out = times(np.column_stack((q, extra)))
        rider.take(out[:, -1])
        return out[:, :-1]

    q = np.linalg.qr(rng.standard_normal((d, m)))[0]
    before = np.inf
    for _ in range(60):
        y = product(q)
        h = q.T @ y
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, y = q @ u, y @ u
        if e[0] <= 0:
            return e[:0], q[:, :0]
        k = min(wanted, int((e > NOTHING * e[0]).sum()))
        residual = float(np.linalg.norm(y[:, :k] - q[:, :k] * e[:k], axis=0).max(initial=0)) / e[0]
        if residual <= TOLERANCE or (residual <= ROUNDING and residual > before / 2) or m == d:
            return e[:k], q[:, :k] / np.linalg.norm(q[:, :k], axis=0)
        before_first, before = before == np.inf, residual
        high = max(e[-1], 1e-8 * e[0])
        low = min(rider.low(), 0.9 * high)
        centre, half = (high + low) / 2, (high - low) / 2
        grow = np.arccosh(np.maximum(1 + 1e-12, (e[[0, k - 1]] - centre) / half))  # a degree, of the largest and the least wanted
        degree = np.clip(np.ceil(np.log(residual / TOLERANCE) / grow[1]), *DEGREES)
        degree = min(degree, LANCZOS_STEPS) if before_first else degree  # the next one knows the spectrum's lower end
        degree = int(max(1, min(degree, np.log(CONTRAST) / max(grow[0] - grow[1], 1e-9))))
        sigma = first = half / (e[0] - centre)
        old, new = q, (y - centre * q) * (sigma / half)
        for _ in range(degree - 1):
            following = 1 / (2 / first - sigma)
            old, new = new, (product(new) - centre * new) * (2 * following / half) - (sigma * following) * old
            sigma = following
        q = np.linalg.qr(new / np.linalg.norm(new, axis=0))[0]
    raise ArithmeticError(f"residual {residual} after 60 rounds")


def fit(vectors: DataFrame, column: str = "embedding", scale: float = 64, shift: int = 1_000_000, components: int = 32, seed: int = 0, guard: int | None = None) -> tuple[Whitening, DataFrame]:
    """The whitening of all vectors, as whole numbers floor(scale * c) + shift, and the rows with these as column x."""
    rows, d = whole(vectors, column, scale, shift)
    table = saved(packed(rows, d), "vectors")
    total = added(table, d, (d + 1,), "<i8", lambda x: np.r_[x.sum(0, dtype=np.int64), len(x)]) if d else np.zeros(1, np.int64)
    n, sums = int(total[-1]), [int(s) for s in total[:-1]]
    if not n:
        forget(table)
        return Whitening(0, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0), rows
    mean, rest = _parts(n, sums)
    trace = float(added(table, d, (1,), "<f8", lambda x: np.square(_centred(x, mean, rest)).sum(keepdims=True)[0])[0]) / n
    times = _Covariance(table, d, n, sums)
    e, v = _eigen(times, d, min(components, d), seed, guard) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    k, scaled = len(e), v / np.sqrt(e)

    def moments(x: np.ndarray) -> np.ndarray:
        w = _centred(x, mean, rest) @ scaled
        return np.vstack((w.T @ w, w.sum(0)))

    sums_of = added(table, d, (k + 1, k), "<f8", moments) / n if k else np.zeros((1, 0))
    error = float(np.abs(sums_of[:-1] - np.outer(sums_of[-1], sums_of[-1]) - np.eye(k)).max(initial=0))
    forget(table)
    return Whitening(n, sums, v, e, trace, error, times.passes), rows


def whitened(rows: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """(key, deviation, whitened) of rows that fit() gave: the exact squared deviation times n squared, and a double per component."""
    kind = rows.schema[key].dataType.simpleString()
    d = len(model.sums)
    mean, rest = _parts(model.n, model.sums) if model.n else (None, None)
    left = [s % model.n for s in model.sums] if model.n else []

    def deviations(x: np.ndarray) -> list[int | None]:
        off = x - mean
        if float(np.square((np.abs(off).max(initial=0) + 1.0) * model.n) * d) < 2**63:
            return np.square(off * model.n - np.array(left, np.int64)).sum(1).tolist()
        exact = ((off.astype(object) * model.n - np.array(left, object)) ** 2).sum(1)
        return [v if v < 2**63 else None for v in exact]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), d)
                w = (_centred(x, mean, rest) @ model.components) / np.sqrt(model.eigenvalues)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(deviations(x), pa.int64()), lists], names=[key, "deviation", "whitened"])

    if not len(model.eigenvalues):
        return rows.where("false").select(key, F.lit(None).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("whitened"))
    return rows.select(key, "x").mapInArrow(run, f"{key} {kind}, deviation long, whitened array<double>")


def components(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 32) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    model, rows = fit(vectors, column, components=components)
    share = F.array(*[F.lit(float(x)) for x in model.eigenvalues / model.trace]) if len(model.eigenvalues) else F.array(F.lit(0.0))
    long = whitened(rows, model, key).select(key, "deviation", F.posexplode("whitened").alias("component", "whitened"))
    return long.select(
        key,
        (F.col("component") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("component")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
