"""What the operators on vectors share: whole components, and sums over all rows of a table of packed vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of vectors in one packed block, and payloads that reach the driver at once.
BLOCK_ROWS = 1024
PAYLOADS = 16


def whole(vectors: DataFrame, column: str, scale: float, shift: int = 0) -> tuple[DataFrame, int]:
    """The rows with a vector x of longs, floor(scale * component) + shift, and their length.

    Rows go whose vector is null or holds null or non-finite components, and those whose vector has not the commonest
    length (of equally common ones the greatest). Components must fit a long.
    """
    c = F.col(column)
    double = F.transform(c, lambda x: x.cast("double"))
    fine = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(c.isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(c) > 0))
    sizes = rows.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return rows.where(F.size(c) == d).withColumn("x", F.transform(double, lambda x: F.floor(F.lit(float(scale)) * x) + F.lit(shift))), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of d longs as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def packed(rows: DataFrame, d: int) -> DataFrame:
    """(x): the vectors x of up to BLOCK_ROWS rows as one binary, for passes that need nothing else."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), d)
            small = len(x) == 0 or (np.abs(x).max() < 2**31)
            for k in range(0, len(x), BLOCK_ROWS):
                block = x[k : k + BLOCK_ROWS].astype("<i4" if small else "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([len(block)], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["rows", "x"])

    return rows.select("x").mapInArrow(run, "rows int, x binary")


def blocks(batches: Iterable[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """The matrices of a packed table."""
    for batch in batches:
        for n, raw in zip(batch.column("rows").to_pylist(), batch.column("x").to_pylist(), strict=True):
            yield np.frombuffer(raw, "<i4" if len(raw) == 4 * n * d else "<i8").reshape(n, d)


def added(table: DataFrame, d: int, shape: tuple[int, ...], dtype: str, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of of(block) over all blocks of a packed table.

    Each task adds its blocks; then tasks of a second stage add these sums until at most PAYLOADS reach the driver.
    """

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        for block in blocks(batches, d):
            total += of(block)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sum"])

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted((p, s) for b in batches for p, s in zip(b.column("part").to_pylist(), b.column("sum").to_pylist(), strict=True))
        if parts:
            total = sum((np.frombuffer(s, dtype) for _, s in parts[1:]), np.frombuffer(parts[0][1], dtype))
            yield pa.RecordBatch.from_arrays([pa.array([parts[0][0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sum"])

    sums = table.mapInArrow(first, "part int, sum binary")
    parts = table.rdd.getNumPartitions()
    while parts > PAYLOADS:
        parts = max(PAYLOADS, parts // 64)
        sums = sums.repartition(parts, "part").mapInArrow(second, "part int, sum binary")
    total = np.zeros(shape, dtype)
    for r in sorted(sums.collect(), key=lambda r: r["part"]):
        total += np.frombuffer(r["sum"], dtype).reshape(shape)
    return total
