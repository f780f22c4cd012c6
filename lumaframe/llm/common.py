"""Small helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once (a longer text comes alone).
SLICE_BYTES = 2 << 20


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows that go to Python at once: fewer than Spark's default, as texts may be long; another choice of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def short_lived_shuffles(spark: SparkSession) -> None:
    """Files of a query's shuffles go when it ends: what is read later is in tables of saved(). Another choice in the application's configuration stays."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if spark.sparkContext.getConf().get(key, None) is None:
        spark.conf.set(key, "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and all runs on this machine (tests), a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumaframe/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and no lost executor takes it along."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, to be broadcast if a count of it, a stored table, finds at most so many rows; otherwise joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def once(df: DataFrame, columns: list[str], slim: DataFrame | None = None) -> DataFrame:
    """df with one row of those that agree in columns. Only rows that have such a twin move; slim: these columns of df, if stored elsewhere."""
    slim = df if slim is None else slim
    twins = slim.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twins = saved(twins.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(columns)]), "twins")
    if twins.isEmpty():
        return df
    keys = bounded(twins)
    same = reduce(Column.__and__, [df[c].eqNullSafe(keys[f"_{k}"]) for k, c in enumerate(columns)])
    return df.join(keys, same, "left_anti").unionByName(df.join(keys, same, "left_semi").dropDuplicates(columns))


def forget(*tables: DataFrame) -> None:
    """Removes tables of saved() that nothing will read any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; -1 for a null id, which is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the text in each is at most limit bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(batch.column(column)), 0), pa.int64())).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(ends.searchsorted(base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
