"""Writing catalog tables, lists and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, snapshot: str) -> None:
    """One snapshot of a table; writing it again replaces only that snapshot."""
    rows = df.withColumn("snapshot_date", F.lit(snapshot).cast("date"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """Part files in order; names of parts sort as their rows do."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str, *order: str) -> None:
    """One value a line."""
    (df.orderBy(*order) if order else df).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_snapshot(files: DataFrame, table: str, path: str, buckets: int) -> None:
    """A catalog snapshot as a table in buckets by rel_path, one sorted file a bucket.

    Two snapshots with the same number of buckets meet in catalog.diff() without a shuffle of either: bucket k of one holds the paths
    of bucket k of the other. Choose buckets so that one is a few hundred MB of the columns that diff() reads.
    """
    dealt = files.repartition(buckets, "rel_path")
    dealt.write.format("parquet").mode("overwrite").option("path", path).bucketBy(buckets, "rel_path").sortBy("rel_path").saveAsTable(table)


def read_snapshot(spark: SparkSession, table: str) -> DataFrame:
    """A table of write_snapshot(), whose files are known to be sorted: joins on rel_path need no sort either."""
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return spark.table(table)
