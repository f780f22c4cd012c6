"""Calibration: quantiles of metrics and what share of a set a threshold flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.session import cut

QUANTILES = (0.95, 0.98, 0.99)


def long_form(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(metric, value) of the named columns."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(F.explode(pairs).alias("m")).select("m.metric", "m.value").where("value is not null")


def quantiles(metrics: DataFrame, names: list[str], accuracy: int | None = None) -> DataFrame:
    """(metric, n, min, max, p95, p98, p99); exact, or with an accuracy from a bounded sketch.

    Exact ones come from ranks: equal values are counted, range-partitioned and numbered through by the counts of the partitions
    before, and the two values around each rank are picked. No task holds the values of a metric.
    """
    if accuracy is not None:
        q = F.percentile_approx("value", list(QUANTILES), accuracy).alias("q")
        rows = long_form(metrics, names).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), q)
        return rows.select("metric", "n", "min", "max", *[F.col("q")[k].alias(_name(x)) for k, x in enumerate(QUANTILES)])
    counts = long_form(metrics, names).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("many"))
    parts = cut(counts.repartitionByRange("metric", "value").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("metric", "part").agg(F.sum("many").alias("own"))  # one row per metric and partition
    before = Window.partitionBy("metric").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("metric", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"), F.sum("own").over(Window.partitionBy("metric")).alias("n"))
    inside = Window.partitionBy("metric", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = parts.withColumn("upto", F.sum("many").over(inside)).join(F.broadcast(sizes), ["metric", "part"]).withColumn("upto", F.col("upto") + F.col("offset"))

    def at(rank: Column) -> Column:
        """The value of a rank, counted from zero."""
        return F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("many")), F.col("value")))

    found = []
    for q in QUANTILES:
        place = F.lit(q) * (F.col("n") - 1)
        found += [at(F.floor(place)).alias(f"low_{_name(q)}"), at(F.ceil(place)).alias(f"high_{_name(q)}")]
    picked = rows.groupBy("metric", "n").agg(F.min("value").alias("min"), F.max("value").alias("max"), *found)

    def between(q: float) -> Column:
        place, low = F.lit(q) * (F.col("n") - 1), F.col(f"low_{_name(q)}")
        return (low + (place - F.floor(place)) * (F.col(f"high_{_name(q)}") - low)).alias(_name(q))

    return picked.select("metric", "n", "min", "max", *map(between, QUANTILES))


def _name(q: float) -> str:
    return f"p{round(100 * q)}"


def sweep(metrics: DataFrame, name: str, thresholds: list[float], above: bool = True) -> DataFrame:
    """(threshold, n, flagged, share) over a small grid of thresholds, in one pass and one row per task and threshold."""
    value = F.col(name)
    flags = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (value > t if above else value < t).alias("hit")) for t in thresholds])
    rows = metrics.where(value.isNotNull()).select(F.explode(flags).alias("f"))
    out = rows.groupBy("f.threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if("f.hit").alias("flagged"))
    return out.withColumn("share", F.col("flagged") / F.col("n"))
