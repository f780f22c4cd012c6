"""Connected components of links between keys, by large and small stars.

Each round links every node's larger neighbours to its smallest neighbour, then every node and its smaller neighbours to the smallest of
these, until nothing changes: about log(n) rounds of groupings and joins. No component is gathered: a node's links are aggregated to one minimum,
before they move where they can be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): component is the smallest node that it is connected to. Loops and repeats do no harm."""
    edges = cut(links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = cut(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    edges, last = edges.where("u <> v"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == last:
            break
        last = now
    return nodes.join(edges.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
