"""Connected components of a graph too large for one machine, by alternating stars over materialised edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node hands its smallest neighbour to its larger neighbours (large) or to the others (small).

    edges: (u, v) with u > v.  No neighbour list is ever gathered: a node's minimum is an aggregate, joined back.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
    joined = both.join(least, both["u"] == least["w"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge, root being the smallest node reachable.  edges: (u, v) longs."""
    spark = edges.sparkSession
    now, path = common.materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    digest = None
    while True:
        after, after_path = common.materialise(_star(_star(now, True), False), "edges")
        common.drop_path(spark, path)
        now, path = after, after_path
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == digest:
            break
        digest = seen
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
