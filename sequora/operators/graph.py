"""Connected components of entity graphs, by minimum labels over checkpointed edge tables.

Defined cases: edges with a null end and loops link nothing, but a loop's node is a component; repeated edges count
once; an empty table gives no row.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names; a fresh local one is made in local mode only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sequora-"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Each round points every node at the least of itself and its neighbours, follows the pointers to their ends by
    doubling, and redraws the edges between the ends.  Neighbours are only aggregated.
    """
    use_checkpoints(edges.sparkSession)
    clean = edges.select("a", "b").where("a is not null and b is not null").checkpoint()
    label = clean.select(F.col("a").alias("node")).unionByName(clean.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node"))
    now = clean.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("from"), F.least("a", "m").alias("to")).checkpoint()
        while True:
            ahead = step.select(F.col("from").alias("f"), F.col("to").alias("t"))
            further = step.join(ahead, step["to"] == ahead["f"]).select("from", F.col("t").alias("to"), (F.col("t") < F.col("to")).alias("moved")).checkpoint()
            step = further.select("from", "to")
            if further.where("moved").isEmpty():
                break
        label = label.join(step, label["root"] == step["from"], "left").select("node", F.coalesce("to", "root").alias("root")).checkpoint()
        one = now.join(step, now["a"] == step["from"]).select(F.col("to").alias("a"), "b")
        two = one.join(step, one["b"] == step["from"]).select("a", F.col("to").alias("b"))
        now = two.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    return label


def star_edges(groups: DataFrame, key: str, node: str) -> DataFrame:
    """Edges (a, b) from the smallest node of a group to its others, without gathering a group."""
    pairs = groups.select(F.col(key).alias("k"), F.col(node).alias("b")).where("k is not null and b is not null").distinct()
    least = pairs.groupBy("k").agg(F.min("b").alias("a"))
    return pairs.join(least, "k").select("a", "b").distinct()
