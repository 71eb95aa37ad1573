"""Passes over rows in the order of one key, without one task for all: chunks of the key, and totals carried over them.

A pass orders each chunk of ``CHUNK`` keys by itself; what goes over its edges are totals, one row a chunk, and only
these are ordered in one task.  Keys are unique where a function says so; null keys are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a chunk: 2,000 million slots have half a million chunks.
CHUNK = 4096


def _chunk(key: str):
    return F.floor(F.col(key) / CHUNK).cast("long")


def prefix_sum(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """The rows (one a key) with the sum of the values of all smaller keys."""
    cut = rows.where(F.col(key).isNotNull()).withColumn("_chunk", _chunk(key))
    whole = cut.groupBy("_chunk").agg(F.sum(value).alias("_total"))
    before = whole.select(F.col("_chunk").alias("_c"), F.coalesce(F.sum("_total").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("_inside", inside).join(before, F.col("_chunk") == F.col("_c")).withColumn(out, F.col("_before") + F.col("_inside")).drop("_chunk", "_c", "_before", "_inside")


def rotations(leaders: DataFrame, gap: int = 1) -> DataFrame:
    """(slot, leader, rotation): runs of slots of one leader, numbered from 1 in order.

    A slot begins a run if the leader changes, if more than ``gap`` slots lie between, or if its leader is unknown.
    """
    slots = leaders.where("slot is not null").groupBy("slot").agg(F.min("leader").alias("leader")).withColumn("_chunk", _chunk("slot"))
    ends = slots.groupBy("_chunk").agg(F.max_by("leader", "slot").alias("l"), F.max("slot").alias("s"))
    by_chunk = Window.orderBy("_chunk")
    edge = ends.select(F.col("_chunk").alias("_c"), F.lag("l").over(by_chunk).alias("_l"), F.lag("s").over(by_chunk).alias("_s"))
    inside = Window.partitionBy("_chunk").orderBy("slot")
    before = F.lag(F.struct("leader", "slot")).over(inside)
    met = slots.withColumn("_p", before).join(edge, F.col("_chunk") == F.col("_c"))
    previous = F.when(F.col("_p").isNotNull(), F.col("_p")).otherwise(F.struct(F.col("_l").alias("leader"), F.col("_s").alias("slot")))
    fresh = F.when((previous["leader"] == F.col("leader")) & (F.col("slot") - previous["slot"] <= gap), 0).otherwise(1)
    marked = met.select("slot", "leader", fresh.cast("long").alias("_fresh"))
    return prefix_sum(marked, "slot", "_fresh", "_n").select("slot", "leader", (F.col("_n") + F.col("_fresh")).alias("rotation"))


def rotation_extents(numbered: DataFrame) -> DataFrame:
    """(rotation, leader, first_slot, last_slot, slots, contiguous)."""
    out = numbered.groupBy("rotation").agg(F.min("leader").alias("leader"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count("*").alias("slots"))
    return out.withColumn("contiguous", F.col("last_slot") - F.col("first_slot") + 1 == F.col("slots"))


def as_of(points: DataFrame, starts: DataFrame, key: str, value: str) -> DataFrame:
    """The points with the value of the last start at or before their key; null before all starts."""
    both = points.select(key).distinct().select(key, F.lit(None).cast(starts.schema[value].dataType).alias(value), F.lit(1).alias("_asks")).unionByName(starts.select(key, value, F.lit(0).alias("_asks")))
    cut = both.withColumn("_chunk", _chunk(key))
    last = cut.groupBy("_chunk").agg(F.max_by(value, F.when(F.col("_asks") == 0, F.col(key))).alias("_v"))
    carried = last.select(F.col("_chunk").alias("_c"), F.last("_v", ignorenulls=True).over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    here = F.last(value, ignorenulls=True).over(Window.partitionBy("_chunk").orderBy(key, "_asks").rowsBetween(Window.unboundedPreceding, 0))
    found = cut.withColumn("_here", here).where("_asks = 1").join(carried, F.col("_chunk") == F.col("_c")).select(F.col(key).alias("_k"), F.coalesce("_here", "_before").alias(value))
    return points.join(found, F.col(key) == F.col("_k"), "left").drop("_k")


def rolling_mean(rows: DataFrame, key: str, index: str, value: str, before: int, after: int, out: str, block: int = 65_536) -> DataFrame:
    """The mean of the values from ``before`` rows back to ``after`` rows on, null where the frame is not full.

    index: the rows' dense numbers from 0 in order; a block takes the rows near its edges of its neighbours as well.
    """
    at = F.floor(F.col(index) / block)
    reach = F.array_distinct(F.array(at, F.floor((F.col(index) - after) / block), F.floor((F.col(index) + before) / block)))
    copies = rows.select(key, index, value, F.explode(reach).alias("_block"))
    frame = Window.partitionBy("_block").orderBy(index).rowsBetween(-before, after)
    mean = F.when(F.count(value).over(frame) == before + after + 1, F.avg(value).over(frame))
    return copies.withColumn(out, mean).where(F.col("_block") == F.floor(F.col(index) / block)).drop("_block")


def ranks(rows: DataFrame, value: str, tie: str, buckets: int = 1024) -> DataFrame:
    """The rows with ``rank`` from 1 by (value, tie) and ``below``, the sum of all values before, by ranges of the value."""
    bounds = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # one row
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / buckets)
    cut = rows.join(F.broadcast(bounds)).withColumn("_bucket", F.coalesce(F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(buckets - 1)), F.lit(0))).drop("_lo", "_hi")
    whole = cut.groupBy("_bucket").agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_v").over(earlier), F.lit(0.0)).alias("_sum"))
    inside = Window.partitionBy("_bucket").orderBy(value, tie)
    met = cut.withColumn("_r", F.row_number().over(inside)).withColumn("_s", F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).join(before, F.col("_bucket") == F.col("_b"))
    return met.withColumn("rank", (F.col("_rows") + F.col("_r")).cast("long")).withColumn("below", F.col("_sum") + F.col("_s")).drop("_bucket", "_b", "_rows", "_sum", "_r", "_s")
