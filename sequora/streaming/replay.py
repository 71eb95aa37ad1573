"""Streams over the ledger: rotations matched as their successors close, and rows kept once.

Slots arrive in order; the legs of a slot that an earlier batch has passed are late and left out.  A window is matched
when both its rotations are closed, that is when a later one has begun; ``flush`` matches what the end of a stream left.
Every batch writes its own folders, so a batch that runs again writes the same rows in the same place.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching
from ..operators.graph import use_checkpoints


def shared_path(spark: SparkSession, name: str) -> str:
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def first_seen(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once, as long as its repeats come within the delay; state older than that is let go."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Everything available now, appended to a table of its own."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


class RotationMatcher:
    """A ``foreachBatch`` sink that keeps the legs of the last two rotations and writes the motifs of closed windows."""

    def __init__(self, spark: SparkSession, path: str, gap: int = matching.GAP):
        self.spark, self.path, self.gap = spark, path, gap

    def _carried(self, batch: int) -> DataFrame | None:
        if batch < 0:
            return None
        try:
            return self.spark.read.parquet(f"{self.path}/carry/{batch}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def __call__(self, fresh: DataFrame, batch: int) -> None:
        fresh, carried = fresh.select(*matching.NEEDED), self._carried(batch - 1)
        if carried is not None:
            passed = carried.agg(F.max("slot").alias("passed"))  # one row
            fresh = fresh.join(F.broadcast(passed)).where("passed is null or slot > passed").drop("passed").unionByName(carried)
        placed = matching.place(fresh, self.gap)
        placed.write.mode("overwrite").parquet(f"{self.path}/placed/{batch}")
        placed = self.spark.read.parquet(f"{self.path}/placed/{batch}")
        newest = placed.agg(F.coalesce(F.max("rotation"), F.lit(0))).first()[0]
        matching.match_windows(placed, newest - 2).write.mode("overwrite").parquet(f"{self.path}/motifs/batch={batch}")
        placed.where(F.col("rotation") >= newest - 1).select(*matching.NEEDED).write.mode("overwrite").parquet(f"{self.path}/carry/{batch}")

    def flush(self, last_batch: int) -> DataFrame:
        """All motifs, those of the windows left open included."""
        rest = matching.claimed_motifs(self._carried(last_batch), self.gap)
        done = self.spark.read.schema(matching.FOUND).parquet(*[f"{self.path}/motifs/batch={n}" for n in range(last_batch + 1)])
        return done.unionByName(rest)


def match_stream(legs: DataFrame, gap: int = matching.GAP) -> DataFrame:
    """The motifs of a stream of legs, all that is available now, batch by batch."""
    spark = legs.sparkSession
    path = shared_path(spark, "motif-stream")
    matcher = RotationMatcher(spark, path, gap)
    query = legs.writeStream.foreachBatch(matcher).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.lastProgress
    if progress is None or not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/carry").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/carry")):
        return spark.createDataFrame([], matching.FOUND)
    batch = progress["batchId"]
    while matcher._carried(batch) is None:  # the last trigger may have had no rows
        batch -= 1
    return matcher.flush(batch)
